"""Long spans that appear verbatim in more than one record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.cluster import write_table
from readloom.llm.duplicates import Copies, fold_copies
from readloom.llm.windows import concat, mix, window_hashes, window_min, window_starts
from readloom.operators.skew import skew_join


def _anchors(half: int, length: int):
    """(h, rec): the hashes of the windows of ``half`` letters that are the least one within some window of ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rec = b.column(0).to_numpy()
            codes, ends = concat(b.column(1).to_pylist())
            starts, owner = window_starts(ends, length)
            if len(starts):
                least = window_min(window_hashes(codes, half), length - half + 1)[starts]
                # neighbouring windows mostly have the same least window, so dropping repeats of the one before drops nearly all
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(rec[owner[new]])], ["h", "rec"])

    return run


def _windows(half: int, length: int):
    """(h1, h2, rec, pos): 128-bit hashes of the windows of ``length`` letters (from 1) whose least window of ``half`` letters is in the list of survivors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rec = b.column(0).to_numpy()
            codes, ends = concat(b.column(1).to_pylist())
            starts, owner = window_starts(ends, length)
            if not len(starts):
                continue
            least = window_min(window_hashes(codes, half), length - half + 1)[starts].view(np.int64)
            lists = b.column(2)
            alive = lists.flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(rec)), np.diff(lists.offsets.to_numpy()))
            # membership of (text, hash): both mixed into one number; a chance agreement only lets a window be looked at in vain
            known = np.sort(mix(alive.view(np.uint64) + mix(of.astype(np.uint64))))
            mine = mix(least.view(np.uint64) + mix(owner.astype(np.uint64)))
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            keep = known[at] == mine
            s, o = starts[keep], owner[keep]
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(window_hashes(codes, length)[s].view(np.int64)), pa.array(window_hashes(codes, length, 1)[s].view(np.int64)), pa.array(rec[o]), pa.array((s - ends[o] + 1).astype(np.int32))], ["h1", "h2", "rec", "pos"])

    return run


def _repeated(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame, int]:
    """rows written; of its keys, those that occur in two records at least, with their number of rows; the number of all rows."""
    rows = write_table(rows, name)
    found = write_table(rows.groupBy(*keys).agg(F.min("rec").alias("a"), F.max("rec").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select(*keys, "n"), f"{name}-repeated")
    return rows, found, rows.count()


def shared_windows(texts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """texts: (rec, text), all different. Returns (rec, pos) of every window of ``length`` letters that also stands in another record, and the texts that have one.

    Two levels. At half the length only one window in about 13 is looked at: the least by its hash within each window of
    the full length, which is the same one wherever that window stands. Only windows of the full length whose least half
    is repeated are looked at again.
    """
    half = length // 2
    rows, alive, total = _repeated(texts.select("rec", "text").mapInArrow(_anchors(half, length), "h long, rec long"), ["h"], "halves")
    lists = skew_join(rows, alive, ["h"], "n", total, F.col("rec")).groupBy("rec").agg(F.collect_set("h").alias("alive"))
    candidates = write_table(texts.join(lists, "rec").select("rec", "text", "alive"), "candidates")
    rows, alive, total = _repeated(candidates.mapInArrow(_windows(half, length), "h1 long, h2 long, rec long, pos int"), ["h1", "h2"], "wholes")
    found = write_table(skew_join(rows, alive, ["h1", "h2"], "n", total, F.col("rec")).select("rec", "pos"), "shared")
    return found, candidates.select("rec", "text")


def stretches(windows: DataFrame, length: int) -> DataFrame:
    """(rec, spans): the unbroken stretches covered by the windows of each record, as an array of (span_from, span_to) from 1. A record's windows are as many as its letters at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pos in b.column(1):
                p = np.sort(pos.values.to_numpy())
                cut = np.flatnonzero(np.diff(p) > length)
                out.append([{"span_from": int(a), "span_to": int(z) + length - 1} for a, z in zip(p[np.r_[0, cut + 1]], p[np.r_[cut, len(p) - 1]], strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("span_from", pa.int32()), ("span_to", pa.int32())])))], ["rec", "spans"])

    return windows.groupBy("rec").agg(F.collect_list("pos").alias("pos")).mapInArrow(run, "rec long, spans array<struct<span_from:int,span_to:int>>")


def _spread(copies: Copies, by_text: DataFrame) -> DataFrame:
    """by_text: (first_id, ...) -> (id, ...) for every copy."""
    return copies.expand(copies.groups.drop("text").join(by_text, "first_id").drop("first_id")).drop("n")


def shared_spans(df: DataFrame, id_col: str, text: Column, least: int) -> DataFrame:
    """(id, span_from, span_to): the longest unbroken stretches of letters that lie in a run of ``least`` or more standing verbatim in a record of different text.

    Exact copies of a whole text are folded first and don't count for one another. Windows of half the length that stand
    in one record only are dropped; those of the full length whose half survived decide which letters are shared (any
    longer run is a chain of them). All windows are compared by 128-bit hashes. Hot windows and hot texts are split.

    Texts shorter than ``least`` and nulls share nothing; a text that repeats a span only within itself shares nothing.
    Neighbouring stretches that touch are one. An empty table gives no rows.
    """
    copies = fold_copies(df, id_col, text, text=True)
    windows, _ = shared_windows(copies.groups.where(F.length("text") >= least).select(F.col("first_id").alias("rec"), "text"), least)
    spans = stretches(windows, least).withColumnRenamed("rec", "first_id")
    return _spread(copies, spans).select("id", F.explode("spans").alias("s")).select("id", "s.span_from", "s.span_to")


def shared_levels(df: DataFrame, id_col: str, text: Column, least: int) -> DataFrame:
    """(id, n_letters, n_shared, longest_level): how much of every record is shared elsewhere, and the largest of the lengths least, 2 * least, 4 * least, ... at which one of its windows is still repeated.

    Doubles the length until no candidates survive; each level reads only the texts in which the one before found
    something. Records that share nothing have n_shared 0 and longest_level 0; nulls have no row.
    """
    copies = fold_copies(df, id_col, text, text=True)
    texts = copies.groups.select(F.col("first_id").alias("rec"), "text")
    level, found, shared = least, texts.where(F.length("text") >= least), None
    best = None
    while True:
        windows, left = shared_windows(found, level)
        if shared is None:
            shared = stretches(windows, level).select("rec", F.expr("aggregate(spans, 0, (s, x) -> s + x.span_to - x.span_from + 1)").alias("n_shared"))
        hit = write_table(windows.select("rec").distinct(), "level")
        if hit.isEmpty():
            break
        now = hit.withColumn("level", F.lit(level))
        best = now if best is None else best.unionByName(now)
        level *= 2
        found = left.where(F.length("text") >= level).join(hit, "rec", "left_semi")
    out = texts.select(F.col("rec"), F.length("text").alias("n_letters")).join(shared, "rec", "left")
    out = out.join(best.groupBy("rec").agg(F.max("level").alias("longest_level")), "rec", "left") if best is not None else out.withColumn("longest_level", F.lit(None).cast("int"))
    out = out.select(F.col("rec").alias("first_id"), "n_letters", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.coalesce("longest_level", F.lit(0)).alias("longest_level"))
    return _spread(copies, out)
