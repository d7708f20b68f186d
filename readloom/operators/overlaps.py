"""Which sequences stand within others, or overlap with them at their ends, letter by letter.

Amplicons mostly begin and end alike, so first letters tell nothing of them: whatever is joined here is a word that is rare,
or a whole overlap. Words are shuffled as hashes with their places; texts come back for what met, and are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.cluster import write_table
from readloom.functions.seq import window_codes
from readloom.kernels.words import end_hashes
from readloom.operators.skew import skew_join


def contained(probes: DataFrame, texts: DataFrame, word: int) -> DataFrame:
    """(q, t): the texts (t, text) that hold all of a probe (q, probe), once for each pair; q and t are numbers.

    Of each probe the word of ``word`` letters that stands at the fewest places of all texts is looked up, so no probe meets
    more texts than hold its rarest word; a probe with a word that no text has is dropped before. Probes shorter than
    ``word`` and nulls are left out.
    """
    p = write_table(probes.where(F.length("probe") >= word).select("q", "probe"), "probes")
    t = write_table(texts.where(F.length("text") >= word).select("t", "text"), "texts")
    own = p.select("q", F.posexplode(window_codes(F.col("probe"), word)).alias("at", "w"))
    at = write_table(t.select("t", F.length("text").alias("size"), F.posexplode(window_codes(F.col("text"), word)).alias("p", "w")), "places")
    known = at.groupBy("w").agg(F.count(F.lit(1)).alias("n_t")).join(own.groupBy("w").agg(F.count(F.lit(1)).alias("n_q")), "w")
    known = write_table(known, "words")
    total = known.agg(F.coalesce(F.sum("n_q"), F.lit(0))).first()[0]
    met = skew_join(own, known, ["w"], "n_q", total, F.col("q"))
    rare = met.groupBy("q").agg(F.count(F.lit(1)).alias("n_words"), F.min_by(F.struct("w", "at"), F.struct("n_t", "at")).alias("r"))
    picked = rare.join(p.select("q", F.length("probe").alias("len")), "q").where(F.col("n_words") == F.col("len") - word + 1).select("q", "len", "r.w", "r.at")
    near = picked.join(at, "w").where((F.col("p") >= F.col("at")) & (F.col("p") - F.col("at") + F.col("len") <= F.col("size"))).select("q", "t", (F.col("p") - F.col("at") + 1).alias("from"))
    return near.join(p, "q").join(t, "t").where(F.col("probe") == F.expr("substring(text, from, length(probe))")).select("q", "t").distinct()


def end_overlaps(seqs: DataFrame, least: int) -> DataFrame:
    """(a, b): the last ``least`` letters or more of b, but not all, are the first ones of a, but not all. seqs: (i, seq), each sequence once; a and b are numbers i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            owner, n, first, last = end_hashes(b.column(1).to_pylist(), least)
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(n.astype(np.int32)), pa.array(first.view(np.int64)), pa.array(last.view(np.int64))], ["i", "n", "first", "last"])

    s = seqs.where(F.length("seq") > least).select("i", "seq")
    ends = write_table(s.mapInArrow(run, "i long, n int, first long, last long"), "ends")
    met = ends.select(F.col("i").alias("a"), "n", F.col("first").alias("h")).join(ends.select(F.col("i").alias("b"), "n", F.col("last").alias("h")), ["n", "h"]).where("a <> b")
    left, right = s.select(F.col("i").alias("a"), F.col("seq").alias("x")), s.select(F.col("i").alias("b"), F.col("seq").alias("y"))
    return met.join(left, "a").join(right, "b").where(F.expr("left(x, n) = right(y, n)")).select("a", "b").distinct()


def exact_overlaps(seqs: DataFrame, least: int) -> DataFrame:
    """(a, b): different sequences of which one begins within the other and agrees with it in every letter from there on, over ``least`` letters or more; each pair once, in one of both orders. Sequences shorter than ``least`` and nulls overlap with none."""
    s = write_table(seqs.select("seq").distinct().where(F.length("seq") >= least).select(F.monotonically_increasing_id().alias("i"), "seq"), "sequences")
    shortest, longest = s.agg(F.min(F.length("seq")), F.max(F.length("seq"))).first()
    inside = contained(s.where(F.length("seq") < (longest or 0)).select(F.col("i").alias("q"), F.col("seq").alias("probe")), s.where(F.length("seq") > (shortest or 0)).select(F.col("i").alias("t"), F.col("seq").alias("text")), least)
    pairs = inside.where("q <> t").select(F.col("q").alias("a"), F.col("t").alias("b")).unionByName(end_overlaps(s, least))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(s.select(F.col("i").alias("a"), F.col("seq").alias("_a")), "a").join(s.select(F.col("i").alias("b"), F.col("seq").alias("_b")), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
