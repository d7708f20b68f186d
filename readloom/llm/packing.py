"""Fixed windows filled with whole texts."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.cluster import write_table

TOKENIZERS = "/opt/tokenizers"


def token_counts(df: DataFrame, id_col: str, text: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """(id, n_tokens): tokens of each text under a byte-level BPE vocabulary given by its path on the driver. Special tokens' strings are ordinary text. Null and empty texts have 0."""

    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*vocabulary.value)
        for b in batches:
            n = [len(encoder.encode_ordinary(t.as_py() or "")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n_tokens long")


def read_vocabulary(path: str, pattern: str | None = None) -> tuple[bytes, str]:
    """The vocabulary file (a few MB, whatever the collection) and the pattern by which texts are cut before (that of the public vocabularies unless given). Read on the driver and sent with the job, so executors need no such file."""
    with open(path, "rb") as f:
        return f.read(), pattern or importlib.import_module("public_tokenizers").PATTERN


_ENCODERS: dict = {}


def _encoder(ranks: bytes, pattern: str):
    key = hash((ranks, pattern))
    if key not in _ENCODERS:
        import base64

        import tiktoken

        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    return _ENCODERS[key]


def fill(counts: dict[int, int], capacity: int) -> list[int]:
    """The multiset of lengths (at most ``counts`` of each) that begins with the longest and comes closest to ``capacity`` from below.

    Subset sums as one integer's bits: adding a length shifts them. A length that occurs n times is added in groups of
    1, 2, 4, ... copies. The bits after each step are kept and walked back to see how many copies of which length were used.
    """
    first = max(counts)
    room, chosen = capacity - first, [first]
    mask, bits = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        group = 1
        while left > 0:
            group = min(group, left)
            steps.append((bits, length, group))
            bits |= (bits << (length * group)) & mask
            left -= group
            group *= 2
        if bits >> room:
            break
    at = bits.bit_length() - 1
    for before, length, group in reversed(steps):
        if not before >> at & 1:
            at -= length * group
            chosen += [length] * group
    return chosen


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Windows for ``counts`` items of each length: (how many windows, [(length, items of it in each window)]).

    Minimum bin slack: the best filling is sought for one window and used for as many windows as the items allow. Each
    such filling uses up some length, so there are about as many kinds of windows as lengths, however many items.
    """
    left, out = dict(counts), []
    while left:
        chosen = fill(left, capacity)
        need: dict[int, int] = {}
        for length in chosen:
            need[length] = need.get(length, 0) + 1
        times = min(left[length] // n for length, n in need.items())
        out.append((times, sorted(need.items(), reverse=True)))
        for length, n in need.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return out


def pack_windows(sizes: DataFrame, capacity: int) -> DataFrame:
    """sizes: (id, n_tokens). Returns (id, piece, token_from, n_tokens, window_id, window_from): which part of each text lies where in which window of ``capacity`` tokens.

    Only a text longer than a window is cut: into full windows and a rest, which is packed like any text. All rests and
    texts are counted by length, which makes at most ``capacity`` numbers whatever the size of the collection; on these
    the windows are planned (``plan_windows``). Then the k-th text of a length goes to the place that the plan gives to
    the k-th item of that length. The k is a count within each partition plus the counts of the partitions before, so a
    length that most texts have is no task of its own.

    A text of 0 tokens needs no window: its only piece has window_id null. Null sizes count as 0. Texts with the same id
    are packed each by itself. An empty table gives no rows.
    """
    spark = sizes.sparkSession
    start = sizes.select("id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rest of each text, numbered among those of its length within the partition; and how many full windows it takes, numbered likewise (as length 0)."""
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            n = b.column(1).to_numpy()
            rest = n % capacity
            order = np.argsort(rest, kind="stable")
            r = rest[order]
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(r)) - np.searchsorted(r, r) + seen[r]
            full = n // capacity
            before = np.cumsum(full) - full + seen[capacity]
            seen[capacity] += full.sum()
            seen[: capacity + 1] += np.bincount(rest, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rest), pa.array(rank), pa.array(full), pa.array(before), pa.array(np.full(len(n), part, np.int32))], ["id", "n", "rest", "rank", "full", "before", "part"])

    rows = write_table(start.mapInArrow(number, "id long, n long, rest long, rank long, full long, before long, part int"), "numbered")
    # Counts by partition and length: at most capacity rows of a partition.
    by_part = write_table(
        rows.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("c")).unionByName(rows.groupBy("part").agg(F.sum("full").alias("c")).select("part", F.lit(capacity).cast("long").alias("rest"), "c")), "counts-by-part"
    )
    totals = {r.rest: r.c for r in by_part.groupBy("rest").agg(F.sum("c").alias("c")).collect()}  # at most capacity + 1 rows
    full_windows = totals.pop(capacity, 0) or 0
    totals.pop(0, None)
    plan = plan_windows(totals, capacity)
    given: dict[int, int] = {}
    table, window = [], full_windows
    for times, items in plan:
        at = 0
        for length, n in items:
            first = given.get(length, 0)
            table.append((length, first, first + n * times, n, window, at))
            given[length] = first + n * times
            at += length * n
        window += times
    # The ranges of all lengths in order; their number depends on capacity alone.
    table.sort()
    plan_of = spark.sparkContext.broadcast(np.array(table, np.int64).reshape(-1, 6).T)
    # One row for each partition in fulls.
    offsets = by_part.select("part", "rest", (F.sum("c").over(Window.partitionBy("rest").orderBy("part")) - F.col("c")).alias("offset"))
    own = offsets.where(F.col("rest") < capacity)
    fulls = offsets.where(F.col("rest") == capacity).select("part", F.col("offset").alias("full_offset"))
    placed = rows.join(own, ["part", "rest"]).join(F.broadcast(fulls), "part").select("id", "rest", "full", (F.col("before") + F.col("full_offset")).alias("before"), (F.col("rank") + F.col("offset")).alias("k"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The window of the k-th text of each length and where in it it begins, by a search among the ranges; null for length 0."""
        length, first, last, per, w0, start = plan_of.value
        # all items in order of length and number: those of shorter lengths come before
        ends = np.flatnonzero(np.diff(np.append(length, -1)))
        base = np.zeros(capacity + 1, np.int64)
        base[length[ends]] = last[ends]
        base = np.cumsum(base) - base
        keys = base[length] + first
        for b in batches:
            rest, k = b.column(1).to_numpy(), b.column(4).to_numpy()
            window, begin, known = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64), rest > 0
            r, n = rest[known], k[known]
            at = np.searchsorted(keys, base[r] + n, "right") - 1
            step = n - first[at]
            window[known], begin[known] = w0[at] + step // per[at], start[at] + step % per[at] * r
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(window, mask=~known), pa.array(begin, mask=~known)], ["id", "rest", "full", "before", "window", "begin"])

    placed = placed.mapInArrow(place, "id long, rest long, full long, before long, window long, begin long")
    rest_piece = F.struct(F.col("full").cast("int").alias("piece"), (F.col("full") * capacity).alias("token_from"), F.col("rest").alias("n_tokens"), F.col("window").alias("window_id"), F.col("begin").alias("window_from"))
    full_pieces = F.transform(F.when(F.col("full") > 0, F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).otherwise(F.array().cast("array<long>")), lambda i: F.struct(i.cast("int").alias("piece"), (i * capacity).alias("token_from"), F.lit(capacity).cast("long").alias("n_tokens"), (F.col("before") + i).alias("window_id"), F.lit(0).cast("long").alias("window_from")))
    pieces = F.when((F.col("rest") > 0) | (F.col("full") == 0), F.concat(full_pieces, F.array(rest_piece))).otherwise(full_pieces)
    return placed.select("id", F.explode(pieces).alias("p")).select("id", "p.piece", "p.token_from", "p.n_tokens", "p.window_id", "p.window_from")
