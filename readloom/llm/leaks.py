"""Test passages that stand in a training corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.windows import mix

WORD = re.compile(r"[^\W_]+")
#: Masks over 13 words; a 0 is a position that may differ. Each begins and ends with a 1, and each ignores other positions.
MASKS = ("1101011001101", "1011100110011", "1100110101101")
#: Words of test text handled in one pass over the corpus. A test set beyond that takes several passes.
BLOCK_WORDS = 2_000_000
#: A substitution costs as much as three equal words bring.
PENALTY = 3


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    if not text:
        return []
    if "İ" in text or "Σ" in text:  # the lower case of these depends on what surrounds them, or has a sign that is no letter
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


class Index:
    """The seeds of one block of test items."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...]):
        self.masks = [np.flatnonzero(np.array(list(m)) == "1") for m in masks]
        self.span = max(map(len, masks))
        self.vocabulary: dict[str, int] = {}
        self.ids, parts, at = [], [], 0
        self.begin: list[int] = []
        for item, text in items:
            w = np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in words(text)], np.int64)
            self.ids.append(item)
            self.begin.append(at)
            parts += [w, np.full(self.span, -1, np.int64)]
            at += len(w) + self.span
        self.begin.append(at)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.starts = np.array(self.begin)
        self.tables = []
        for m in range(len(self.masks)):
            h, pos = self.seeds(self.words, m)
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], pos[order]))

    def seeds(self, w: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes under mask m, where all its positions hold words of the vocabulary, and their places."""
        n = len(w) - self.span + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = w >= 0
        ok = np.ones(n, bool)
        for p in self.masks[m]:
            ok &= known[p : p + n]
        at = np.flatnonzero(ok)
        h = np.zeros(len(at), np.uint64)
        for p in self.masks[m]:
            h = mix(h * np.uint64(31) + w[at + p].astype(np.uint64) + np.uint64(1))
        return h, at

    def hits(self, w: np.ndarray) -> np.ndarray:
        """Distinct (item number, diagonal) pairs as two columns; a diagonal is the place in w less the place in the test words."""
        out = []
        for m, (table, pos) in enumerate(self.tables):
            h, at = self.seeds(w, m)
            if not len(h) or not len(table):
                continue
            lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            n = hi - lo
            keep = n > 0
            n, lo, at = n[keep], lo[keep], at[keep]
            which = pos[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            item = np.searchsorted(self.starts, which, "right") - 1
            out.append(np.stack([item, np.repeat(at, n) - which], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def longest_run(same: np.ndarray) -> int:
    """Length of the longest run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return int((edge[1::2] - edge[::2]).max()) if len(edge) else 0


def best_segment(same: np.ndarray) -> tuple[int, int]:
    """Words and substitutions of the segment with the highest score: 1 for an equal word, -PENALTY for another."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return end - start, int((~same[start:end]).sum())


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 13, masks: tuple[str, ...] = MASKS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, exact_words, overlap_words, substitutions) of every document that holds a passage of a test item.

    Spaced seeds: the words of a window of 13 at the fixed positions of a mask are hashed, and hashes of test items are
    joined with those of the corpus. Every hit names a diagonal, along which the whole item is compared with the
    document: exact_words is the longest run of equal words, and the overlap the segment that scores best when an equal
    word counts 1 and a substitution -3. A pair is returned if a diagonal has at least ``min_words`` equal words in its
    overlap; of several diagonals the best exact run and the best overlap count. Every verbatim passage of as many words
    as the masks are long is found; one with substitutions where a mask ignores them.

    The test side is broadcast in blocks of at most ``block_words`` words (its size is checked first); each block is a
    pass over the corpus, whose rows are never shuffled or collected. Documents are read whole.

    Null and empty texts hold nothing; an item shorter than the masks is never found; repeated rows are reported once
    for each document id. An empty table on either side gives no rows.
    """
    if min(map(len, masks)) > min_words:
        raise ValueError("a mask may not be longer than min_words")
    spark = docs.sparkSession
    tests = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    letters = tests.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n_blocks = int(max(1, -(-letters // (2 * block_words))))  # a word and what follows it take two letters at least
    schema = "doc_id long, item_id long, exact_words int, overlap_words int, substitutions int"
    source = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("x")).where("d is not null and x is not null")
    out = None
    for block in range(n_blocks):
        rows = tests.where(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == block).select("i", "t").distinct().collect()
        index = spark.sparkContext.broadcast(Index([(r.i, r.t) for r in rows], masks))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x = index.value
            get = x.vocabulary.get
            for b in batches:
                ids, found = b.column(0).to_numpy(), {}
                numbers: list[int] = []
                begin, gap = [], [-1] * x.span
                for t in b.column(1):
                    begin.append(len(numbers))
                    numbers.extend(map(get, words(t.as_py()), repeat(-1)))
                    numbers.extend(gap)
                at, w = len(numbers), np.array(numbers, np.int64)
                begin = np.append(np.array(begin, np.int64), at)
                for item, diagonal in x.hits(w):
                    lo, hi = x.starts[item], x.starts[item + 1] - x.span
                    # the part of the diagonal within the document in which the hit lies: documents are apart by more than a mask
                    a, z = max(lo + diagonal, 0), min(hi + diagonal, at)
                    for doc in range(np.searchsorted(begin, a, "right") - 1, np.searchsorted(begin, z, "left")):
                        p, q = max(a, begin[doc]), min(z, begin[doc + 1] - x.span)
                        if q - p < min_words:
                            continue
                        same = w[p:q] == x.words[p - diagonal : q - diagonal]
                        n, subst = best_segment(same)
                        if n - subst < min_words:
                            continue
                        key = (int(ids[doc]), x.ids[item])
                        old = found.get(key, (0, 0, 0))
                        best = max(((n, subst), old[1:]), key=lambda s: (s[0] - PENALTY * s[1], s))
                        found[key] = (max(longest_run(same), old[0]), *best)
                if found:
                    cols = list(zip(*((*k, *v) for k, v in found.items()), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])], ["doc_id", "item_id", "exact_words", "overlap_words", "substitutions"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("exact_words").alias("exact_words"), F.max_by(F.struct("overlap_words", "substitutions"), F.struct(F.col("overlap_words") - PENALTY * F.col("substitutions"), F.col("overlap_words"))).alias("o")).select("doc_id", "item_id", "exact_words", "o.overlap_words", "o.substitutions")
