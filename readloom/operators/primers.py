"""Primers found and cut off."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.seq import CODES, COMPLEMENTS, reverse_complement

#: What the letters of a primer stand for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "K": "GT", "M": "AC", "B": "CGT", "V": "ACG", "D": "AGT", "H": "ACT", "S": "CG", "W": "AT", "N": "ACGT"}


def _sets(primer: str) -> np.ndarray:
    """For each letter of a primer and each byte, is it among the letters meant? A read's N is only met by N."""
    out = np.zeros((len(primer), 256), bool)
    for i, c in enumerate(primer):
        out[i, [ord(x) for x in IUPAC[c] + ("N" if c == "N" else "")]] = True
    return out


def find_primers(seqs: list[str], sets: np.ndarray, most: int, indels: bool) -> list[list[tuple[int, int]]]:
    """For each sequence (start, end) of every place, from 1, where the primer lies with at most ``most`` differences. With indels each place where a match ends counts, with its latest start of the least cost. All sequences at once: a step of the search is one over all of them."""
    k, n = len(sets), np.array([len(s) for s in seqs])
    width = int(n.max(initial=0))
    b = np.zeros((len(seqs), width), np.uint8)
    for i, s in enumerate(seqs):
        b[i, : len(s)] = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
    out: list[list[tuple[int, int]]] = [[] for _ in seqs]
    if not indels:
        if width < k:
            return out
        wrong = np.zeros((len(seqs), width - k + 1), np.int16)
        for i in range(k):
            wrong += ~sets[i, b[:, i : i + width - k + 1]]
        for row, at in np.argwhere((wrong <= most) & (np.arange(width - k + 1) <= (n - k)[:, None])):
            out[row].append((int(at) + 1, int(at) + k))
        return out
    # cost of the best match of the first i letters that ends here, and where it starts; of equal costs the latest start
    cost = np.repeat(np.arange(k + 1)[None], len(seqs), 0)
    start = np.zeros((len(seqs), k + 1), np.int64)
    big = width + 2  # cost and start in one number: the less the better
    for j in range(1, width + 1):
        old = cost * big - start
        new = np.empty_like(old)
        new[:, 0] = -j
        hit = sets[:, b[:, j - 1]].T
        step = np.minimum(old[:, :-1] + np.where(hit, 0, big), old[:, 1:] + big)
        for i in range(1, k + 1):
            new[:, i] = np.minimum(step[:, i - 1], new[:, i - 1] + big)
        cost = -(-new // big)
        start = cost * big - new
        for row in np.flatnonzero((cost[:, k] <= most) & (j <= n)):
            out[row].append((int(start[row, k]) + 1, j))
    return out


def find_primer(seq: str, sets: np.ndarray, most: int, indels: bool) -> list[tuple[int, int]]:
    """``find_primers`` of one sequence."""
    return find_primers([seq], sets, most, indels)[0]


def primer_span(seq: Column, fwd: str, rev: str | None = None, max_mismatch: int = 2, allow_indels: bool = False, trim_fwd: bool = True, trim_rev: bool = True, orient: bool = True) -> Column:
    """struct(start, end, is_rc): the part of the read, or of its reverse complement, between the first place of the forward primer and the last of the reverse one (given as it reads on the forward strand). Null without the primers, or if at most one letter is left."""
    f = _sets(fwd)
    r = _sets(rev) if rev else None

    @F.pandas_udf("struct<start:int,end:int,is_rc:boolean>")
    def run(x: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = [(None, None, None)] * len(x)
        open_ = [i for i, s in enumerate(x) if s]
        for is_rc in (False, True)[: 1 + orient]:
            texts = [x.iloc[i][::-1].translate(str.maketrans(CODES, COMPLEMENTS)) if is_rc else x.iloc[i] for i in open_]
            hits = find_primers(texts, f, max_mismatch, allow_indels)
            ends = find_primers(texts, r, max_mismatch, allow_indels) if r is not None else [None] * len(texts)
            for i, t, h, e in zip(open_, texts, hits, ends, strict=True):
                if h and (e is None or e):
                    first = h[0][1] + 1 if trim_fwd else 1
                    last = e[-1][0] - 1 if e and trim_rev else len(t)
                    if last > first:
                        rows[i] = (first, last, is_rc)
            open_ = [i for i, h in zip(open_, hits, strict=True) if not h]  # the orientation that has the forward primer decides
        out = pd.DataFrame(rows, columns=["start", "end", "is_rc"], dtype=object)
        return out.astype({"start": "Int32", "end": "Int32", "is_rc": "boolean"})

    return run(seq)


def remove_primers(reads: DataFrame, fwd: str, rev: str | None = None, seq: str = "seq", qual: str = "qual", **how) -> DataFrame:
    """Reads that have the primers, without them, in the forward orientation. Reads with a null sequence drop out. Arguments as in primer_span."""
    out = reads.withColumn("_s", primer_span(F.col(seq), fwd, rev, **how)).where("_s.start is not null")
    turned = lambda c, f: F.when(F.col("_s.is_rc"), f(F.col(c))).otherwise(F.col(c))
    n = F.col("_s.end") - F.col("_s.start") + 1
    return out.withColumns({seq: F.substring(turned(seq, reverse_complement), F.col("_s.start"), n), qual: F.slice(turned(qual, F.reverse), F.col("_s.start"), n)}).drop("_s")
