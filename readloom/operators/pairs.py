"""Alignments as columns, and mates merged over their overlap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.cluster import spread
from readloom.functions.seq import reverse_complement
from readloom.kernels import align as A


def nw_align(a: Column, b: Column, **scores) -> Column:
    """struct(al0, al1): the best global alignment; null if either side is null. Empty sequences align with gaps only. Arguments as in ``kernels.align.align``."""

    @F.pandas_udf("struct<al0:string,al1:string>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        known = np.flatnonzero((x.notna() & y.notna()).to_numpy())
        out = [(None, None)] * len(x)
        for i, al in zip(known, A.align(x.iloc[known].tolist(), y.iloc[known].tolist(), **scores), strict=True):
            out[i] = al
        return pd.DataFrame(out, columns=["al0", "al1"])

    return run(a, b)


def pair_counts(a: Column, b: Column, **scores) -> Column:
    """struct(match, mismatch, indel) of the alignment, without the gaps at its ends."""

    @F.pandas_udf("struct<match:int,mismatch:int,indel:int>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        known = (x.notna() & y.notna()).to_numpy()
        counts = [A.evaluate(al) for al in A.align(x[known].tolist(), y[known].tolist(), **scores)]
        out = pd.DataFrame({c: pd.array([None] * len(x), "Int32") for c in ("match", "mismatch", "indel")})
        out.loc[known] = np.array(counts, np.int32).reshape(-1, 3)
        return out

    return run(a, b)


def nw_hamming(a: Column, b: Column, **scores) -> Column:
    """Mismatches and indels of the alignment, without the gaps at its ends."""
    c = pair_counts(a, b, **scores)
    return c["mismatch"] + c["indel"]


def gapless(a: Column, b: Column) -> Column:
    """struct(al0, al1) without inner gaps: the shorter one is filled up at its right."""
    n = F.greatest(F.length(a), F.length(b))
    return F.struct(F.rpad(a, n, "-").alias("al0"), F.rpad(b, n, "-").alias("al1"))


def merge_pairs(
    reads: DataFrame, min_overlap: int = 12, max_mismatch: int = 0, return_rejects: bool = False, just_concatenate: bool = False, trim_overhang: bool = False
) -> DataFrame:
    """Mates merged to whole sequences.

    reads: (sample, f, r, n0_f, n0_r), one row for each read pair: the sequences that its mates were corrected to, r as it was read,
    and how many reads were exactly those (n0 of the cluster). Pairs of which a mate wasn't corrected (null) drop out.
    Returns (sample, sequence, abundance, forward, reverse, nmatch, nmismatch, nindel, prefer, accept), one row for each
    (forward, reverse) of a sample.

    Only different pairs of sequences are aligned, each once for all samples. A pair is accepted if at least min_overlap
    letters match and at most max_mismatch letters differ or are missing; where letters differ, the side with more exact
    reads is taken. Pairs that aren't accepted have sequence '' and are dropped unless ``return_rejects``.
    just_concatenate: all are accepted and joined with ten N.
    """
    counted = reads.where("f is not null and r is not null").groupBy("sample", "f", "r").agg(F.count(F.lit(1)).alias("abundance"), F.max("n0_f").alias("n0_f"), F.max("n0_r").alias("n0_r"))
    out = _merged(counted, min_overlap, max_mismatch, just_concatenate, trim_overhang)
    out = out.select("sample", "sequence", "abundance", F.col("f").alias("forward"), F.col("r").alias("reverse"), "nmatch", "nmismatch", "nindel", "prefer", "accept")
    return out if return_rejects else out.where("accept")


def _merged(counted: DataFrame, min_overlap: int, max_mismatch: int, just_concatenate: bool, trim_overhang: bool) -> DataFrame:
    """counted (f, r, n0_f, n0_r, ...) with (sequence, nmatch, nmismatch, nindel, prefer, accept)."""
    counted = counted.withColumn("rc", reverse_complement(F.col("r")))
    if just_concatenate:
        none = F.lit(0)
        return counted.withColumns({"sequence": F.concat("f", F.lit("N" * 10), "rc"), "nmatch": none, "nmismatch": none, "nindel": none, "prefer": F.lit(None).cast("int"), "accept": F.lit(True)}).drop("rc")
    counted = counted.withColumn("prefer", F.when(F.col("n0_r") > F.col("n0_f"), 2).otherwise(1))
    bad = -64 if max_mismatch == 0 else -8

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            als = A.align(b.f.tolist(), b.rc.tolist(), 1, bad, bad)
            ev = [A.evaluate(x) for x in als]
            yield b[["f", "rc", "prefer"]].assign(nmatch=[e[0] for e in ev], nmismatch=[e[1] for e in ev], nindel=[e[2] for e in ev], merged=[A.consensus(x, p, trim_overhang) for x, p in zip(als, b.prefer, strict=True)])

    aligned = spread(counted.select("f", "rc", "prefer").distinct()).mapInPandas(run, "f string, rc string, prefer int, nmatch int, nmismatch int, nindel int, merged string")
    accept = (F.col("nmatch") >= min_overlap) & (F.col("nmismatch") + F.col("nindel") <= max_mismatch)
    out = counted.join(aligned, ["f", "rc", "prefer"]).withColumn("accept", accept)
    return out.withColumn("sequence", F.when(F.col("accept"), F.col("merged")).otherwise("")).drop("rc", "merged")


def cluster_pairs(fwd: DataFrame, fwd_map: DataFrame, rev: DataFrame, rev_map: DataFrame) -> DataFrame:
    """(sample, forward, reverse, abundance): how many read pairs have their mates in which clusters; null where a mate's sequence was corrected to none.

    fwd, rev: (sample, read_idx, seq); fwd_map, rev_map: (sample, seq, cluster), each sequence of a sample once. Read pairs
    are counted by their two sequences before these are looked up, so a sequence of most reads is looked up once a sample
    and mate. Reads without a mate at the same place drop out.
    """
    mates = fwd.select("sample", "read_idx", F.col("seq").alias("_f")).join(rev.select("sample", "read_idx", F.col("seq").alias("_r")), ["sample", "read_idx"])
    counted = mates.groupBy("sample", "_f", "_r").agg(F.count(F.lit(1)).alias("n"))
    for side, table in (("forward", fwd_map), ("reverse", rev_map)):
        counted = counted.join(table.select("sample", F.col("seq").alias(f"_{side[0]}"), F.col("cluster").alias(side)), ["sample", f"_{side[0]}"], "left")
    return counted.groupBy("sample", "forward", "reverse").agg(F.sum("n").alias("abundance"))


def merge_denoised(
    fwd: DataFrame, fwd_clusters: DataFrame, fwd_map: DataFrame, rev: DataFrame, rev_clusters: DataFrame, rev_map: DataFrame, min_overlap: int = 12, max_mismatch: int = 0, return_rejects: bool = False,
    propagate: Sequence[str] = (), just_concatenate: bool = False, trim_overhang: bool = False,
) -> DataFrame:
    """Read pairs merged after both mates were denoised on their own: read to unique sequence to cluster on either side, then as in ``merge_pairs``.

    fwd, rev: (sample, read_idx, seq), the reads that were denoised. clusters: (sample, cluster, sequence, n0, ...) and map:
    (sample, seq, cluster), as ``Denoised`` has them. Returns (sample, sequence, abundance, forward, reverse, nmatch,
    nmismatch, nindel, prefer, accept), forward and reverse being numbers of clusters, and F_x and R_x for every column x
    of the clusters in ``propagate`` (those that they don't have are passed over). prefer is null for pairs that are only
    concatenated. Pairs of which a mate is in no cluster drop out. Rows have no order; sort by abundance where one is needed.
    """
    counted = cluster_pairs(fwd, fwd_map, rev, rev_map).where("forward is not null and reverse is not null")
    carried = []
    for side, letter, table in (("forward", "f", fwd_clusters), ("reverse", "r", rev_clusters)):
        more = [c for c in propagate if c in table.columns]
        carried += [f"{letter.upper()}_{c}" for c in more]
        counted = counted.join(table.select("sample", F.col("cluster").alias(side), F.col("sequence").alias(letter), F.col("n0").alias(f"n0_{letter}"), *[F.col(c).alias(f"{letter.upper()}_{c}") for c in more]), ["sample", side])
    out = _merged(counted, min_overlap, max_mismatch, just_concatenate, trim_overhang)
    out = out.select("sample", "sequence", "abundance", "forward", "reverse", "nmatch", "nmismatch", "nindel", "prefer", "accept", *carried)
    return out if return_rejects else out.where("accept")


def same_order(a: DataFrame, b: DataFrame) -> DataFrame:
    """(same): are the names equal pair by pair? Null names are equal to each other."""
    return a.select("sample", "read_idx", F.col("id").alias("x")).join(b.select("sample", "read_idx", F.col("id").alias("y")), ["sample", "read_idx"], "full").agg(F.coalesce(F.bool_and(F.equal_null("x", "y")), F.lit(True)).alias("same"))


def extract_aligned(query: Column, ref: Column, **scores) -> Column:
    """The part of ref that lies under the query in their alignment."""
    al = nw_align(query, ref, **scores)
    q = al["al0"]
    begin = F.length(q) - F.length(F.ltrim(F.translate(q, "-", " "))) + 1
    return F.translate(F.substring(al["al1"], begin, F.length(F.trim(F.translate(q, "-", " ")))), "-", "")
