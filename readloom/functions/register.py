"""Functions for SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from readloom.functions.seq import filled
from readloom.kernels import align as A
from readloom.kernels import words
from readloom.kernels.poisson import tail
from readloom.operators.qc import ring
from readloom.sources.fasta import register as register_sources


def register(spark: SparkSession, genome: str | None = None) -> None:
    """nw_align, nw_hamming, rc, kmer_dist, seq_complexity, pois_sf as SQL functions, is_phix where the contaminant's genome is given (its letters, see ``qc.read_genome``), kmers as a table function, and the sources fasta and fastq. Null arguments give null."""

    def over(a: pd.Series, b: pd.Series):
        known = (a.notna() & b.notna()).to_numpy()
        return known, A.align(a[known].tolist(), b[known].tolist())

    @F.pandas_udf("struct<al0:string,al1:string>")
    def nw_align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known, als = over(a, b)
        out = np.full((len(a), 2), None, object)
        out[known] = np.array(als, object).reshape(-1, 2)
        return pd.DataFrame(out, columns=["al0", "al1"])

    @F.pandas_udf("int")
    def nw_hamming(a: pd.Series, b: pd.Series) -> pd.Series:
        known, als = over(a, b)
        return filled(known, [sum(A.evaluate(x)[1:]) for x in als], "Int32")

    @F.pandas_udf("double")
    def seq_complexity(a: pd.Series) -> pd.Series:
        known = a.notna().to_numpy()
        return filled(known, words.complexities(a[known].tolist(), 2, None, 5), "float64")

    @F.pandas_udf("double")
    def kmer_dist(a: pd.Series, b: pd.Series) -> pd.Series:
        n = np.minimum(a.str.len(), b.str.len()) - 4
        known = (n > 0).to_numpy()
        return filled(known, 1 - words.shared_counts(a[known].tolist(), b[known].tolist(), 5) / n[known].to_numpy(), "float64")

    @F.pandas_udf("double")
    def pois_sf(k: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series(tail(k.to_numpy(), mean.to_numpy()))

    for f in (nw_align, nw_hamming, seq_complexity, kmer_dist, pois_sf):
        spark.udf.register(f.__name__, f)
    spark.sql("create or replace temporary function rc(s string) returns string return reverse(translate(s, 'ACGTRYKMBVDHSWN', 'TGCAYRMKVBHDSWN'))")

    spark.sql("create or replace temporary function kmers(s string, k int) returns table (pos int, kmer string) return select p + 1, w from (select posexplode(case when length(s) >= k then transform(sequence(1, length(s) - k + 1), i -> substring(s, i, k)) else array() end) as (p, w))")
    if genome is not None:
        forward, back = (words.Known(ring(g, 16), 16) for g in (genome, genome[::-1].translate(str.maketrans("ACGT", "TGCA"))))

        @F.pandas_udf("boolean")
        def is_phix(a: pd.Series) -> pd.Series:
            known = a.notna().to_numpy()
            seqs = a[known].tolist()
            return filled(known, (forward.hits(seqs, True) >= 2) | (back.hits(seqs, True) >= 2), "boolean")

        spark.udf.register("is_phix", is_phix)
    register_sources(spark)
