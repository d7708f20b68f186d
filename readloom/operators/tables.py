"""Whatever holds sequences as one kind of table, and checks of results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.kernels.poisson import tail

#: Column names under which tables of this library hold sequences and their numbers, the first that is there counts.
SEQUENCE, NUMBER = ("seq", "sequence", "uniques"), ("abundance", "n", "count")


def _first(df: DataFrame, names: tuple[str, ...], what: str) -> str:
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        raise ValueError(f"no column of {what} among {df.columns}")
    return found


def as_sequences(df: DataFrame) -> DataFrame:
    """(seq) in upper case, each row of df that has one."""
    return df.select(F.upper(_first(df, SEQUENCE, "sequences")).alias("seq")).where("seq is not null")


def as_uniques(df: DataFrame, by: str | None = None) -> DataFrame:
    """(by, seq, abundance): equal sequences added up. Rows of reads, which have no number, count 1; null numbers count 0; accepted is taken for true where a table of merged pairs has it."""
    if "accept" in df.columns:
        df = df.where("accept")
    n = next((c for c in NUMBER if c in df.columns), None)
    value = F.coalesce(F.col(n).cast("long"), F.lit(0)) if n else F.lit(1).cast("long")
    seq = F.upper(_first(df, SEQUENCE, "sequences"))
    keys = [by] if by else []
    return df.select(*keys, seq.alias("seq"), value.alias("v")).where("length(seq) > 0").groupBy(*keys, "seq").agg(F.sum("v").alias("abundance"))


def abundance(df: DataFrame) -> DataFrame:
    """(total, n_sequences)"""
    return as_uniques(df).agg(F.coalesce(F.sum("abundance"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n_sequences"))


def is_sequence_table(df: DataFrame) -> bool:
    """Has (sample, seq, abundance) with names that aren't empty and no negative number."""
    if not {"sample", "seq", "abundance"} <= set(df.columns):
        return False
    bad = (F.coalesce(F.length("sample"), F.lit(0)) == 0) | (F.coalesce(F.length("seq"), F.lit(0)) == 0) | (F.coalesce(F.col("abundance"), F.lit(-1)) < 0)
    return df.where(bad).isEmpty()


def births_at(clusters: DataFrame, births: DataFrame, ham: int = 1) -> DataFrame:
    """Substitutions of the clusters that were born at a given distance. clusters: (sample, cluster, birth_ham, ...); births: (sample, pos, ..., clust)."""
    return births.join(clusters.where(F.col("birth_ham") == ham).select("sample", F.col("cluster").alias("clust")), ["sample", "clust"], "left_semi")


def bad_positions(clusters: DataFrame, births: DataFrame, omega: float = 1e-20, least: int = 4) -> DataFrame:
    """(sample, pos, n): places that gave at least ``least`` clusters one letter away, and far more than a place does by chance (Poisson, with all places of the sample's sequences alike; corrected for their number)."""
    size = clusters.groupBy("sample").agg(F.max(F.length("sequence")).alias("len"), F.count_if(F.col("birth_ham") == 1).alias("ones"))
    per = births_at(clusters, births).groupBy("sample", "pos").agg(F.count(F.lit(1)).alias("n")).join(size, "sample")

    @F.pandas_udf("double")
    def above(n: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series(tail(n.to_numpy() + 1, mean.to_numpy()))

    return per.withColumn("p", above(F.col("n"), F.col("ones") / F.col("len")) * F.col("len")).where((F.col("p") < omega) & (F.col("n") >= least)).select("sample", "pos", "n")


def from_bad_positions(clusters: DataFrame, births: DataFrame, least_share: float = 0.51, omega: float = 1e-10, least: int = 4) -> DataFrame:
    """(sample, cluster, false_positive): most of the substitutions that a cluster was born with are at bad positions."""
    bad = bad_positions(clusters, births, omega, least).select("sample", "pos", F.lit(1).alias("_b"))
    share = births.join(bad, ["sample", "pos"], "left").groupBy("sample", F.col("clust").alias("cluster")).agg(F.avg(F.coalesce("_b", F.lit(0))).alias("_s"))
    return clusters.select("sample", "cluster").join(share, ["sample", "cluster"], "left").select("sample", "cluster", F.coalesce(F.col("_s") >= least_share, F.lit(False)).alias("false_positive"))
