"""Quality control and unique sequences over a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.qc import Filter, filter_reads


def filter_stream(reads: DataFrame, f: Filter) -> DataFrame:
    """Stages of quality control on a stream: no state."""
    return filter_reads(reads, f)


def unique_reads(reads: DataFrame, key: str = "read_idx", time: str = "sequenced_at", late: str = "30 days") -> DataFrame:
    """Each read once although it is delivered again, within ``late`` of the latest time seen; older state is dropped. A read without a time is passed on each time."""
    return reads.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def dereplicate_stream(reads: DataFrame) -> DataFrame:
    """(sample, seq, abundance), growing with the stream: for output mode complete or update. The same counts as a batch over all reads so far."""
    return reads.where(F.length("seq") > 0).groupBy("sample", "seq").agg(F.count(F.lit(1)).alias("abundance"))


def pair_streams(fwd: DataFrame, rev: DataFrame, time: str = "sequenced_at", late: str = "1 hour") -> DataFrame:
    """Mates of two streams by read name, whichever comes first; a mate waits for ``late`` at most."""
    a = fwd.withWatermark(time, late).select("sample", "id", F.col("seq").alias("f"), F.col("qual").alias("fq"), F.col(time).alias("ft"))
    b = rev.withWatermark(time, late).select(F.col("sample").alias("s2"), F.col("id").alias("id2"), F.col("seq").alias("r"), F.col("qual").alias("rq"), F.col(time).alias("rt"))
    near = F.expr(f"ft >= rt - interval {late} and ft <= rt + interval {late}")
    return a.join(b, (a.id == b.id2) & (a["sample"] == b.s2) & near).select("sample", "id", "f", "fq", "r", "rq")
