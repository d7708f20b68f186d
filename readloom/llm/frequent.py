"""The most frequent values of a column, in three phases."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.cluster import write_table
from readloom.operators.skew import OVERSAMPLE, bounded_candidates, leaders, node_counts


def frequent_values(df: DataFrame, col: str, k: int, min_share: float = 0.0, chunk_rows: int = 200_000, broadcast_rows: int = 100_000) -> DataFrame:
    """(value, n_rows, at_least, at_most): the ``k`` most frequent values of a column among those held by at least ``min_share`` of all rows.

    Nodes are runs of at most ``chunk_rows`` rows of a partition: each holds the counts of its own values only, so its
    memory is bounded whatever the number of distinct values.
    1. Every node sends its k leaders; the k-th largest of their sums (or min_share of all rows, if that is more) is a
       lower bound tau for what a result can have.
    2. A value with tau of N rows holds at least tau/N of some node, so every node sends the values that hold at least
       an eighth of that share. The known counts and what a silent node may still hold bound each value from both
       sides (at_least, at_most, the approximate counts); values that can't reach tau are dropped. At most 8N/(7 tau) remain.
    3. Those are counted exactly over the whole column.

    Every value tied with the k-th is returned, so ties make more than k rows. Null is no value, but its rows count in
    the share; the empty string is a value. An empty table gives no rows.
    """
    src = df.select(F.col(col).cast("string").alias("value"))

    def phase1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, counts, n in node_counts(batches, chunk_rows):
            top = pc.top_k_unstable(counts, k=min(k, len(counts))) if len(counts) else pa.array([], pa.uint64())
            v, c = values.take(top), counts.take(top)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([v.cast(pa.string()), pa.nulls(1, pa.string())]), pa.concat_arrays([c.cast(pa.int64()), pa.array([n], pa.int64())])], ["value", "c"])

    first = write_table(src.mapInArrow(phase1, "value string, c long"), "topk-leaders")
    total = first.where("value is null").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    kth = first.where("value is not null").groupBy("value").agg(F.sum("c").alias("c")).orderBy(F.desc("c")).limit(k).agg(F.min("c"), F.count("c")).first()
    tau = max(1, -(-total * min_share // 1) if min_share else 1, kth[0] if kth[1] == k else 1)

    cands = write_table(bounded_candidates(leaders(src, "value", tau / max(total, 1), chunk_rows), total, tau), "topk-candidates")
    few = cands.count() <= broadcast_rows  # always so if tau is at least 8/7 of N/broadcast_rows; beyond it the join shuffles
    exact = (
        src.join(F.broadcast(cands.select(F.col("key").alias("value"))) if few else cands.select(F.col("key").alias("value")), "value", "left_semi")
        .groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))
    )
    exact = write_table(exact.where(F.col("n_rows") >= tau), "topk-exact")
    last = exact.orderBy(F.desc("n_rows")).limit(k).agg(F.min("n_rows")).first()[0]
    found = exact.where(F.col("n_rows") >= F.lit(last)) if last is not None else exact
    return found.join(cands.withColumnRenamed("key", "value"), "value").select("value", "n_rows", "at_least", F.floor("at_most").cast("long").alias("at_most"))


__all__ = ["OVERSAMPLE", "frequent_values"]
