"""Aggregations and joins in which a few keys may hold most rows.

Heavy keys are found without a shuffle of the data. A *node* is a run of at most ``chunk_rows`` rows of one
partition. If a key holds a share s of all rows, then it holds at least s of the rows of some node, and every node has
at most 1/s such keys; so each node names its leaders and only those are added up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A node reports values down to this part of the share asked for, so that what it leaves out can be bounded.
OVERSAMPLE = 8


def node_counts(batches: Iterator[pa.RecordBatch], chunk_rows: int) -> Iterator[tuple[pa.Array, pa.Array, int]]:
    """Per node the distinct non-null values of the first column, their counts and the number of all its rows."""
    held: list[pa.Array] = []
    n = 0

    def flush() -> tuple[pa.Array, pa.Array, int]:
        counted = pc.value_counts(pa.chunked_array(held))
        values, counts = counted.field("values"), counted.field("counts")
        known = pc.is_valid(values)
        return values.filter(known), counts.filter(known), n

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.column(0).slice(at, chunk_rows - n)
            held.append(part)
            n += len(part)
            at += len(part)
            if n >= chunk_rows:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def leaders(df: DataFrame, key: str, share: float, chunk_rows: int = 200_000) -> DataFrame:
    """(key, c, n): per node of n rows its values held by at least ``share / OVERSAMPLE`` of them, and a row with a null key for the node itself."""
    source = df.select(F.col(key).cast("string").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, counts, n in node_counts(batches, chunk_rows):
            top = pc.greater_equal(counts, pa.scalar(max(1, -(-n * share // OVERSAMPLE)), pa.float64()))
            v, c = values.filter(top), counts.filter(top)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([v.cast(pa.string()), pa.nulls(1, pa.string())]), pa.concat_arrays([c.cast(pa.int64()), pa.array([0], pa.int64())]), pa.array([n] * (len(v) + 1), pa.int64())], ["key", "c", "n"])

    return source.mapInArrow(run, "key string, c long, n long")


def bounded_candidates(nodes: DataFrame, total: int, least: float) -> DataFrame:
    """From ``leaders`` taken at share least/total, the keys that may hold ``least`` rows: (key, at_least, at_most).

    A node that didn't name a key holds fewer than its share / OVERSAMPLE of it. What remains holds 7/8 of least by
    the counts already known, so there are at most 8 * total / (7 * least) of them, however many rows there are.
    """
    share = least / max(total, 1)
    return (
        nodes.where("key is not null").groupBy("key").agg(F.sum("c").alias("at_least"), F.sum("n").alias("seen"))
        .select("key", "at_least", (F.col("at_least") + F.lit(share / OVERSAMPLE) * (F.lit(total) - F.col("seen"))).alias("at_most"))
        .where(F.col("at_most") >= least)
    )


def heavy_keys(df: DataFrame, key: str, share: float) -> tuple[DataFrame, int]:
    """Candidates for keys holding at least ``share`` of df's rows (a superset, at most 8/(7*share) of them), and the number of rows.

    The returned table is held in the driver's plan as literal rows: its size is bounded by the share alone.
    """
    from readloom.cluster import write_table

    nodes = write_table(leaders(df, key, share), "leaders")
    total = nodes.where("key is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = bounded_candidates(nodes, total, share * total).select("key").collect() if total else []
    return df.sparkSession.createDataFrame([(r[0],) for r in rows], "key string"), total


def heavy_share(spark: SparkSession, most: float) -> float:
    """The share of all rows from which a key is heavy: ``most``, or half of what a shuffle partition holds on average if that is less. So no key below it makes a task long, and at most 16/7 keys for each shuffle partition lie above it."""
    return min(most, 1 / (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def skew_join(rows: DataFrame, groups: DataFrame, on: Sequence[str], size: str, total: int, row_id: Column, share: float = 0.001) -> DataFrame:
    """Inner join of rows to groups (one row for each key; ``size`` says how many rows it has) in which no key makes a long task.

    Groups with at least ``share`` of all rows (less where there are more than 500 shuffle partitions, see
    ``heavy_share``) are at most 1/share and are broadcast. Their rows still pass the shuffle of the other groups, but
    spread by ``row_id`` under a key that has no match there. Null keys match nothing.
    """
    share = heavy_share(rows.sparkSession, share)
    values = [c for c in groups.columns if c not in on]
    heavy = groups.where(F.col(size) >= max(share * total, 2)).select(*[F.col(c).alias(f"_h_{c}") for c in groups.columns])
    light = groups.where(F.col(size) < max(share * total, 2)).select(*[F.col(c).alias(f"_l_{c}") for c in groups.columns])
    if total >= 2:
        rows = rows.join(F.broadcast(heavy), [F.col(c) == F.col(f"_h_{c}") for c in on], "left")
    else:
        rows = rows.withColumns({f"_h_{c}": F.lit(None).cast(groups.schema[c].dataType) for c in groups.columns})
    hot = F.col(f"_h_{size}").isNotNull()
    spread = F.when(hot, F.xxhash64(row_id)).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("_salt", spread)
    light = light.withColumn("_l_salt", F.lit(0).cast("long"))
    joined = rows.join(light, [F.col(c) == F.col(f"_l_{c}") for c in on] + [F.col("_salt") == F.col("_l_salt")], "left")
    kept = joined.where(hot | F.col(f"_l_{size}").isNotNull())
    keep = [c for c in rows.columns if not c.startswith(("_h_", "_salt"))]
    return kept.select(*keep, *[F.coalesce(F.col(f"_h_{c}"), F.col(f"_l_{c}")).alias(c) for c in values])


def salted_aggregate(df: DataFrame, key: str, amount: str, member: str, share: float = 0.002, salts: int = 64, heavy: DataFrame | None = None) -> DataFrame:
    """(key, n_rows, total, n_members): rows, sum of ``amount`` and distinct ``member`` values of every key, in balanced time.

    Two stages for heavy keys (at least ``heavy_share`` of all rows): partial results for each (key, member, salt), where
    the salt is a hash of the row, then merged by key. The salt is a function of the row and not random, so a task that
    is run again sends its rows to the same place. Light keys need no salt. All stages combine on the map side, and rows
    are shuffled by key and member, so even a key just below the share is spread over tasks.

    heavy: the candidates from ``heavy_keys`` where the caller has them already.

    Null keys are no key and are left out; null amounts add nothing (a key with only null amounts has total 0); null
    members aren't counted. Repeated rows count each time. An empty table gives no rows.
    """
    src = key_columns(df, key, amount, member)
    if heavy is None:
        heavy, _ = heavy_keys(src, "key", heavy_share(df.sparkSession, share))
    src = src.where("key is not null")
    sums = [F.sum("n").alias("n"), F.sum("s").alias("s")]
    first = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).alias("s")]
    salted = (
        src.join(F.broadcast(heavy), "key", "left_semi")
        .withColumn("salt", F.pmod(F.xxhash64("member", "amount"), F.lit(salts)).cast("int"))
        .groupBy("key", "member", "salt").agg(*first).groupBy("key", "member").agg(*sums)
    )
    plain = src.join(F.broadcast(heavy), "key", "left_anti").groupBy("key", "member").agg(*first)
    finish = lambda x: x.groupBy("key").agg(F.sum("n").alias("n_rows"), F.sum("s").alias("total"), F.count("member").alias("n_members"))
    return finish(salted).unionByName(finish(plain))


def key_columns(df: DataFrame, key: str, amount: str, member: str) -> DataFrame:
    """(key, amount, member) as text, number and text, whatever df calls them."""
    return df.select(F.col(key).cast("string").alias("key"), F.col(amount).cast("long").alias("amount"), F.col(member).cast("string").alias("member"))
