"""Connected groups of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.cluster import write_table
from readloom.operators.skew import skew_join


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node that has an edge, the smallest node it is connected with.

    Each round turns the edges into links from a node to the smallest node near it: first every node's larger neighbours
    are linked to its smallest one, then every node and its smaller neighbours to the smallest of them, until nothing
    changes. A round halves the length of chains at least; it is written to the shared folder and only its checksum comes
    to the driver. The neighbours of a node are never gathered: their minimum is an aggregate that is joined back, and a
    node with many neighbours doesn't make a long task. Null ends and loops are ignored.
    """
    now = write_table(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "v > u")
        small = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), None)
        now = write_table(small.where("u <> v").distinct(), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _star(links: DataFrame, keep: str | None) -> DataFrame:
    """Link each neighbour v of u (those that ``keep`` selects), and u itself if all are kept, to the smallest of u and its neighbours."""
    links = write_table(links, "star")
    least = write_table(links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    total = links.count()
    joined = skew_join(links, least, ["u"], "n", total, F.col("v"))
    out = (joined.where(keep) if keep else joined).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out if keep else out.unionByName(least.select("u", F.col("m").alias("v")))
