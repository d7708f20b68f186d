"""No key below the heavy share makes a long task: rows are combined before every shuffle and none is sent by key alone uncombined."""

import random
import re

from pyspark.sql import functions as F

from readloom.operators import skew
from readloom.operators.components import connected_components

from .conftest import rows


def test_share_follows_the_number_of_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, want in ((4, 0.002), (250, 0.002), (1000, 0.0005), (10_000, 0.00005)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert skew.heavy_share(spark, 0.002) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_rows_are_combined_before_every_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("a"), (F.col("id") % 3).alias("m"))
    plan = skew.salted_aggregate(df, "k", "a", "m")._jdf.queryExecution().sparkPlan().toString() + skew.salted_aggregate(df, "k", "a", "m")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan and len(re.findall("partial_", plan)) >= 5


def test_a_key_just_below_the_share(spark):
    """The rows of such a key lie in many partitions after the first stage, one for each of its members at most."""
    rng = random.Random(1)
    share = 0.05
    data = [("near", rng.randint(0, 5), f"m{rng.randint(0, 99)}") for _ in range(480)] + [(f"k{rng.randint(0, 5000)}", 1, "m0") for _ in range(9520)]
    df = spark.createDataFrame(data, "k string, a long, m string").repartition(8)
    got = {r.key: (r.n_rows, r.total, r.n_members) for r in skew.salted_aggregate(df, "k", "a", "m", share).collect()}
    want = {}
    for k, a, m in data:
        n, s, who = want.get(k, (0, 0, set()))
        want[k] = (n + 1, s + a, who | {m})
    assert got == {k: (n, s, len(w)) for k, (n, s, w) in want.items()}
    parts = df.where("k = 'near'").groupBy("k", "m").count().select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert parts.count() == 1 or parts.agg(F.max("count")).first()[0] <= 60


def test_components_of_a_hub_and_of_a_chain(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, None), (7, 7)]
    out = dict(connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect())
    assert {out[i] for i in range(200)} == {0} and {out[1000 + i] for i in range(41)} == {1000}
    assert rows(connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "x string, y string"), "x", "y")) == [("a", "a"), ("b", "a"), ("c", "a")]
