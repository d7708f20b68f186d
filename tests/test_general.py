"""Packed fields, uneven keys and shared tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from readloom.operators.packed import split_packed
from readloom.operators.skew import heavy_keys, salted_aggregate, skew_join

from .conftest import rows

CASES = {
    "a;b;c": ["a", "b", "c"],
    " a ; b|c\t": ["a", "b", "c", ""],
    "a;;b;": ["a", "", "b", ""],
    '"x; y";z': ["x; y", "z"],
    "'x, y' > \"z\"": ["x, y", "z"],
    '"the ""old"" one";b': ['the "old" one', "b"],
    "'it''s';b": ["it's", "b"],
    '"it\'s; so";b': ["it's; so", "b"],
    'a "b" c;d': ["a", "b", "c", "d"],
    '"never closed; x': ["never closed; x"],
    '"" ; b': ["", "b"],
    '" padded "': ["padded"],
    "k__A; p__[B] (c)-1.2/3_x": ["k__A", "p__[B] (c)-1.2/3_x"],
    "": [""],
    "Ünï;ß": ["Ünï", "ß"],
}


@pytest.mark.parametrize("field", CASES)
def test_split(spark, field):
    df = spark.createDataFrame([(1, field)], "id long, f string")
    assert rows(split_packed(df, "id", "f")) == sorted(((1, i, v) for i, v in enumerate(CASES[field], 1) if v), key=repr)


def test_split_edges(spark):
    long = ";".join(f"v{i}" if i % 2 else f'"q;{i}"' for i in range(3000))
    df = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, "a;b", "p"), (3, "a;b", "q"), (4, long, None)], "id long, f string, item string")
    out = rows(split_packed(df, "id", "f"))
    assert [r for r in out if r[0] == 3] == [(3, 1, "a"), (3, 1, "a"), (3, 2, "b"), (3, 2, "b")]
    assert sum(r[0] == 4 for r in out) == 3000 and not any(r[0] in (1, 2) for r in out)
    assert rows(split_packed(df.limit(0), "id", "f")) == []


def test_salted_aggregate(spark):
    data = [("hot", i % 5, f"s{i % 7}") for i in range(3000)] + [(f"k{i}", None if i % 3 else i, None if i % 4 == 0 else "s") for i in range(500)] + [(None, 1, "s")] * 50 + [("", 1, "s")]
    df = spark.createDataFrame(data, "key string, amount int, member string").withColumn("n", F.lit(1)).repartition(5)
    want = defaultdict(lambda: [0, 0, set()])
    for k, a, m in data:
        if k is not None:
            want[k][0] += 1
            want[k][1] += a or 0
            want[k][2] |= {m} - {None}
    assert rows(salted_aggregate(df, "key", "amount", "member", share=0.05, salts=8)) == sorted(((k, n, s, len(m)) for k, (n, s, m) in want.items()), key=repr)
    assert rows(salted_aggregate(df.limit(0), "key", "amount", "member")) == []


def test_heavy_keys_are_never_missed(spark):
    data = [f"hot{i % 3}" for i in range(900)] + [f"x{i}" for i in range(3000)]
    df = spark.createDataFrame([(x,) for x in data], "v string").repartition(7)
    found, total = heavy_keys(df, "v", 0.05)
    assert total == 3900
    assert {"hot0", "hot1", "hot2"} <= {r.key for r in found.collect()}
    assert found.count() <= 8 / (7 * 0.05)


def test_skew_join(spark):
    data = [(i, 1 if i < 700 else i) for i in range(1000)] + [(2000, None)]
    left = spark.createDataFrame(data, "id long, k long")
    c = Counter(k for _, k in data)
    groups = spark.createDataFrame([(k, n, f"v{k}") for k, n in c.items() if k is not None and k % 2], "k long, n long, v string")
    out = skew_join(left, groups, ["k"], "n", 1001, F.col("id"), share=0.1)
    assert rows(out.select("id", "k", "v")) == sorted(((i, k, f"v{k}") for i, k in data if k is not None and k % 2), key=repr)


def test_shared_dir_is_read_from_the_session(spark):
    from types import SimpleNamespace as N

    from readloom.cluster import shared_dir, write_table

    conf = N(get=lambda k, d=None: "hdfs://x/y/" if k == "spark.checkpoint.dir" else d)
    assert shared_dir(N(conf=conf)) == "hdfs://x/y"
    unset = N(get=lambda k, d=None: d)
    with pytest.raises(ValueError):
        shared_dir(N(conf=unset, sparkContext=N(getConf=lambda: unset, master="spark://h:1", applicationId="a")))
    assert write_table(spark.range(3), "x").count() == 3
