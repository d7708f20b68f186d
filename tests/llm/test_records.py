"""Duplicates, near duplicates, frequent values, term counts and shared spans against brute force on small tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.functions.text import bases, header_field
from readloom.operators.components import connected_components
from readloom.llm import similar
from readloom.llm.duplicates import fold_copies, records
from readloom.llm.frequent import frequent_values
from readloom.llm.similar import similar_groups
from readloom.llm.spans import shared_levels, shared_spans
from readloom.llm.terms import term_table

from ..conftest import rows

R = random.Random(7)
DNA = ["".join(R.choice("ACGT") for _ in range(R.randint(60, 160))) for _ in range(40)]


def edited(s, n):
    for _ in range(n):
        i = R.randrange(len(s))
        s = s[:i] + R.choice(["", "A", "CG"]) + s[i + 1 :]
    return s


LAYOUTS = [str, str.lower, lambda s: f'"{s}"', lambda s: s[:20] + "\r\n" + s[20:], lambda s: s + "\r\n", lambda s: " " + "-".join(s) + "*", lambda s: s[:9] + "\xa0" + s[9:]]


def sequences():
    """Copies in several layouts, slight edits, long shared stretches, unrelated ones, nulls, empty, short and very long texts."""
    out = []
    for s in DNA[:12]:
        out += [R.choice(LAYOUTS)(s) for _ in range(R.randint(1, 4))]
        out += [edited(s, R.randint(1, 5)) for _ in range(R.randint(0, 3))]
    out += [DNA[20] + DNA[21][:55], DNA[21][:55] + DNA[22], DNA[23] + DNA[20][-52:], None, None, "", "  ", "acg", "ACGTACG", "N" * 60, "N" * 60 + "A"]
    out += DNA[12:20] + ["".join(R.choice("ACGT") for _ in range(60_000))]
    out += [DNA[0]] * 60  # one group of copies holds a third
    return out


@pytest.fixture(scope="module")
def seqs(spark):
    data = sequences()
    # further columns have names that the operators use themselves
    df = spark.createDataFrame([(i, s, "x", 1, None) for i, s in enumerate(data)], "id long, seq string, text string, n int, first_id long").repartition(5)
    return dict(enumerate(data)), df


def letters(s):
    return "".join(c for c in s.upper() if c.isalpha())


def test_copies(seqs):
    data, df = seqs
    groups = defaultdict(list)
    for i, s in data.items():
        if s is not None:
            groups[letters(s)].append(i)
    for hashes in ({}, {"hashes": lambda c: [F.length(c).cast("long"), F.lit(0).cast("long")]}):  # the second collides all the time
        c = fold_copies(df, "id", bases(F.col("seq")), **hashes)
        assert rows(c.pairs()) == sorted(((min(g), i) for g in groups.values() for i in g if i != min(g)), key=repr)
        assert rows(records(c)) == sorted(((min(g), len(g)) for g in groups.values()), key=repr)
    empty = fold_copies(df.limit(0), "id", bases(F.col("seq")))
    assert rows(empty.pairs()) == [] and rows(records(empty)) == []


def test_headers(spark):
    texts = ["sq1;size=9;sample=S1;chunk=2;", "CHUNK: 2 | sample = s1\tSQ1 ,Size=9", "sample=S1;;sq1;;chunk=2;;size=9;;"]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "h string")
    got = [tuple(r) for r in df.select(*[header_field(F.col("h"), n) for n in ("sq", "size", "sample", "chunk")]).collect()]
    assert got == [("1", "9", "s1", "2")] * 3 + [("",) * 4, (None,) * 4]


def brute_groups(data, width, least):
    by = defaultdict(list)
    for i, s in data.items():
        if s is not None:
            by[letters(s)].append(i)
    texts = list(by)
    sets = [{t[i : i + width] for i in range(len(t) - width + 1)} for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= least * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    parts = defaultdict(list)
    for i in range(len(texts)):
        parts[root(i)].append(i)
    out = set()
    for p in parts.values():
        if len(p) > 1:
            ids = [x for i in p for x in by[texts[i]]]
            out |= {(x, min(ids)) for x in ids}
    return out


@pytest.mark.parametrize("least,block", [(0.6, 8192), (0.6, 7), (0.8, 16)])
def test_similar(seqs, least, block):
    data, df = seqs
    got = similar_groups(df, "id", bases(F.col("seq")), least, 8, block=block).select("id", "group_id")
    assert {tuple(r) for r in got.collect()} == brute_groups(data, 8, least)


def test_similar_many_lookalikes(spark):
    base = DNA[30] + DNA[31]
    data = {i: base[:i] + ("A" if base[i] != "A" else "C") + base[i + 1 :] for i in range(100)}
    df = spark.createDataFrame(list(data.items()), "id long, seq string")
    assert {tuple(r) for r in similar_groups(df, "id", F.col("seq"), 0.8, 8, block=32).select("id", "group_id").collect()} == {(i, 0) for i in data}
    assert rows(similar_groups(df.limit(0), "id", F.col("seq"), 0.8, 8)) == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    out = dict(connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect())
    assert out == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


@pytest.mark.parametrize("k,share,chunk", [(5, 0.0, 37), (5, 0.0, 100_000), (500, 0.02, 50), (1000, 0.0, 64)])
def test_frequent(spark, k, share, chunk):
    r = random.Random(k + chunk)
    data = [f"v{int(r.paretovariate(0.7))}" for _ in range(3000)] + [None] * 200 + [""] * 90 + ["tie1"] * 11 + ["tie2"] * 11 + ["x" * 50_000]
    df = spark.createDataFrame([(v, v, 1) for v in data], "value string, key string, c int").repartition(6)
    counts = Counter(v for v in data if v is not None)
    good = {v: n for v, n in counts.items() if n >= share * len(data)}
    last = sorted(good.values(), reverse=True)[: k][-1]
    want = {v: n for v, n in good.items() if n >= last}
    got = {r.value: r for r in frequent_values(df, "value", k, share, chunk_rows=chunk).collect()}
    assert {v: r.n_rows for v, r in got.items()} == want
    assert all(r.at_least <= r.n_rows <= r.at_most for r in got.values())
    assert frequent_values(df.limit(0), "value", k, share).count() == 0
    assert {r.value for r in frequent_values(df, "value", k, share, chunk_rows=chunk, broadcast_rows=0).collect()} == set(want)


def test_terms(spark):
    r = random.Random(1)
    data = [(r.choice(["hot"] * 30 + [f"t{i}" for i in range(60)]), f"s{r.randrange(12)}", r.choice([None, 0, 1, 5])) for _ in range(800)] + [("once", "s1", 1), ("once", "s1", 1), ("neg", "s2", -3), (None, "s1", 1), ("x", None, 1), ("", "s3", 1)]
    df = spark.createDataFrame(data, "seq string, rec string, amount int").withColumns({"term": F.lit("clash"), "record": F.lit(0), "t": F.lit(1)}).repartition(4)
    best = {}
    for t, s, a in data:
        if t is not None and s is not None:
            best[t, s] = max(best.get((t, s), -(10**9)), a or 0)
    n_all = len({s for _, s in best})
    want = {}
    for t in {t for t, _ in best}:
        v = [a for (x, _), a in best.items() if x == t]
        want[t] = (sum(v), len(v), "common" if len(v) > 0.5 * n_all else "rare" if len(v) == 1 and sum(v) <= 2 else None)
    for share in (0.02, 0.9):
        got = {x.term: (x.total, x.n_records, x.mark) for x in term_table(df, "seq", "rec", "amount", heavy_share=share).collect()}
        assert got == want
    assert term_table(df.limit(0), "seq", "rec", "amount").count() == 0


def brute_spans(data, least):
    texts = {letters(s) for s in data.values() if s is not None}
    holders = defaultdict(set)
    for t in texts:
        for i in range(len(t) - least + 1):
            holders[t[i : i + least]].add(t)
    out = set()
    for i, s in data.items():
        t = letters(s) if s is not None else ""
        mark = [False] * (len(t) + 1)
        for p in range(len(t) - least + 1):
            if len(holders[t[p : p + least]]) > 1:
                mark[p : p + least] = [True] * least
        start = None
        for p, m in enumerate(mark):
            if m and start is None:
                start = p
            if not m and start is not None:
                out.add((i, start + 1, p))
                start = None
    return out


@pytest.mark.parametrize("least", [50, 21])
def test_spans(seqs, least):
    data, df = seqs
    got = [tuple(r) for r in shared_spans(df, "id", bases(F.col("seq")), least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(data, least)
    assert shared_spans(df.limit(0), "id", bases(F.col("seq")), least).count() == 0


def test_levels(seqs):
    data, df = seqs
    want = defaultdict(int)
    for i, a, z in brute_spans(data, 25):
        want[i] += z - a + 1
    got = {r.id: r for r in shared_levels(df, "id", bases(F.col("seq")), 25).collect()}
    assert {i: r.n_shared for i, r in got.items()} == {i: want[i] for i, s in data.items() if s is not None}
    texts = {letters(s) for s in data.values() if s is not None}
    for i, r in got.items():
        t = letters(data[i])
        n = next((n for n in (25, 50, 100, 200) if not any(t[p : p + n] in u for u in texts - {t} for p in range(len(t) - n + 1))), None) if len(t) < 1000 else 25
        assert r.longest_level == (n // 2 if n > 25 else 0)


def test_levels_rule_out_nothing_alike():
    """Whatever two levels of a tree rule out holds no alike pair, by brute force over the leaves."""
    r = random.Random(3)
    base = ["".join(r.choices("ACGT", k=r.randint(30, 90))) for _ in range(30)]
    texts = [s[r.randint(0, 9) :] + "".join(r.choices("ACGT", k=r.randint(0, 9))) for s in base for _ in range(4)]
    texts = sorted(texts[::2]) + texts[1::2]  # alike texts on both sides, and next to one another on the second
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    (b,) = similar._sketch(8, 192)(iter([batch]))
    bits = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint64).reshape(len(texts), -1)
    size = b.column(2).to_numpy()
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    assert size.tolist() == [len(s) for s in sets]
    half = len(texts) // 2
    x, y = (similar.Tree(np.arange(len(texts))[a:z], size[a:z], bits[a:z], texts[a:z], 8) for a, z in ((0, half), (half, len(texts))))
    for p, q, same in ((x, y, False), (x, x, True), (y, y, True)):
        got = {(int(p.ids[i]), int(q.ids[j])) for a, b in similar.candidates(p, q, 0.6, same) for i, j in zip(a, b)}
        want = {(int(i), int(j)) for i in p.ids for j in q.ids if (i < j or not same) and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
        assert want and want <= got and len(got) < len(p.ids) * len(q.ids) / 4


def test_tiles_far_apart_in_size_do_not_meet(spark):
    """Sets whose sizes differ by more than the similarity allows are never sent to one another."""
    level = lambda low, high: (low, high, 0, b"\xff" * 16)
    rows_ = [(0, *level(100, 120)), (0, *level(110, 130)), (1, *level(210, 240)), (2, *level(230, 300))]
    table = spark.createDataFrame(rows_, "tile long, low long, high long, surplus long, bits binary")
    big = spark.createDataFrame([(t, low, high, 300, b) for t, low, high, _, b in rows_], table.schema)
    assert rows(similar.tile_pairs(big, 0.6, 4)) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)]
