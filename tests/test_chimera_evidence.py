"""Coverage against a literal reading of its definition, the bounds that spare alignments, and evidence gathered in blocks."""

import random

import numpy as np

from readloom.kernels import align as A
from readloom.operators import chimera


def literal(al, most):
    """(left, right) by stepping through the columns."""
    q, p = al
    size = len(q)
    out = []
    for q, p, credit in ((q, p, most), (q[::-1], p[::-1], most - 1 if size >= most else 0)):
        at, n = 0, 0
        while at < size and q[at] == "-":
            at += 1
        while at < size and p[at] == "-" and at < credit:
            at, n = at + 1, n + 1
        while at < size and q[at] == p[at]:
            at, n = at + 1, n + 1
        out.append(n)
    return tuple(out)


def random_alignment(rng):
    cols = [rng.choice(("AA", "CC", "GG", "TT", "AC", "GT", "A-", "-C")) for _ in range(rng.randint(0, 20))]
    a, b = rng.choice((0, 3, 15, 16, 17, 20)), rng.choice((0, 3, 14, 15, 16, 20))
    lead, tail = rng.choice(("A-", "-A")), rng.choice(("C-", "-C"))
    cols = [lead] * a + ["GG"] * rng.randint(0, 6) + cols + ["TT"] * rng.randint(0, 6) + [tail] * b
    return "".join(c[0] for c in cols), "".join(c[1] for c in cols)


def test_coverage_is_the_definition():
    rng = random.Random(5)
    for _ in range(3000):
        al = random_alignment(rng)
        assert A.coverage(al, False, 16)[:2] == literal(al, 16), al


def test_right_end_has_one_column_less():
    q = "A" * 84 + "C" * 16
    assert A.coverage((q, "A" * 84 + "-" * 16))[:2] == (84, 15)
    assert A.coverage((q, "-" * 16 + q[16:]))[:2] == (100, 84)


def test_bounds_hold():
    rng = random.Random(6)
    seqs = ["".join(rng.choices("ACGT", k=rng.randint(20, 60))) for _ in range(40)]
    seqs += [s[rng.randint(0, 20) :] + "".join(rng.choices("ACGT", k=rng.randint(0, 20))) for s in seqs if len(s) > 25]
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(seqs)), np.arange(len(seqs))))
    left, right = A.most_covered(seqs, seqs, i, j, 16)
    for k, al in enumerate(A.align([seqs[x] for x in i], [seqs[x] for x in j], band=16, **chimera.SCORES)):
        a, b = A.coverage(al)[:2]
        assert a <= left[k] and b <= right[k], al


def planted(rng, n=24):
    parents = ["".join(rng.choices("ACGT", k=60)) for _ in range(6)]
    rows = [("s", p, 100 + k) for k, p in enumerate(parents)]
    for _ in range(n):
        a, b = rng.sample(parents, 2)
        cut = rng.randint(0, 60)
        s = list(a[:cut] + b[cut:])
        if rng.random() < 0.5:
            s[rng.randrange(60)] = "A"
        s = "".join(s)[rng.choice((0, 0, 3)) :]
        if s not in {r[1] for r in rows}:
            rows.append(("s", s, rng.randint(1, 60)))
    return rows


def test_evidence_is_brute_force_in_any_number_of_blocks(spark, monkeypatch):
    rng = random.Random(7)
    rows = planted(rng)
    table = spark.createDataFrame(rows, "sample string, seq string, abundance long")
    for one_off in (False, True):
        want = {}
        for _, s, n in rows:
            mine = [p for _, p, m in rows if m >= 2 and m > 1.5 * n and p != s]
            if mine:
                want[s] = (len(mine), chimera.is_bimera(s, mine, one_off))
        for size in (1024, 7):
            monkeypatch.setattr(chimera, "BLOCK", size)
            got = chimera.chimera_evidence(table, table.where("abundance >= 2"), 1.5, allow_one_off=one_off).collect()
            assert {r.seq: (r.n_parents, r.chimeric) for r in got} == want
            assert any(v[1] for v in want.values()) and not all(v[1] for v in want.values())


def test_given_parents(spark):
    a, b = "A" * 30 + "C" * 30, "G" * 30 + "T" * 30
    seqs = spark.createDataFrame([(a[:30] + b[30:],), (a,), (None,), ("",)], "seq string")
    got = {r.seq: r.chimeric for r in chimera.bimeras_of(seqs, spark.createDataFrame([(a,), (b,), (a,)], "seq string")).collect()}
    assert got[a[:30] + b[30:]] and not got[a] and not got[None] and not got[""]


def test_pooled_plan_has_no_nested_loop(spark):
    t = spark.createDataFrame(planted(random.Random(8)), "sample string, seq string, abundance long")
    plan = chimera.chimeras_denovo(t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parent_counts(spark):
    rows = planted(random.Random(9)) + [("t", "ACGT", 5), ("t", "ACGA", 5), ("t", "ACGG", 7), ("t", "ACCC", 8), ("u", "A", 1)]
    table = spark.createDataFrame(rows, "sample string, seq string, abundance long")
    want = {(s, q): sum(1 for a, p, m in rows if a == s and p != q and m >= 2 and m > 1.5 * n) for s, q, n in rows}
    got = {(r["sample"], r.seq): r.n_parents for r in chimera.parent_counts(table, 1.5, 2, inclusive=True).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_empty_tables(spark):
    t = spark.createDataFrame([], "sample string, seq string, abundance long")
    assert chimera.chimera_evidence(t, t, 2).count() == 0
    assert chimera.chimeras_denovo(t.select("seq", "abundance")).count() == 0


def test_one_off_bounds_hold():
    rng = random.Random(10)
    seqs = ["".join(rng.choices("ACGT", k=rng.randint(20, 70))) for _ in range(20)]
    for s in list(seqs):
        t = list(s)
        for _ in range(rng.randint(1, 5)):
            k, kind = rng.randrange(len(t)), rng.randrange(3)
            t[k : k + (kind > 0)] = [] if kind == 2 else [rng.choice("ACGTN")]
        seqs += ["".join(t)[rng.choice((0, 0, 3, 17)) :], s[rng.randint(0, 20) :] + "".join(rng.choices("ACGT", k=rng.randint(0, 20)))]
    seqs += ["ACGT", "A" * 63, "A" * 64, "A" * 65]
    bounds = A.most_covered_one_off(seqs, seqs, 16, 4)
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(seqs)), np.arange(len(seqs))))
    for p, q, al in zip(i, j, A.align([seqs[x] for x in i], [seqs[x] for x in j], band=16, **chimera.SCORES), strict=True):
        assert all(x <= b[p, q] for x, b in zip(A.coverage(al, True), bounds, strict=False)), al
        assert bounds[4][p, q] or sum(A.evaluate(al)[1:]) < 4, al


def test_one_off_aligns_few_pairs(monkeypatch):
    """Parents that differ in one letter, or in nearly all, can't make up a child of which they leave the middle."""
    rng = random.Random(11)
    base = "".join(rng.choices("ACGT", k=90))
    others = [base[:k] + "N" + base[k + 1 :] for k in range(0, 90, 3)] + ["".join(rng.choices("ACGT", k=90)) for _ in range(30)]
    seqs = [base[:40] + "".join(rng.choices("ACGT", k=10)) + base[50:], others[40][:45] + others[50][45:]]
    aligned = []
    run = A.align
    monkeypatch.setattr(A, "align", lambda a, b, **how: aligned.extend(a) or run(a, b, **how))
    i, j = (v.ravel() for v in np.meshgrid(np.arange(2), np.arange(len(others)), indexing="ij"))
    mine = chimera._one_off_bounds(seqs, others, i, j, 16, 4)
    most = {x: np.array([v[i == k].max() for k in range(2)]) for x, v in mine.items()}
    out = chimera._measure_one_off(seqs, others, i, j, most, 16, 4)
    l, r = (out[x].to_pylist() for x in ("l", "r"))
    assert l[0] + r[0] < 90 <= l[1] + r[1] and seqs[0] not in aligned and 0 < len(aligned) < 15
    assert [chimera.is_bimera(s, others, True) for s in seqs] == [False, True]
