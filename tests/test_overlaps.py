"""Containment and overlaps against brute force, and bounded work where all sequences begin alike."""

import random

from readloom.operators import chimera, overlaps, pairs
from readloom.operators import taxonomy as T

from .conftest import rows


def overlap(a, b, least):
    """Does a begin within b, and agree with it from there on over ``least`` letters or more?"""
    for p in range(len(b)):
        n = min(len(a), len(b) - p)
        if n >= least and a[:n] == b[p : p + n]:
            return True
    return False


def family(rng, n):
    """Sequences that share their first 40 letters."""
    head = "".join(rng.choices("ACGT", k=40))
    out = {head + "".join(rng.choices("ACGT", k=rng.randint(20, 40))) for _ in range(n)}
    for s in list(out)[: n // 2]:
        out |= {s[: rng.randint(30, len(s))], s[rng.randint(1, 20) :], s[rng.randint(1, 20) :] + "".join(rng.choices("ACGT", k=10))}
    return sorted(out)


def test_overlaps_are_brute_force(spark):
    seqs = family(random.Random(1), 20) + ["ACGT", "A" * 30, "A" * 31]
    got = {frozenset(r) for r in overlaps.exact_overlaps(spark.createDataFrame([(s,) for s in seqs + [None, "", seqs[0]]], "seq string"), 20).collect()}
    assert got == {frozenset((a, b)) for a in seqs for b in seqs if a != b and overlap(a, b, 20)}
    assert overlaps.exact_overlaps(spark.createDataFrame([], "seq string"), 20).count() == 0


def test_candidates_are_few_although_all_begin_alike(spark, monkeypatch):
    """What is compared as text is about what is found: no word that all share is looked up."""
    rng = random.Random(2)
    head = "".join(rng.choices("ACGT", k=40))
    refs = [head + "".join(rng.choices("ACGT", k=60)) for _ in range(60)]
    probes = [r[: rng.randint(60, 95)] for r in refs]
    p = spark.createDataFrame(list(enumerate(probes)), "q long, probe string")
    t = spark.createDataFrame(list(enumerate(refs)), "t long, text string")
    met = overlaps.contained(p, t, 16)
    assert rows(met) == [(i, i) for i in range(60)] or set(rows(met)) == {(i, j) for i in range(60) for j in range(60) if probes[i] in refs[j]}
    plan = met._jdf.queryExecution().analyzed().toString()
    assert "Join Cross" not in plan


def test_species_with_null_references_and_other_strand(spark):
    ref = "ACGTTGCAAGGCTTAACCGGATAT" * 2 + "TTTTGG"
    refs = spark.createDataFrame([("r1", "G", "s", ref), ("r2", "G", "t", None), ("r3", "H", "u", "")], "ref_id string, genus string, species string, seq string")
    q = ref[5:40]
    turned = q[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seqs = spark.createDataFrame([(q,), (turned,), (None,), ("ACGN" * 5,)], "seq string")
    assert {r.seq for r in T.species_hits(seqs, refs).collect()} == {q}
    assert {r.seq for r in T.species_hits(seqs, refs, try_rc=True).collect()} == {q, turned}


def test_collapse_waits_for_what_is_more_abundant(spark):
    """b could go to a and c to b; b goes to a, so c stays, as it doesn't fit a."""
    rng = random.Random(3)
    a = "".join(rng.choices("ACGT", k=60))
    b = a[20:] + "".join(rng.choices("ACGT", k=20))
    c = b[35:] + "".join(rng.choices("ACGT", k=30))
    table = spark.createDataFrame([("s", a, 9), ("s", b, 5), ("s", c, 3), ("t", b, 1), ("t", "ACGT", 2)], "sample string, seq string, abundance long")
    assert rows(chimera.collapse_no_mismatch(table)) == sorted([("s", a, 14), ("s", c, 3), ("t", a, 1), ("t", "ACGT", 2)], key=repr)


def test_denoised_mates(spark):
    """Reads to uniques to clusters on both sides, with a mate lost, one in no cluster, an overlap that differs and columns carried along."""
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rng = random.Random(4)
    x = "".join(rng.choices("ACGT", k=60))
    f, r = x[:40], rc(x[20:])
    bad = x[20:30] + ("C" if x[30] != "C" else "G") + x[31:]
    r2 = rc(bad)  # differs within the overlap
    fwd = spark.createDataFrame([("s", i, f) for i in range(5)] + [("s", 5, f[:-1] + "N"), ("s", 6, f)], "sample string, read_idx long, seq string")
    rev = spark.createDataFrame([("s", 0, r), ("s", 1, r), ("s", 2, r2), ("s", 3, r2), ("s", 5, r), ("s", 6, "A" * 40), ("s", 9, r)], "sample string, read_idx long, seq string")
    clusters = lambda *seqs: spark.createDataFrame([("s", k + 1, s, n, k * 0.5) for k, (s, n) in enumerate(seqs)], "sample string, cluster int, sequence string, n0 long, pval double")
    fwd_map = spark.createDataFrame([("s", f, 1), ("s", f[:-1] + "N", 1)], "sample string, seq string, cluster int")
    rev_map = spark.createDataFrame([("s", r, 1), ("s", r2, 2), ("s", "A" * 40, None)], "sample string, seq string, cluster int")
    sides = (fwd, clusters((f, 5)), fwd_map, rev, clusters((r, 3), (r2, 9)), rev_map)
    assert rows(pairs.cluster_pairs(fwd, fwd_map, rev, rev_map)) == sorted([("s", 1, 1, 3), ("s", 1, 2, 2), ("s", 1, None, 1)], key=repr)
    out = pairs.merge_denoised(*sides, propagate=["pval", "nothing"], return_rejects=True)
    assert out.columns[-2:] == ["F_pval", "R_pval"]
    got = {row.reverse: row for row in out.collect()}
    assert (got[1].sequence, got[1].abundance, got[1].nmatch, got[1].accept, got[1].R_pval) == (x, 3, 20, True, 0.0)
    assert (got[2].sequence, got[2].abundance, got[2].accept, got[2].prefer) == ("", 2, False, 2)
    loose = {row.reverse: row.sequence for row in pairs.merge_denoised(*sides, max_mismatch=1).collect()}
    assert loose == {1: x, 2: x[:20] + bad}
    joined = pairs.merge_denoised(*sides, just_concatenate=True).collect()
    assert {row.sequence for row in joined} == {f + "N" * 10 + x[20:], f + "N" * 10 + bad} and all(row.prefer is None for row in joined)
    assert pairs.merge_denoised(*(t.limit(0) for t in sides)).count() == 0
