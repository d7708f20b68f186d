"""Kernels against plain, slow versions of what they state."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.kernels import align as A
from readloom.kernels import partition, words
from readloom.kernels.poisson import log_tail, tail
from readloom.options import Options

DNA = st.text("ACGT", min_size=1, max_size=14)


def plain_score(a, b, match, mismatch, gap, free):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = []
            if i and j:
                options.append(best[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch))
            if i:
                options.append(best[i - 1][j] + (0 if free and j in (0, len(b)) else gap))
            if j:
                options.append(best[i][j - 1] + (0 if free and i in (0, len(a)) else gap))
            best[i][j] = max(options, default=0)
    return best[-1][-1]


def score_of(al, match, mismatch, gap, free):
    cut = A.inner(al) if free else slice(None)
    return sum(gap if "-" in (x, y) else match if x == y else mismatch for x, y in zip(al[0][cut], al[1][cut], strict=True))


@given(st.lists(st.tuples(DNA, DNA), min_size=1, max_size=6), st.booleans())
@settings(max_examples=80, deadline=None)
def test_alignments_are_best_and_keep_the_sequences(pairs, free):
    a, b = zip(*pairs, strict=True)
    for x, y, al in zip(a, b, A.align(list(a), list(b), 5, -4, -8, ends_free=free), strict=True):
        assert al[0].replace("-", "") == x and al[1].replace("-", "") == y
        assert ("-", "-") not in set(zip(*al, strict=True))
        if not free or A.inner(al).stop > A.inner(al).start:
            assert score_of(al, 5, -4, -8, free) == plain_score(x, y, 5, -4, -8, free)


def test_alignment_cases():
    assert A.align(["ACGTACGT"], ["ACGTACGT"]) == [("ACGTACGT", "ACGTACGT")]
    assert A.align(["ACGT"], [""]) == [("ACGT", "----")]
    assert A.align(["ACGTTTTACG"], ["ACGTTTACG"], homo_gap=-1)[0][1].count("-") == 1
    al = A.align(["AAACCCGGG"], ["CCCGGGTTT"])[0]
    assert al == ("AAACCCGGG---", "---CCCGGGTTT") and A.evaluate(al) == (6, 0, 0)
    assert A.consensus(al) == A.consensus(al, trim_overhang=True) == "AAACCCGGGTTT"
    assert A.consensus(al[::-1], trim_overhang=True) == "CCCGGG"
    assert A.consensus(("ACGT", "AGGT"), prefer=2) == "AGGT"
    wide = A.align(["A" * 20 + "C" * 20], ["C" * 20 + "A" * 20], band=3)[0]
    assert abs(wide[0].count("-") - wide[1].count("-")) <= 6


def test_coverage():
    left, right = "ACGTTGCATGCCATTGACCA", "GGATCCAAGTCTCAGTTTAC"
    child = left[:11] + right[11:]
    for parent in (left, right):
        al = A.align([child], [parent], band=16)[0]
        c = A.coverage(al)
        assert c[0] >= 11 or c[1] >= 9
    assert A.coverage(("ACGT", "ACGT")) == (4, 4, 0, 0)
    assert A.coverage(("ACGTA", "ACCTA"), one_off=True) == (2, 2, 5, 5)


@given(st.integers(1, 60), st.floats(1e-6, 80))
@settings(max_examples=80, deadline=None)
def test_poisson(k, mean):
    below = math.fsum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(k))
    above = math.fsum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(k, k + 400))
    assert tail(np.array([k]), np.array([mean]))[0] == pytest.approx(above if above < 0.5 else 1 - below, rel=1e-8)


def test_poisson_extremes():
    assert log_tail(np.array([200]), np.array([1e-3]))[0] < -2000
    assert tail(np.array([0, 3]), np.array([0.0, 0.0])).tolist() == [1.0, 0.0]


def test_complexity():
    assert words.complexity("AAAAAAAA", 2, None, 5) == pytest.approx(1)
    assert words.complexity("A", 2, None, 5) == pytest.approx(1)
    assert words.complexity("ACACACAC" + "A" * 40, 2, 20, 5) == pytest.approx(1)
    assert words.complexity("ACGT", 2, 20, 5) == 16
    assert words.complexity("ACNGT" * 5, 2, 10, 5) <= 16
    assert words.shared("ACGTACGT", "ACGTATTT", 5) == 1


def test_denoise_recovers_planted_sequences():
    r = random.Random(3)
    truth = ["".join(r.choice("ACGT") for _ in range(80)) for _ in range(3)]
    seqs, reads = list(truth), [400, 250, 120]
    for t, n in zip(truth, reads[:], strict=True):
        for _ in range(n // 25):
            i = r.randrange(80)
            s = t[:i] + r.choice([c for c in "ACGT" if c != t[i]]) + t[i + 1 :]
            if s not in seqs:
                seqs.append(s)
                reads.append(1)
    err = np.full((16, 41), 0.001 / 3)
    err[[0, 5, 10, 15]] = 0.999
    out = partition.denoise(seqs, np.array(reads), [np.full(80, 30.0)] * len(seqs), err)
    assert {c["sequence"] for c in out["clusters"]} == set(truth)
    assert sum(c["abundance"] for c in out["clusters"]) == sum(reads)
    for s, c in zip(seqs, out["map"], strict=True):
        near = min(truth, key=lambda t: sum(a != b for a, b in zip(s, t, strict=True)))
        assert out["clusters"][c - 1]["sequence"] == near
    assert sum(t["n"] for t in out["trans"]) == 80 * sum(reads)
    one = partition.denoise(seqs, np.array(reads), None, np.ones((16, 41)), opt=Options(MAX_CLUST=1))
    assert len(one["clusters"]) == 1
    order = list(range(len(seqs)))
    r.shuffle(order)
    again = partition.denoise([seqs[i] for i in order], np.array(reads)[order], [np.full(80, 30.0)] * len(seqs), err)
    assert again["clusters"] == out["clusters"]


def test_options():
    with pytest.warns(UserWarning):
        assert Options().with_(NO_SUCH=1) == Options()
    assert Options().with_(OMEGA_A=1e-20, SSE=2).OMEGA_A == 1e-20
    with pytest.raises(TypeError):
        Options().with_(OMEGA_A=None)
