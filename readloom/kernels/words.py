"""Words of sequences as numbers."""

from __future__ import annotations

from collections import Counter

import numpy as np

_CODE = np.full(256, 4, np.int64)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _i


def encode(seq: str) -> np.ndarray:
    """A, C, G, T as 0 to 3; anything else as 4."""
    return _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


def word_numbers(seq: str, k: int) -> np.ndarray:
    """The number of each word of k letters in base 4; -1 for one that has another letter."""
    c = encode(seq)
    n = len(c) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    w, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(k):
        part = c[i : i + n]
        w = w * 4 + part
        bad |= part == 4
    w[bad] = -1
    return w


#: An odd multiplier and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base to the power of 0 to n - 1, modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def end_hashes(seqs: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each sequence and each length n from ``least`` to one less than its own: (number of the sequence, n, hash of its first n letters, hash of its last n letters), in time linear in the letters. Hashes of equal letters are equal; different ones may rarely be."""
    sizes = np.array([len(s) for s in seqs], np.int64)
    begin = np.cumsum(sizes) - sizes
    letters = np.frombuffer("".join(seqs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letters = (letters + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    letters ^= letters >> np.uint64(29)
    n = len(letters) + 1
    powers = _powers(_BASE, n)
    back = _powers(_INVERSE, n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers[:-1], dtype=np.uint64)])
    counts = np.maximum(sizes - least, 0)
    owner = np.repeat(np.arange(len(seqs)), counts)
    size = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + least
    a, z = begin[owner], begin[owner] + sizes[owner]
    return owner, size, (total[a + size] - total[a]) * back[a], (total[z] - total[z - size]) * back[z - size]


def effective_number(counts: np.ndarray) -> np.ndarray:
    """exp of the Shannon entropy along the last axis; 1 where nothing was counted."""
    total = counts.sum(-1, keepdims=True)
    p = counts / np.maximum(total, 1)
    return np.exp(-np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(-1))


def _letters(seqs: list[str], code: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All letters in one array, as bytes or by ``code``, and where each sequence begins (one more entry at the end)."""
    raw = np.frombuffer("".join(seqs).encode("ascii", "replace"), np.uint8)
    return (raw if code is None else code[raw]), np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)


def _starts(ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of k letters begin in the one array, and the sequence each belongs to."""
    counts = np.maximum(np.diff(ends) - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    return ends[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts), owner


def _numbers(letters: np.ndarray, at: np.ndarray, k: int, base: int) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for i in range(k):
        out = out * base + letters[at + i]
    return out


def complexities(seqs: list[str], k: int, window: int | None, by: int) -> np.ndarray:
    """For each sequence the effective number of its words; with a window the least of those that begin at every ``by`` letters and fit, 4^k where none does. For k up to 3."""
    letters, ends = _letters(seqs, _CODE)
    at, owner = _starts(ends, k)
    bad = (letters == 4).astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(bad)])
    good = bad[at + k] == bad[at]
    word = _numbers(np.minimum(letters, 3), at, k, 4)
    n, m = len(seqs), 4**k
    if window is None:
        return effective_number(np.bincount(owner[good] * m + word[good], minlength=n * m).reshape(n, m))
    # running counts at every word; a window's counts are a difference of two of them
    out = np.full(n, float(m))
    first = np.searchsorted(owner, np.arange(n + 1))
    fits = np.maximum((np.diff(ends) - window) // by + 1, 0)
    fits[np.diff(ends) < window] = 0
    for lo in range(0, n, 512):
        hi = min(lo + 512, n)
        a, z = first[lo], first[hi]
        each = np.zeros((z - a + 1, m), np.int32)
        rows = np.flatnonzero(good[a:z])
        each[rows + 1, word[a:z][rows]] = 1
        total = each.cumsum(0)
        which = np.repeat(np.arange(lo, hi), fits[lo:hi])
        if len(which):
            start = first[which] - a + (np.arange(len(which)) - np.repeat(np.cumsum(fits[lo:hi]) - fits[lo:hi], fits[lo:hi])) * by
            value = effective_number(total[start + window - k + 1] - total[start])
            np.minimum.at(out, which, value)
    return out


def complexity(seq: str, k: int, window: int | None, by: int) -> float:
    """``complexities`` of one sequence."""
    return float(complexities([seq], k, window, by)[0])


def shared_counts(a: list[str], b: list[str], k: int) -> np.ndarray:
    """For each pair the sum over the words of the smaller of both counts. Words with other letters than A, C, G, T are words like any other. For k up to 7."""
    keys = []
    for seqs in (a, b):
        letters, ends = _letters(seqs)
        at, owner = _starts(ends, k)
        keys.append((owner, _numbers(letters.astype(np.int64), at, k, 256)))
    ids = np.unique(np.concatenate([w for _, w in keys]), return_inverse=True)[1]
    cut = len(keys[0][1])
    size = int(ids.max(initial=0)) + 1
    ua, na = np.unique(keys[0][0] * size + ids[:cut], return_counts=True)
    ub, nb = np.unique(keys[1][0] * size + ids[cut:], return_counts=True)
    both, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return np.bincount(both // size, weights=np.minimum(na[ia], nb[ib]), minlength=len(a)).astype(np.int64)


def shared(a: str, b: str, k: int) -> int:
    """``shared_counts`` of one pair, for any k."""
    if k <= 7:
        return int(shared_counts([a], [b], k)[0])
    count = lambda s: Counter(s[i : i + k] for i in range(len(s) - k + 1))
    return (count(a) & count(b)).total()


class Known:
    """A set of words of A, C, G and T, all of k letters (at most 31), to look up in many sequences at once."""

    def __init__(self, words: frozenset[str], k: int):
        self.k = k
        plain = [w for w in words if len(w) == k and not set(w) - set("ACGT")]
        letters, ends = _letters(plain, _CODE)
        self.numbers = np.sort(_numbers(letters, ends[:-1], k, 4)) if plain else np.zeros(0, np.int64)

    def hits(self, seqs: list[str], non_overlapping: bool) -> np.ndarray:
        """How many words of each sequence are known; without overlaps a hit is followed by the word that begins k + 1 later."""
        letters, ends = _letters(seqs, _CODE)
        at, owner = _starts(ends, self.k)
        if not len(at) or not len(self.numbers):
            return np.zeros(len(seqs), np.int64)
        bad = np.concatenate([[0], np.cumsum(letters == 4)])
        number = _numbers(np.minimum(letters, 3), at, self.k, 4)
        place = np.minimum(np.searchsorted(self.numbers, number), len(self.numbers) - 1)
        found = (self.numbers[place] == number) & (bad[at + self.k] == bad[at])
        at, owner = at[found], owner[found]
        if not non_overlapping:
            return np.bincount(owner, minlength=len(seqs))
        # in turns: the first hit of each sequence that is far enough from the last one taken
        out, last = np.zeros(len(seqs), np.int64), np.full(len(seqs), -(10**9))
        while len(at):
            lead = np.concatenate([[True], owner[1:] != owner[:-1]])
            out[owner[lead]] += 1
            last[owner[lead]] = at[lead]
            rest = at > last[owner] + self.k
            at, owner = at[rest], owner[rest]
        return out
