"""Global alignment of many pairs at once, and what is read off alignments."""

from __future__ import annotations

import numpy as np

DIAG, LEFT, UP = 1, 2, 3
_FAR = -(10**6)


def _codes(seqs: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in seqs])
    out = np.zeros((len(seqs), width), np.uint8)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
    return out, n


def _run_of_three(codes: np.ndarray) -> np.ndarray:
    """Places that lie in a run of three or more equal letters."""
    same = codes[:, 2:] == codes[:, 1:-1]
    three = same & (codes[:, 1:-1] == codes[:, :-2])
    out = np.zeros(codes.shape, bool)
    for k in range(3):
        out[:, k : k + three.shape[1]] |= three
    return out


def align(a: list[str], b: list[str], match: int = 5, mismatch: int = -4, gap: int = -8, homo_gap: int | None = None, band: int = -1, ends_free: bool = True, batch: int = 128) -> list[tuple[str, str]]:
    """Best alignments of a[i] with b[i], as pairs of strings with '-' for gaps.

    Of equal scores a gap in b is preferred, then one in a, then a pair of letters. ``band`` limits how far the alignment
    may leave the diagonal, beyond what the lengths differ by (negative: not at all limited). Gaps before and after
    cost nothing with ``ends_free``. ``homo_gap`` is the cost of a gap at a letter in a run of three or more.

    All cells of an anti-diagonal are computed at once, for all pairs of a batch; batches hold pairs of like length.
    """
    out: list[tuple[str, str]] = [("", "")] * len(a)
    order = sorted(range(len(a)), key=lambda i: (len(a[i]), len(b[i])))
    for at in range(0, len(order), batch):
        which = order[at : at + batch]
        for i, r in zip(which, _align([a[i] for i in which], [b[i] for i in which], match, mismatch, gap, gap if homo_gap is None else homo_gap, band, ends_free), strict=True):
            out[i] = r
    return out


def _align(a, b, match, mismatch, gap, homo_gap, band, ends_free):
    rows, cols = max(map(len, a)), max(map(len, b))
    x, n = _codes(a, rows)
    y, m = _codes(b, cols)
    k = len(a)
    gap_up = np.where(_run_of_three(x), homo_gap, gap) if homo_gap != gap and rows > 2 else np.full(x.shape, gap)
    gap_left = np.where(_run_of_three(y), homo_gap, gap) if homo_gap != gap and cols > 2 else np.full(y.shape, gap)
    below, above = band + np.maximum(n - m, 0), band + np.maximum(m - n, 0)
    i = np.arange(rows + 1)
    before = np.full((k, rows + 1), _FAR, np.int32)
    last = np.full((k, rows + 1), _FAR, np.int32)
    moves = np.zeros((rows + cols + 1, k, rows + 1), np.uint8)
    top = np.zeros((k, cols + 1), np.int64) if ends_free else np.concatenate([np.zeros((k, 1), np.int64), np.cumsum(gap_left, 1)], 1)
    side = np.zeros((k, rows + 1), np.int64) if ends_free else np.concatenate([np.zeros((k, 1), np.int64), np.cumsum(gap_up, 1)], 1)
    last[:, 0] = 0
    for d in range(1, rows + cols + 1):
        lo, hi = max(0, d - cols), min(rows, d)
        now = np.full((k, rows + 1), _FAR, np.int32)
        p, q = max(1, lo), min(hi, d - 1)  # cells with a letter on both sides
        if band >= 0:  # only cells that some pair of the batch may reach
            p, q = max(p, -((int(above.max()) - d) // 2)), min(q, (d + int(below.max())) // 2)
        if p <= q:
            r = i[p : q + 1]
            c = d - r
            cost_left, cost_up = gap_left[:, c - 1], gap_up[:, r - 1]
            if ends_free:
                cost_left = np.where(r == n[:, None], 0, cost_left)
                cost_up = np.where(c == m[:, None], 0, cost_up)
            left = last[:, p : q + 1] + cost_left
            up = last[:, p - 1 : q] + cost_up
            diag = before[:, p - 1 : q] + np.where(x[:, r - 1] == y[:, c - 1], match, mismatch)
            is_up = (up >= diag) & (up >= left)
            is_left = ~is_up & (left >= diag)
            best = np.where(is_up, up, np.where(is_left, left, diag))
            moves[d, :, p : q + 1] = np.where(is_up, UP, np.where(is_left, LEFT, DIAG))
            if band >= 0:
                best = np.where((r - c > below[:, None]) | (c - r > above[:, None]), _FAR, best)
            now[:, p : q + 1] = best
        if lo == 0:
            now[:, 0], moves[d, :, 0] = top[:, d], LEFT
            if band >= 0:
                now[:, 0] = np.where(d > above, _FAR, now[:, 0])
        if hi == d:
            now[:, d], moves[d, :, d] = side[:, d], UP
            if band >= 0:
                now[:, d] = np.where(d > below, _FAR, now[:, d])
        before, last = last, now
    r, c = n.copy(), m.copy()
    pairs = np.full((2, k, rows + cols), ord("-"), np.uint8)
    length, each = np.zeros(k, np.int64), np.arange(k)
    while (open_ := (r > 0) | (c > 0)).any():
        e = each[open_]
        step = moves[r[e] + c[e], e, r[e]]
        takes_a, takes_b = step != LEFT, step != UP
        pairs[0, e[takes_a], length[e[takes_a]]] = x[e[takes_a], r[e[takes_a]] - 1]
        pairs[1, e[takes_b], length[e[takes_b]]] = y[e[takes_b], c[e[takes_b]] - 1]
        r[e] -= takes_a
        c[e] -= takes_b
        length[e] += 1
    return [tuple(pairs[s, j, : length[j]][::-1].tobytes().decode("ascii") for s in (0, 1)) for j in range(k)]


def _letters(al: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(s.encode("ascii"), np.uint8) for s in al)


def inner(al: tuple[str, str]) -> slice:
    """The columns between the gaps at both ends."""
    x, y = _letters(al)
    both = np.flatnonzero(x != 45), np.flatnonzero(y != 45)
    if not len(both[0]) or not len(both[1]):
        return slice(0, 0)
    return slice(max(both[0][0], both[1][0]), min(both[0][-1], both[1][-1]) + 1)


def evaluate(al: tuple[str, str]) -> tuple[int, int, int]:
    """(matches, mismatches, indels) between the gaps at both ends."""
    x, y = (v[inner(al)] for v in _letters(al))
    gaps = (x == 45) | (y == 45)
    same = (x == y) & ~gaps
    return int(same.sum()), int((~same & ~gaps).sum()), int(gaps.sum())


def consensus(al: tuple[str, str], prefer: int = 1, trim_overhang: bool = False) -> str:
    """Columns that agree, the letter against a gap, and of different letters the preferred side's. Overhang: what the second one has before the first begins, and the first after the second ends."""
    x, y = (v.copy() for v in _letters(al))
    out = np.where(x == y, x, np.where(x == 45, y, np.where(y == 45, x, x if prefer == 1 else y)))
    if trim_overhang and len(out):
        has_x, has_y = np.flatnonzero(x != 45), np.flatnonzero(y != 45)
        out[: has_x[0] if len(has_x) else len(out)] = 45
        out[has_y[-1] + 1 if len(has_y) else 0 :] = 45
    return out[out != 45].tobytes().decode("ascii")


def coverage(al: tuple[str, str], one_off: bool = False, max_shift: int = 16) -> tuple[int, int, int, int]:
    """How much of the query (first) a parent (second) covers from the left and from the right: (left, right, left and right with one difference stepped over).

    Letters of the query beyond the parent's ends count as covered, up to max_shift columns at the left and one column
    less at the right (none there if the alignment has fewer than max_shift columns); then equal columns do, to the first
    difference.
    """
    x, y = _letters(al)
    size = len(x)

    def side(x: np.ndarray, y: np.ndarray, most: int) -> tuple[int, int]:
        own = np.flatnonzero(x != 45)
        pos = int(own[0]) if len(own) else size
        other = np.flatnonzero(y[pos:] != 45)
        credit = max(0, min(pos + int(other[0]) if len(other) else size, most) - pos)
        pos += credit
        differ = np.flatnonzero(x[pos:] != y[pos:])
        run = int(differ[0]) if len(differ) else size - pos
        total, off = credit + run, 0
        if one_off:
            off, at = total, pos + run + 1
            if at < size and x[at] != 45:
                off += 1
            rest = np.flatnonzero(x[at:] != y[at:]) if at < size else np.zeros(0, int)
            off += (int(rest[0]) if len(rest) else size - at) if at < size else 0
        return total, off

    left, left_off = side(x, y, max_shift)
    right, right_off = side(x[::-1], y[::-1], max_shift - 1 if size >= max_shift else 0)
    return left, right, left_off, right_off


def most_covered(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray, max_shift: int = 16, gapless: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (a[i], b[j]) the most that ``coverage`` can give from the left and from the right, whatever their alignment in a band of max_shift: the run of equal letters that begins at an end lies on one diagonal, so the best diagonal bounds it. gapless: of the main diagonal alone, which is then exact."""
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, n = _codes(a, max(map(len, a)))
    y, m = _codes(b, max(map(len, b)))
    x_end, y_end = (_codes([s[::-1] for s in v], w.shape[1])[0] for v, w in ((a, x), (b, y)))
    n, m = n[i], m[j]
    low, high = (np.zeros(len(i), np.int64),) * 2 if gapless else (-(max_shift + np.maximum(n - m, 0)), max_shift + np.maximum(m - n, 0))
    out = []
    for p, q, most in ((x, y, max_shift), (x_end, y_end, max_shift - 1)):
        best = np.where(low < -most, most, 0)
        for s in range(max(int(low.min()), -most), int(high.max()) + 1):
            skip, lead = (0, s) if s >= 0 else (-s, 0)  # letters of the query that count as covered, letters of the parent before the query
            width = min(p.shape[1] - skip, q.shape[1] - lead)
            on = np.flatnonzero((low <= s) & (s <= high))
            if width <= 0 or not len(on):
                continue
            differ = p[i[on], skip : skip + width] != q[j[on], lead : lead + width]
            run = np.where(differ.any(1), differ.argmax(1), width)
            run = np.minimum(run, np.minimum(n[on] - skip, m[on] - lead))
            best[on] = np.maximum(best[on], np.minimum(skip + np.maximum(run, 0), n[on]))
        out.append(best)
    return out[0], out[1]


def _words(on: np.ndarray, words: int) -> list[np.ndarray]:
    """Rows of booleans as ``words`` arrays of 64 bits each, the first column in the lowest bit."""
    wide = np.zeros((len(on), 64 * words), bool)
    wide[:, : on.shape[1]] = on
    return list(np.packbits(wide, axis=1, bitorder="little").view("<u8").astype(np.uint64).T)


_ABOVE = np.array([(2**64 - 1 << k) % 2**64 for k in range(65)], np.uint64)


def _first_set(bits: list[np.ndarray], start: np.ndarray | int = 0) -> np.ndarray:
    """The lowest bit that is set, from ``start`` on; the number of bits if none is."""
    out = np.int16(64 * len(bits))
    for w in reversed(range(len(bits))):
        v = bits[w] if isinstance(start, int) else bits[w] & _ABOVE[np.clip(start - 64 * w, 0, 64)]
        out = np.where(v != 0, np.bitwise_count((v & -v) - np.uint64(1)) + np.int16(64 * w), out)
    return out


def most_covered_one_off(a: list[str], b: list[str], max_shift: int = 16, distance: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each a[i] with each b[j] the most that ``coverage`` with one_off can give (left, right, left and right with one difference stepped over), and whether they may have ``distance`` differences: five tables of len(a) rows.

    As in ``most_covered`` the first run lies on one diagonal, and it may as well be taken to its end: after the difference
    the alignment is on the same diagonal or on one beside it, and a run there that began earlier goes on to the same end. With
    a gap in the query the column counts although the query has no letter there. Sequences of one length with fewer than
    ``distance`` different letters have fewer differences in their best alignment too: it has a score of 5 for each letter less
    at least 9 for each difference, and the diagonal less exactly 9.

    Letters that differ are bits, so 64 of them are compared at once.
    """
    codes_a, n = _codes(a, max(map(len, a), default=0))
    codes_b, m = _codes(b, max(map(len, b), default=0))
    words = (max(codes_a.shape[1], 1) + 64) // 64  # one bit more than letters, so that every row has a difference at its end
    width = 64 * words
    kinds = np.unique(np.concatenate([codes_a.ravel(), codes_b.ravel()]))
    planes = max(len(kinds) - 1, 1).bit_length()
    below, above = max_shift + np.maximum(n[:, None] - m, 0), max_shift + np.maximum(m - n[:, None], 0)
    even = bool((n[:, None] == m).all())
    k = np.arange(width)
    out = [np.zeros((len(a), len(b)), np.int16) for _ in range(4)]
    far = np.ones((len(a), len(b)), bool)
    if not far.size:
        return *out, far
    chunk = max(1, 32_768 // len(b))
    for side, most in enumerate((max_shift, max_shift - 1)):
        x, y = (codes_a, codes_b) if not side else (_codes([s[::-1] for s in v], c.shape[1])[0] for v, c in ((a, codes_a), (b, codes_b)))
        x, y = np.searchsorted(kinds, x), np.searchsorted(kinds, y)
        own = [_words(x >> p & 1, words) for p in range(planes)]
        over = _words(k >= n[:, None], words)
        low, high = max(-int(below.max()), -most - 1), int(above.max())
        other = {}
        for s in range(low - 1, high + 2):  # diagonals: letter k of the query with letter k + s of the parent
            inside = (k + s >= 0) & (k + s < y.shape[1])
            moved = np.zeros((len(b), width), y.dtype)
            moved[:, inside] = y[:, (k + s)[inside]]
            other[s] = [_words(moved >> p & 1, words) for p in range(planes)], _words((k + s >= m[:, None]) | ((k >= most) & (k < -s)), words), [v[0] for v in _words((k >= min(-s, most))[None, :], words)]

        for lo in range(0, len(a), chunk):
            at = slice(lo, lo + chunk)

            def differ(s: int) -> list[np.ndarray]:
                letters, ended, counts = other[s]  # noqa: B023
                found = []
                for w in range(words):
                    d = own[0][w][at, None] ^ letters[0][w]  # noqa: B023
                    for p in range(1, planes):
                        d |= own[p][w][at, None] ^ letters[p][w]  # noqa: B023
                    d &= counts[w]
                    d |= ended[w]
                    d |= over[w][at, None]  # noqa: B023
                    found.append(d)
                return found

            shape = (len(n[at]), len(b))
            best, best_off = (np.zeros(shape, np.int16) for _ in range(2))
            if low > -int(below.max()):  # farther diagonals have only what counts before the parent begins
                beyond = below[at] > most
                best, best_off = np.where(beyond, np.int16(most), best), np.where(beyond, np.int16(most + 1), best_off)
            left, here = differ(low - 1), differ(low)
            for s in range(low, high + 1):
                right = differ(s + 1)
                end = _first_set(here)
                off = np.maximum(_first_set(here, end + np.int16(1)), np.maximum(_first_set(left, end + np.int16(1)), _first_set(right, end) + np.int16(1)))
                if not even:
                    on = (-below[at] <= s) & (s <= above[at])
                    end, off = np.where(on, end, 0), np.where(on, off, 0)
                np.maximum(best, end, out=best)
                np.maximum(best_off, off, out=best_off)
                if s == 0 and not side:
                    differences = sum(np.bitwise_count(v).astype(np.int64) for v in here) - (width - n[at])[:, None]
                    far[at] = (n[at, None] != m) | (differences >= distance)
                left, here = here, right
            out[side][at], out[2 + side][at] = best, best_off
    return *out, far
