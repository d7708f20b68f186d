"""Divisive partitioning of the unique sequences of a sample under an error model."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from readloom.kernels import align as A
from readloom.kernels.poisson import tail
from readloom.kernels.words import encode, word_numbers
from readloom.options import Options

K = 5
MAX_SHUFFLE = 10


@dataclass
class Cluster:
    members: list[int]
    center: int
    birth: dict = field(default_factory=dict)
    reads: int = 0
    stale: bool = True  # p-values have to be computed again
    unlocked: bool = True  # locks have to be set again
    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of the sequences compared with it
    rate: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ham: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Partition:
    """seqs in order of falling abundance. quals: mean qualities of each, or None. err: 16 rows (from * 4 + to) by quality."""

    def __init__(self, seqs: list[str], reads: np.ndarray, quals: list[np.ndarray] | None, err: np.ndarray, prior: np.ndarray, opt: Options):
        if any(len(s) <= K for s in seqs):
            raise ValueError(f"sequences must be longer than {K}")
        self.seqs, self.reads, self.prior, self.err, self.opt = seqs, reads.astype(np.int64), prior, err, opt
        self.n, self.total = len(seqs), int(reads.sum())
        self.length = np.array([len(s) for s in seqs])
        width = int(self.length.max())
        self.code = np.full((self.n, width), 4, np.int64)
        self.qual = np.zeros((self.n, width), np.int64)
        for i, s in enumerate(seqs):
            self.code[i, : len(s)] = encode(s)
            if quals is not None and opt.USE_QUALS:
                self.qual[i, : len(s)] = np.floor(np.asarray(quals[i], float) + 0.5)
        self.qual = np.minimum(self.qual, err.shape[1] - 1)
        words = [word_numbers(s, K) for s in seqs]
        self.words = np.full((self.n, width - K + 1), -1, np.int16)
        self.counts = np.zeros((self.n, 4**K), np.uint8)
        for i, w in enumerate(words):
            self.words[i, : len(w)] = w
            self.counts[i] = np.minimum(np.bincount(w[w >= 0], minlength=4**K), 255)
        self.best_rate = np.full(self.n, -999.0)  # the most reads expected of each from a centre so far
        self.p = np.ones(self.n)
        self.lock = np.zeros(self.n, bool)
        self.rate = np.zeros(self.n)
        self.ham = np.zeros(self.n, np.int64)
        self.clusters: list[Cluster] = []

    # --- comparisons

    def gapless_rate(self, center: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates and numbers of substitutions of sequences laid on the centre without gaps; beyond the centre's end they have no substitutions."""
        c, q, r = self.code[center], self.qual[which], self.code[which]
        n = np.minimum(self.length[which], self.length[center])
        at = np.arange(r.shape[1])
        base = np.where((at < n[:, None]) & (c < 4) & (r < 4), c, r)
        p = self.err[np.minimum(4 * base + r, 15), q]
        p = np.where(at < self.length[which][:, None], p, 1.0)
        return np.multiply.reduce(p, axis=1), ((base != r) & (at < n[:, None])).sum(1)

    def aligned(self, center: int, which: np.ndarray) -> list[tuple[str, str]]:
        o = self.opt
        return A.align([self.seqs[center]] * len(which), [self.seqs[i] for i in which], o.MATCH, o.MISMATCH, o.GAP_PENALTY, o.HOMOPOLYMER_GAP_PENALTY, o.BAND_SIZE)

    def transitions(self, al: tuple[str, str]) -> tuple[np.ndarray, int]:
        """For each letter of the second sequence the row of the error matrix, and how many are substitutions. An inserted letter counts as itself."""
        x, y = (encode(s) for s in al)
        gap_x, gap_y = (np.frombuffer(s.encode(), np.uint8) == 45 for s in al)
        base = np.where(gap_x | (x == 4) | (y == 4), y, x)
        kept = ~gap_y
        return (np.minimum(4 * base + y, 15))[kept], int((base != y)[kept].sum())

    def compare(self, center: int, which: np.ndarray, screen: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rate at which each of ``which`` arises from the centre, and substitutions; rate 0 for those screened out by their words."""
        o = self.opt
        rate, ham = np.zeros(len(which)), np.zeros(len(which), np.int64)
        if not len(which):
            return rate, ham
        places = np.minimum(self.length[which], self.length[center]) - K + 1
        shared = np.minimum(self.counts[which], self.counts[center]).sum(1, dtype=np.int64)
        near = np.ones(len(which), bool)
        if o.USE_KMERS and screen:
            near = 1 - shared / places <= o.KDIST_CUTOFF
        same = ((self.words[which] == self.words[center]) & (np.arange(self.words.shape[1]) < places[:, None])).sum(1)
        plain = near & (same == shared) if o.GAPLESS and o.USE_KMERS else np.zeros(len(which), bool)
        if o.BAND_SIZE == 0:
            plain = near
        if plain.any():
            rate[plain], ham[plain] = self.gapless_rate(center, which[plain])
        rest = np.flatnonzero(near & ~plain)
        for i, al in zip(rest, self.aligned(center, which[rest]), strict=True):
            row, ham[i] = self.transitions(al)
            rate[i] = np.multiply.reduce(self.err[row, self.qual[which[i], : len(row)]])
        return rate, ham

    def attach(self, i: int, screen: bool) -> None:
        """Compare all sequences that may matter with the centre of cluster i, and keep the results that could ever attract one."""
        c = self.clusters[i]
        able = np.ones(self.n, bool)
        if self.opt.GREEDY:
            able = (self.reads <= self.reads[c.center]) & ~self.lock
        rate, ham = np.zeros(self.n), np.zeros(self.n, np.int64)
        which = np.flatnonzero(able)
        rate[which], ham[which] = self.compare(c.center, which, screen)
        keep = rate * self.total > self.best_rate
        self.best_rate = np.where(keep, np.maximum(self.best_rate, rate * self.reads[c.center]), self.best_rate)
        c.index = np.flatnonzero(keep)
        c.rate, c.ham = rate[keep], ham[keep]
        mine = keep if i == 0 else keep & (np.arange(self.n) == c.center)
        self.rate[mine], self.ham[mine] = rate[mine], ham[mine]

    def rate_of(self, x: int, c: Cluster) -> float:
        """The kept rate of sequence x from a cluster's centre, 0 if it wasn't kept."""
        at = np.searchsorted(c.index, x)
        return float(c.rate[at]) if at < len(c.index) and c.index[at] == x else 0.0

    # --- the loop

    def shuffle(self) -> bool:
        """Move every sequence to the cluster that most of its reads are expected from; of equal ones to the earlier. Centres stay."""
        best, to = np.full(self.n, -1.0), np.zeros(self.n, np.int64)
        rate, ham = self.rate.copy(), self.ham.copy()
        for i, c in enumerate(self.clusters):
            e = c.rate * c.reads
            better = e > best[c.index]
            at = c.index[better]
            best[at], to[at], rate[at], ham[at] = e[better], i, c.rate[better], c.ham[better]
        moved = False
        for i, c in enumerate(self.clusters):
            for r in range(len(c.members) - 1, -1, -1):
                x = c.members[r]
                if to[x] != i and x != c.center:
                    self._pop(i, r)
                    self._add(int(to[x]), x)
                    self.rate[x], self.ham[x] = rate[x], ham[x]
                    moved = True
        return moved

    def _pop(self, i: int, r: int) -> int:
        c = self.clusters[i]
        x, last = c.members[r], c.members.pop()
        if r < len(c.members):
            c.members[r] = last
        c.reads -= int(self.reads[x])
        c.stale = True
        return x

    def _add(self, i: int, x: int) -> None:
        c = self.clusters[i]
        c.members.append(x)
        c.reads += int(self.reads[x])
        c.stale = True

    def update(self) -> None:
        """p-values of clusters whose reads changed, and locks of those with a new centre."""
        o = self.opt
        for c in self.clusters:
            m = np.array(c.members)
            if c.stale:
                mean = self.rate[m] * c.reads
                free = self.prior[m] | o.DETECT_SINGLETONS
                p = tail(self.reads[m], mean)
                norm = -np.expm1(-mean)
                norm = np.where(norm < 1e-7, mean - 0.5 * mean * mean, norm)
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = np.where(free, p, p / norm)
                p = np.where(self.rate[m] == 0, 0.0, p)
                p = np.where((self.ham[m] == 0) | ((self.reads[m] == 1) & ~free), 1.0, p)
                self.p[m] = p
                c.stale = False
            if o.GREEDY and c.unlocked:
                self.lock[m] |= (self.reads[c.center] * self.rate[m] > self.reads[m]) | (m == c.center)
                c.unlocked = False

    def bud(self) -> bool:
        """The least likely sequence that isn't a centre becomes the centre of a new cluster, if it is unlikely enough."""
        o = self.opt
        owner = np.concatenate([np.full(len(c.members) - 1, i) for i, c in enumerate(self.clusters)])
        place = np.concatenate([np.arange(1, len(c.members)) for c in self.clusters])
        x = np.concatenate([np.array(c.members[1:], np.int64) for c in self.clusters])
        if not len(x):
            return False
        ok = (self.reads[x] >= o.MIN_ABUNDANCE) & (self.ham[x] >= o.MIN_HAMMING)
        if o.MIN_FOLD > 1:
            ok &= self.reads[x] >= o.MIN_FOLD * self.rate[x] * np.array([c.reads for c in self.clusters])[owner]
        start = self.clusters[0].center
        for kind, among in (("A", ok), ("P", ok & self.prior[x])):
            # it must beat the first centre, by p and then by reads
            among = among & ((self.p[x] < self.p[start]) | ((self.p[x] == self.p[start]) & (self.reads[x] > self.reads[start])))
            if not among.any():
                continue
            at = np.flatnonzero(among)
            k = at[np.lexsort((at, -self.reads[x[at]], self.p[x[at]]))[0]]
            p = self.p[x[k]] * (self.n if kind == "A" else 1)
            if p < (o.OMEGA_A if kind == "A" else o.OMEGA_P):
                i, raw = int(owner[k]), int(x[k])
                mean = self.rate[raw] * self.clusters[i].reads
                self._pop(i, int(place[k]))
                birth = {"type": kind, "from": i, "pval": float(p), "fold": float(self.reads[raw] / mean) if mean else float("inf"), "ham": int(self.ham[raw])}
                self.clusters.append(Cluster([raw], raw, birth, int(self.reads[raw])))
                self.lock[raw] = False
                return True
        return False

    def run(self) -> None:
        self.clusters = [Cluster(list(range(self.n)), int(np.argmax(self.reads)), {}, self.total)]
        self.attach(0, screen=False)
        self.update()
        most = self.opt.MAX_CLUST or self.n
        while len(self.clusters) < most and self.bud():
            self.attach(len(self.clusters) - 1, screen=True)
            for _ in range(MAX_SHUFFLE):
                if not self.shuffle():
                    break
            self.update()


def denoise(seqs: list[str], reads: np.ndarray, quals: list[np.ndarray] | None, err: np.ndarray, prior: np.ndarray | None = None, opt: Options = Options()) -> dict:
    """Partition the uniques of one sample. Returns lists of plain values: clusters, map (cluster of each sequence in the order given, None if it isn't corrected), trans, births, quals (mean quality of each cluster by place) and p."""
    order = sorted(range(len(seqs)), key=lambda i: (-int(reads[i]), seqs[i]))
    prior = np.zeros(len(seqs), bool) if prior is None else prior
    b = Partition([seqs[i] for i in order], np.asarray(reads)[order], None if quals is None else [quals[i] for i in order], err, np.asarray(prior)[order], opt)
    b.run()
    right = np.ones(b.n, bool)
    p = np.ones(b.n)
    trans: dict[tuple[int, int], int] = {}
    clusters, births, quality = [], [], []
    owner = np.zeros(b.n, np.int64)
    for i, c in enumerate(b.clusters):
        m = np.array(c.members)
        owner[m] = i
        p[m] = np.where(m == c.center, 1.0, tail(b.reads[m], b.rate[m] * c.reads))
        right[m] = p[m] >= b.opt.OMEGA_C
    for i, c in enumerate(b.clusters):
        m = np.array(c.members)
        width = len(b.seqs[c.center])
        q_sum, q_n = np.zeros(width), np.zeros(width)
        ham = np.zeros(len(m), np.int64)
        for j, x, al in zip(range(len(m)), m, _final(b, c.center, m), strict=True):
            row, ham[j] = b.transitions(al)
            gap_x, gap_y = (np.frombuffer(s.encode(), np.uint8) == 45 for s in al)
            both = ~gap_x & ~gap_y
            read_place, centre_place = np.cumsum(~gap_y) - 1, np.cumsum(~gap_x) - 1
            if right[x]:
                rows, qs = row[read_place[both]], b.qual[x, read_place[both]]
                ok = (b.code[x, read_place[both]] < 4) & (b.code[c.center, centre_place[both]] < 4)
                key, n = np.unique(rows[ok] * 1000 + qs[ok], return_counts=True)
                for k, v in zip(key.tolist(), n.tolist(), strict=True):
                    trans[divmod(k, 1000)] = trans.get(divmod(k, 1000), 0) + v * int(b.reads[x])
                if quals is not None:
                    q_sum[centre_place[both]] += np.asarray(quals[order[x]], float)[read_place[both]] * b.reads[x]
                    q_n[centre_place[both]] += b.reads[x]
        good = right[m]
        others = sum(b.rate_of(c.center, o) * o.reads for k, o in enumerate(b.clusters) if k != i)
        clusters.append(
            {"cluster": i + 1, "sequence": b.seqs[c.center], "abundance": int(b.reads[m[good]].sum()), "n0": int(b.reads[m[good & (ham == 0)]].sum()), "n1": int(b.reads[m[good & (ham == 1)]].sum()), "nunq": int(good.sum()), "pval": float(tail(np.array([b.reads[c.center]]), np.array([others]))[0]),
             "birth_from": c.birth["from"] + 1 if c.birth else None, "birth_pval": c.birth.get("pval"), "birth_fold": c.birth.get("fold"), "birth_ham": c.birth.get("ham"), "birth_qave": None}
        )
        if c.birth:
            al = _final(b, b.clusters[c.birth["from"]].center, np.array([c.center]))[0]
            found = _substitutions(al)
            qs = [float(quals[order[c.center]][r]) if quals is not None else None for _, r, _, _ in found]
            births += [{"pos": k + 1, "ref": f, "sub": t, "qual": q, "clust": i + 1} for (k, _, f, t), q in zip(found, qs, strict=True)]
            clusters[-1]["birth_qave"] = float(np.mean(qs)) if found and quals is not None else None
        quality.append(np.where(q_n > 0, q_sum / np.maximum(q_n, 1), np.nan).tolist() if quals is not None else None)
    cluster_of: list[int | None] = [None] * b.n
    p_of = [0.0] * b.n
    for k, i in enumerate(order):
        cluster_of[i] = int(owner[k]) + 1 if right[k] else None
        p_of[i] = float(p[k])
    return {"clusters": clusters, "map": cluster_of, "trans": [{"nti": k[0] // 4, "ntj": k[0] % 4, "q": k[1], "n": v} for k, v in sorted(trans.items())], "births": births, "quals": quality, "p": p_of}


def _final(b: Partition, center: int, which: np.ndarray) -> list[tuple[str, str]]:
    """The best alignments, for the results. With at most two differences, none of them within three places of an end, no gap can pay under the default scores."""
    out: list[tuple[str, str] | None] = [None] * len(which)
    if (b.opt.MATCH, b.opt.MISMATCH, b.opt.GAP_PENALTY, b.opt.HOMOPOLYMER_GAP_PENALTY) == (5, -4, -8, None):
        for j, x in enumerate(which):
            differ = np.flatnonzero(b.code[x] != b.code[center])
            if b.length[x] == b.length[center] and len(differ) <= 2 and (not len(differ) or (differ[0] > 2 and differ[-1] < b.length[x] - 3)):
                out[j] = (b.seqs[center], b.seqs[x])
    rest = [j for j, o in enumerate(out) if o is None]
    for j, al in zip(rest, b.aligned(center, which[rest]), strict=True):
        out[j] = al
    return out


def _substitutions(al: tuple[str, str]) -> list[tuple[int, int, str, str]]:
    """(place in the first, place in the second, letter, letter) of columns with two different letters."""
    out, i, j = [], 0, 0
    for x, y in zip(*al, strict=True):
        if x != "-" and y != "-" and x != y and "N" not in (x, y):
            out.append((i, j, x, y))
        i += x != "-"
        j += y != "-"
    return out

