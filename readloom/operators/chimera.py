"""Sequences made of two others, shifted copies, and tables without them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.cluster import spread, write_table
from readloom.kernels import align as A
from readloom.operators.overlaps import exact_overlaps
from readloom.operators.skew import skew_join

#: Scores of alignments in these tests.
SCORES = {"match": 5, "mismatch": -4, "gap": -8}
#: Children and parents that meet in one task.
BLOCK = 1024


def parent_counts(table: DataFrame, min_fold: float, min_abundance: int, inclusive: bool) -> DataFrame:
    """(sample, seq, n_parents): how many sequences of its sample are more than min_fold times as abundant and have at least (or more than) min_abundance; a sequence without any has no row.

    By abundances alone: a sample has few different ones, so no pairs of sequences are formed.
    """
    enough = F.col("abundance") >= min_abundance if inclusive else F.col("abundance") > min_abundance
    levels = table.groupBy("sample", "abundance").agg(F.count(F.lit(1)).alias("n"))
    at_most = levels.where(enough).select("sample", F.col("abundance").alias("_p"), F.col("n").alias("_n"))
    # what lies at or below fold * abundance isn't a parent: running totals over the different values of a sample
    marks = levels.select("sample", (F.col("abundance") * float(min_fold)).alias("v"), "abundance", F.lit(0).cast("long").alias("c")).unionByName(at_most.select("sample", F.col("_p").cast("double").alias("v"), F.lit(None).cast(levels.schema["abundance"].dataType).alias("abundance"), F.col("_n").alias("c")))
    w = Window.partitionBy("sample").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = marks.select("sample", "abundance", (F.sum("c").over(Window.partitionBy("sample")) - F.sum("c").over(w)).alias("n_parents")).where("abundance is not null and n_parents > 0")
    return table.select("sample", "seq", "abundance").join(run, ["sample", "abundance"]).select("sample", "seq", "n_parents")


def _eligible(children: pa.Table, parents: pa.Table, min_fold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (child, parent) as row numbers, of different sequences of which the second is abundant enough."""
    c, p = (t.column("abundance").to_numpy().astype(float) for t in (children, parents))
    ok = p[None, :] > c[:, None] * min_fold
    same = {s: k for k, s in enumerate(parents.column("seq").to_pylist())}
    for k, s in enumerate(children.column("seq").to_pylist()):
        if s in same:
            ok[k, same[s]] = False
    return np.nonzero(ok)


def _in_blocks(children: DataFrame, parents: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Every child against every parent of its sample, in blocks: a task has at most about BLOCK of each, whatever the size of the sample. No pairs are shuffled; the kernel returns what it found for each child.

    children and parents: (sample, seq, abundance) and bounds. Blocks are drawn by a hash of the sequence.
    """
    sides = children.withColumn("role", F.lit(0)).unionByName(parents.withColumn("role", F.lit(1)))
    sizes = write_table(sides.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), *(F.greatest(F.ceil(F.count_if(F.col("role") == r) / BLOCK), F.lit(1)).cast("int").alias(f"n{r}") for r in (0, 1))), "block-counts")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = skew_join(sides, sizes, ["sample"], "n", total, F.col("seq"))
    own, other = (F.when(F.col("role") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("n0", "n1"), ("n1", "n0")))
    sent = known.withColumn("_own", F.pmod(F.xxhash64("seq"), own).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), other - 1)))
    child_at = F.when(F.col("role") == 0, F.col("_own")).otherwise(F.col("_other"))
    sent = sent.select("sample", child_at.alias("cb"), F.when(F.col("role") == 0, F.col("_other")).otherwise(F.col("_own")).alias("pb"), "role", *children.columns[1:])
    names = [f.split()[0] for f in schema.split(", ")]

    def run(t: pa.Table) -> pa.Table:
        role = t.column("role").to_numpy()
        sides = [t.filter(pa.array(role == r)) for r in (0, 1)]
        return kernel(*sides).select(names)

    return spread(sent, "sample", "cb", "pb").groupBy("sample", "cb", "pb").applyInArrow(run, schema)


def _best(i: np.ndarray, v: np.ndarray, use: np.ndarray, n: int) -> pa.Array:
    """The largest v of each i among those to use; 0 without any."""
    out = np.zeros(n, np.int64)
    np.maximum.at(out, i[use], v[use])
    return pa.array(out)


#: What bounds a child's evidence with one difference stepped over: l, r of any parent, and l, r, lo, ro of those that may have enough differences.
ONE_OFF = ("ul", "ur", "ufl", "ufr", "ulo", "uro")


def _one_off_bounds(seqs: list[str], others: list[str], i: np.ndarray, j: np.ndarray, max_shift: int, distance: int) -> dict[str, np.ndarray]:
    """The bounds of pairs (seqs[i], others[j]) by the names of ONE_OFF."""
    if not len(i):
        return {x: np.zeros(0, np.int64) for x in ONE_OFF}
    left, right, left_off, right_off, far = (v[i, j] for v in A.most_covered_one_off(seqs, others, max_shift, distance))
    return dict(zip(ONE_OFF, (v.astype(np.int64) for v in (left, right, left * far, right * far, left_off * far, right_off * far)), strict=True))


def _coverages(seqs: list[str], others: list[str], i: np.ndarray, j: np.ndarray, one_off: bool, max_shift: int, distance: int) -> np.ndarray:
    """A row for each pair: the four numbers of ``coverage``, and whether it has enough differences."""
    found = np.zeros((len(i), 5), np.int64)
    for k in range(0, len(i), 4096):
        als = A.align([seqs[x] for x in i[k : k + 4096]], [others[x] for x in j[k : k + 4096]], band=max_shift, **SCORES)
        for at, al in enumerate(als, k):
            found[at, :4] = A.coverage(al, one_off, max_shift)
            found[at, 4] = one_off and sum(A.evaluate(al)[1:]) >= distance
    return found


def _evidence_of(i: np.ndarray, found: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    """l, r, fl, fr, lo, ro of each child from its pairs' coverages."""
    use = found[:, 0] + found[:, 1] < size[i]
    far = use & (found[:, 4] > 0)
    return [_best(i, found[:, at], on, len(size)) for at, on in zip((0, 1, 0, 1, 2, 3), (use, use, far, far, far, far), strict=True)]


def _measure_one_off(seqs: list[str], others: list[str], i: np.ndarray, j: np.ndarray, most: dict[str, np.ndarray], max_shift: int, distance: int) -> dict[str, pa.Array]:
    """l, r, fl, fr, lo, ro of each child. most: its bounds over all parents, also those of other blocks.

    Only pairs are aligned whose bounds reach the length of the child together with the best bound of the other side. First
    come, for each child and bound, the pairs with the most; a child that these make a chimera needs no others.
    """
    size = np.array([len(s) for s in seqs], np.int64)
    mine = _one_off_bounds(seqs, others, i, j, max_shift, distance)
    keep = np.zeros(len(i), bool)
    for a, b in (("ul", "ur"), ("ufl", "uro"), ("ulo", "ufr")):
        keep |= (mine[a] + most[b][i] >= size[i]) | (mine[b] + most[a][i] >= size[i])
    i, j, mine = i[keep], j[keep], {x: v[keep] for x, v in mine.items()}
    todo, found = np.ones(len(i), bool), np.zeros((len(i), 5), np.int64)
    found[:, 0] = size[i]  # a pair that isn't aligned is no evidence
    for turn in (1, 4, len(i)):
        now = np.zeros(len(i), bool)
        for v in mine.values():
            open_ = np.flatnonzero(todo)
            order = open_[np.lexsort((j[open_], -v[open_], i[open_]))]
            first = np.searchsorted(i[order], i[order])
            now[order[np.arange(len(order)) - first < turn]] = True
        found[now] = _coverages(seqs, others, i[now], j[now], True, max_shift, distance)
        l, r, fl, fr, lo, ro = out = _evidence_of(i, found, size)  # noqa: E741
        hit = np.zeros(len(size), bool)
        for a, b in ((l, r), (fl, ro), (lo, fr)):
            hit |= a.to_numpy() + b.to_numpy() >= size
        todo &= ~now & ~hit[i]
        if not todo.any():
            break
    return dict(zip(("l", "r", "fl", "fr", "lo", "ro"), out, strict=True))


def chimera_evidence(children: DataFrame, parents: DataFrame, min_fold: float, allow_one_off: bool = False, min_one_off_distance: int = 4, max_shift: int = 16, gapless: bool = False) -> DataFrame:
    """(sample, seq, n_parents, l, r, chimeric): what the best parent covers of a child from either side, and whether a left part of one parent and a right part of another make it up. Children without a parent have no row.

    children, parents: (sample, seq, abundance). An empty sequence is no chimera. A parent that covers all of the child alone is no evidence. With
    allow_one_off one difference may be stepped over, in parents with at least min_one_off_distance differences.

    First each pair gets a bound of what any alignment could cover (``most_covered``): a child whose bounds don't add up
    to its length is no chimera, and of the others only the pairs that could fill up the best of the rest are aligned. With
    allow_one_off the same holds of all three sums (``most_covered_one_off``), and pairs of a child are left out once aligned
    ones have made it a chimera. l and r are those of the aligned pairs, 0 where none was. gapless: sequences are laid on
    one another as they are.
    """
    names = ONE_OFF if allow_one_off else ("ul", "ur")
    shape = [F.lit(0).alias(x) for x in names]
    parents = parents.select("sample", "seq", "abundance", *shape)
    schema = "sample string, seq string, n_parents long, " + ", ".join(f"{x} long" for x in names)

    def bound(c: pa.Table, p: pa.Table) -> pa.Table:
        i, j = _eligible(c, p, min_fold)
        seqs, others = c.column("seq").to_pylist(), p.column("seq").to_pylist()
        size = np.array([len(s) for s in seqs], np.int64)
        counts = np.bincount(i, minlength=len(size))
        if allow_one_off:
            most = _one_off_bounds(seqs, others, i, j, max_shift, min_one_off_distance)
            out = pa.table({"sample": c.column("sample"), "seq": c.column("seq"), "n_parents": pa.array(counts)} | {x: _best(i, v, np.ones(len(i), bool), len(size)) for x, v in most.items()})
            return out.filter(pa.array(counts > 0))
        left, right = (np.concatenate(v) for v in zip(*([np.zeros(0, np.int64)] * 2, *(A.most_covered(seqs, others, i[k : k + 20_000], j[k : k + 20_000], max_shift, gapless) for k in range(0, len(i), 20_000))), strict=True))
        use = left + right < size[i] if gapless else np.ones(len(i), bool)
        out = pa.table({"sample": c.column("sample"), "seq": c.column("seq"), "n_parents": pa.array(counts), "ul": _best(i, left, use, len(size)), "ur": _best(i, right, use, len(size))})
        return out.filter(pa.array(counts > 0))

    bounds = _in_blocks(children.select("sample", "seq", "abundance", *shape), parents, bound, schema)
    bounds = write_table(bounds.groupBy("sample", "seq").agg(F.sum("n_parents").alias("n_parents"), *[F.max(x).alias(x) for x in names]), "chimera-bounds")
    n = F.length("seq")
    if gapless:
        return bounds.select("sample", "seq", "n_parents", F.col("ul").cast("int").alias("l"), F.col("ur").cast("int").alias("r"), (F.col("ul") + F.col("ur") >= n).alias("chimeric"))
    may = F.col("ul") + F.col("ur") >= n
    if allow_one_off:
        may |= (F.col("ufl") + F.col("uro") >= n) | (F.col("ulo") + F.col("ufr") >= n)
    open_ = children.select("sample", "seq", "abundance").join(bounds.where(may).drop("n_parents"), ["sample", "seq"])
    covers = ("l", "r", "fl", "fr", "lo", "ro")

    def measure(c: pa.Table, p: pa.Table) -> pa.Table:
        i, j = _eligible(c, p, min_fold)
        seqs, others = c.column("seq").to_pylist(), p.column("seq").to_pylist()
        size = np.array([len(s) for s in seqs], np.int64)
        if not allow_one_off and len(i):
            ul, ur = (c.column(x).to_numpy() for x in ("ul", "ur"))
            keep = np.zeros(len(i), bool)
            for k in range(0, len(i), 20_000):
                a, b = i[k : k + 20_000], j[k : k + 20_000]
                left, right = A.most_covered(seqs, others, a, b, max_shift)
                keep[k : k + 20_000] = (left + ur[a] >= size[a]) | (right + ul[a] >= size[a])
            i, j = i[keep], j[keep]
        if allow_one_off:
            return pa.table({"sample": c.column("sample"), "seq": c.column("seq")} | _measure_one_off(seqs, others, i, j, {x: c.column(x).to_numpy() for x in names}, max_shift, min_one_off_distance))
        found = _coverages(seqs, others, i, j, False, max_shift, min_one_off_distance)
        return pa.table({"sample": c.column("sample"), "seq": c.column("seq")} | dict(zip(covers, _evidence_of(i, found, size), strict=True)))

    near = _in_blocks(open_, parents, measure, "sample string, seq string, " + ", ".join(f"{c} long" for c in covers))
    best = near.groupBy("sample", "seq").agg(*[F.max(c).alias(c) for c in covers])
    hit = (n > 0) & ((F.col("l") + F.col("r") >= n) | (F.col("fl") + F.col("ro") >= n) | (F.col("lo") + F.col("fr") >= n))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    return bounds.select("sample", "seq", "n_parents").join(best.select("sample", "seq", "l", "r", hit.alias("_hit")), ["sample", "seq"], "left").select("sample", "seq", "n_parents", none("l"), none("r"), F.coalesce("_hit", F.lit(False)).alias("chimeric"))


def _evidence(table: DataFrame, min_fold: float, enough: Column, **how) -> DataFrame:
    table = write_table(table.select("sample", "seq", "abundance"), "chimera-table")
    return chimera_evidence(table, table.where(enough), min_fold, **how)


def is_bimera(seq: str, parents: list[str], allow_one_off: bool = False, min_one_off_distance: int = 4, max_shift: int = 16) -> bool:
    """Is this sequence made of a left part of one of the parents and a right part of another?"""
    l = r = fl = fr = lo = ro = 0  # noqa: E741
    for al in A.align([seq] * len(parents), parents, band=max_shift, **SCORES):
        a, b, c, d = A.coverage(al, allow_one_off, max_shift)
        if a + b >= len(seq):
            continue
        l, r = max(l, a), max(r, b)  # noqa: E741
        if allow_one_off and sum(A.evaluate(al)[1:]) >= min_one_off_distance:
            fl, fr, lo, ro = max(fl, a), max(fr, b), max(lo, c), max(ro, d)
    return l + r >= len(seq) or fl + ro >= len(seq) or lo + fr >= len(seq) if len(seq) else False


def bimeras_of(seqs: DataFrame, parents: DataFrame, **how) -> DataFrame:
    """(seq, chimeric): ``is_bimera`` of every different seq against the same given parents (seq), in blocks. Arguments as in chimera_evidence."""
    one = lambda df, n: df.select(F.lit("").alias("sample"), "seq", F.lit(n).alias("abundance")).where("seq is not null").distinct()
    found = chimera_evidence(one(seqs, 0), one(parents, 1), 1.0, **how).select("seq", "chimeric")
    return seqs.select("seq").distinct().join(found, "seq", "left").select("seq", F.coalesce("chimeric", F.lit(False)).alias("chimeric"))


def chimeras_denovo(uniques: DataFrame, min_fold: float = 2, min_abundance: int = 8, **how) -> DataFrame:
    """(seq, chimeric) for uniques (seq, abundance): made of a left part of one parent and a right part of another. With fewer than two parents never."""
    table = uniques.groupBy("seq").agg(F.sum("abundance").alias("abundance")).withColumn("sample", F.lit(""))
    flags = _evidence(table, min_fold, F.col("abundance") > min_abundance, **how).where("n_parents >= 2")
    return table.join(flags.select("seq", "chimeric"), "seq", "left").select("seq", F.coalesce("chimeric", F.lit(False)).alias("chimeric"))


def chimera_votes(table: DataFrame, min_fraction: float = 0.9, ignore: int = 1, min_fold: float = 1.5, min_abundance: int = 2, **how) -> DataFrame:
    """(seq, n_flagged, n_samples, chimeric): each sample that holds a sequence votes on it."""
    table = table.where("abundance > 0")
    flags = _evidence(table, min_fold, F.col("abundance") >= min_abundance, **how).select("sample", "seq", "chimeric")
    votes = table.join(flags, ["sample", "seq"], "left").groupBy("seq").agg(F.count_if(F.coalesce("chimeric", F.lit(False))).alias("n_flagged"), F.count(F.lit(1)).alias("n_samples"))
    f, n = F.col("n_flagged"), F.col("n_samples")
    return votes.withColumn("chimeric", (f >= n) | ((f > 0) & (f >= (n - ignore) * F.lit(float(min_fraction)))))


def remove_chimeras(table: DataFrame, method: str = "consensus", **how) -> DataFrame:
    """(sample, seq, abundance) without chimeras: by 'consensus' of the samples, over all 'pooled', or in each sample for itself ('per-sample')."""
    if method == "consensus":
        bad = chimera_votes(table, **how).where("chimeric").select("seq")
        return table.join(bad, "seq", "left_anti").select("sample", "seq", "abundance")
    if method == "pooled":
        bad = chimeras_denovo(table, **how).where("chimeric").select("seq")
        return table.join(bad, "seq", "left_anti").select("sample", "seq", "abundance")
    if method == "per-sample":
        fold, least = how.pop("min_fold", 2), how.pop("min_abundance", 8)
        bad = _evidence(table, fold, F.col("abundance") > least, **how).where("n_parents >= 2 and chimeric").select("sample", "seq")
        return table.join(bad, ["sample", "seq"], "left_anti").select("sample", "seq", "abundance")
    raise ValueError(method)


def shifted(uniques: DataFrame, min_overlap: int = 20, flag_subseqs: bool = False) -> DataFrame:
    """(seq, shifted): aligns with a more abundant sequence without a difference over at least min_overlap letters, but over less than either's length (a part of it only with ``flag_subseqs``).

    Only pairs that agree exactly on some diagonal are aligned: the others can't align without a difference.
    """
    table = uniques.groupBy("seq").agg(F.sum("abundance").alias("abundance"))
    near = exact_overlaps(table, min_overlap)
    either = near.select(F.col("a").alias("child"), F.col("b").alias("parent")).unionByName(near.select(F.col("b").alias("child"), F.col("a").alias("parent")))
    more = either.join(table.select(F.col("seq").alias("child"), F.col("abundance").alias("_c")), "child").join(table.select(F.col("seq").alias("parent"), F.col("abundance").alias("_p")), "parent").where("_p > _c")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ev = [A.evaluate(x) for x in A.align(b.child.tolist(), b.parent.tolist(), **SCORES)]
            hit = [m >= min_overlap and not x + g and (m < len(c) or flag_subseqs) and m < len(p) for (m, x, g), c, p in zip(ev, b.child, b.parent, strict=True)]
            yield pd.DataFrame({"seq": b.child, "hit": hit})

    hits = spread(more.select("child", "parent")).mapInPandas(run, "seq string, hit boolean").where("hit").select("seq").distinct().withColumn("_h", F.lit(True))
    return table.join(hits, "seq", "left").select("seq", F.coalesce("_h", F.lit(False)).alias("shifted"))


def collapse_no_mismatch(table: DataFrame, min_overlap: int = 20, identical_only: bool = False, band: int = -1) -> DataFrame:
    """(sample, seq, abundance): sequences that differ from a more abundant one only by their length are counted as that one.

    Greedy by total abundance (then by sequence): a sequence goes to the first kept one from which it differs in no
    aligned letter and with which it shares its own or the other's first min_overlap letters. Only sequences that agree
    exactly on some diagonal can go together. Whether one is kept depends on the more abundant ones it could go to: those
    that wait for nobody are settled first, then those that wait for them, and so on; each round is a join over all that are
    still open, and no block of sequences is gathered in one task.
    """
    if identical_only:
        return table.groupBy("sample", "seq").agg(F.sum("abundance").alias("abundance"))
    totals = write_table(table.groupBy("seq").agg(F.sum("abundance").cast("long").alias("total")), "totals")
    near = exact_overlaps(totals, min_overlap)
    for c in ("a", "b"):
        near = near.join(totals.select(F.col("seq").alias(c), F.struct(-F.col("total"), "seq").alias(f"_{c}")), c)
    child, parent = F.greatest("_a", "_b"), F.least("_a", "_b")
    near = near.select(child["seq"].alias("child"), parent["seq"].alias("parent"), parent["col1"].alias("minus"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            same = [not sum(A.evaluate(x)[1:]) for x in A.align(b.child.tolist(), b.parent.tolist(), band=band, **SCORES)]
            yield b[same]

    links = write_table(spread(near).mapInPandas(run, "child string, parent string, minus long"), "collapse-links")
    # into: what a sequence that could go to another went to (itself: kept); null while that is open
    state = write_table(links.groupBy(F.col("child").alias("seq")).agg(F.count(F.lit(1)).alias("_n")).select("seq", F.lit(None).cast("string").alias("into")), "collapse")
    while not state.where("into is null").isEmpty():
        # a parent that is no child is kept; a settled one is kept if it went to itself
        known = links.join(state.select(F.col("seq").alias("parent"), "into", F.lit(True).alias("_is")), "parent", "left")
        kept = F.col("_is").isNull() | (F.col("into") == F.col("parent"))
        seen = known.groupBy("child").agg(F.min(F.when(kept, F.struct("minus", "parent"))).alias("k"), F.min(F.when(F.col("_is") & F.col("into").isNull(), F.struct("minus", "parent"))).alias("u"))
        ready = F.col("u").isNull() | (F.col("k") < F.col("u"))
        now = state.join(seen.withColumnRenamed("child", "seq"), "seq").select("seq", F.when(F.col("into").isNull() & F.coalesce(ready, F.lit(False)), F.coalesce("k.parent", "seq")).otherwise(F.col("into")).alias("into"))
        state = write_table(now, "collapse")
    return table.join(state, "seq", "left").groupBy("sample", F.coalesce("into", "seq").alias("seq")).agg(F.sum("abundance").alias("abundance"))
