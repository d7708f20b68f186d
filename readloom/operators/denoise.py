"""Denoising: unique sequences of samples to the sequences they came from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom import errors as E
from readloom.cluster import spread, write_table
from readloom.kernels import partition
from readloom.operators.derep import priors, samples_up_to
from readloom.options import Options

_CLUSTER = "cluster:int,sequence:string,abundance:bigint,n0:bigint,n1:bigint,nunq:int,pval:double,birth_from:int,birth_pval:double,birth_fold:double,birth_ham:int,birth_qave:double"
_TRANS = "nti:int,ntj:int,q:int,n:bigint"
_BIRTH = "pos:int,ref:string,sub:string,qual:double,clust:int"
_SCHEMA = f"sample string, clusters array<struct<{_CLUSTER}>>, map array<struct<seq:string,cluster:int,p:double>>, trans array<struct<{_TRANS}>>, births array<struct<{_BIRTH}>>, quals array<array<double>>"


@dataclass(frozen=True)
class Denoised:
    """clusters, birth_subs, trans, unique_map and cluster_quals, each with the column sample; err_in and err_out, the error matrices before and after; opt."""

    table: DataFrame
    err_in: np.ndarray
    err_out: np.ndarray
    opt: Options
    rounds: int = 1
    trace: tuple = ()

    def _each(self, col: str) -> DataFrame:
        return self.table.select("sample", F.explode(col).alias("x")).select("sample", "x.*")

    @property
    def clusters(self) -> DataFrame:
        return self._each("clusters")

    @property
    def unique_map(self) -> DataFrame:
        """(sample, seq, cluster, p); cluster is null for a sequence that wasn't corrected."""
        return self._each("map")

    @property
    def trans(self) -> DataFrame:
        return self._each("trans")

    @property
    def birth_subs(self) -> DataFrame:
        return self._each("births")

    @property
    def cluster_quals(self) -> DataFrame:
        """(sample, cluster, pos, mean_q)"""
        one = self.table.select("sample", F.posexplode("quals").alias("c", "q")).select("sample", (F.col("c") + 1).alias("cluster"), F.posexplode("q").alias("p", "mean_q"))
        return one.select("sample", "cluster", (F.col("p") + 1).alias("pos"), "mean_q")

    @property
    def denoised(self) -> DataFrame:
        """(sample, seq, abundance)"""
        return self.clusters.select("sample", F.col("sequence").alias("seq"), "abundance")

    def __repr__(self) -> str:
        return f"Denoised(rounds={self.rounds}, columns={self.table.columns})"


def _run(uniques: DataFrame, rates: np.ndarray, known: DataFrame | None, opt: Options) -> DataFrame:
    """known: (seq) of the sequences to expect."""
    given = uniques.sparkSession.sparkContext.broadcast(rates)
    flag = F.lit(False).alias("prior")
    if known is not None:
        uniques = uniques.join(known.select("seq").distinct().withColumn("_known", F.lit(True)), "seq", "left")
        flag = F.coalesce("_known", F.lit(False)).alias("prior")

    def kernel(table: pa.Table) -> pa.Table:
        err = given.value
        seqs = table.column("seq").to_pylist()
        quals = table.column("qual").to_pylist()
        if any(q is None for q in quals):
            quals = None
        else:
            top = int(max(max(q) for q in quals) + 0.5)
            if top >= err.shape[1]:  # qualities beyond the matrix have the rates of its last column
                err = np.hstack([err, np.repeat(err[:, -1:], top + 1 - err.shape[1], 1)])
        r = partition.denoise(seqs, np.array(table.column("abundance").to_pylist()), quals, err, np.array(table.column("prior").to_pylist()), opt)
        return pa.Table.from_pylist([{"sample": table.column("sample")[0].as_py(), "clusters": r["clusters"], "map": [{"seq": s, "cluster": c, "p": p} for s, c, p in zip(seqs, r["map"], r["p"], strict=True)], "trans": r["trans"], "births": r["births"], "quals": [q or [] for q in r["quals"]]}], schema=_arrow())

    ready = uniques.select("sample", "seq", F.col("abundance").cast("long").alias("abundance"), F.col("qual").cast("array<double>").alias("qual"), flag)
    return spread(ready, "sample").groupBy("sample").applyInArrow(kernel, _SCHEMA)


def _arrow() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    of = lambda s: pa.list_(pa.struct([(f.split(":")[0], kinds[f.split(":")[1]]) for f in s.split(",")]))
    return pa.schema([("sample", pa.string()), ("clusters", of(_CLUSTER)), ("map", of("seq:string,cluster:int,p:double")), ("trans", of(_TRANS)), ("births", of(_BIRTH)), ("quals", pa.list_(pa.list_(pa.float64())))])


def denoise(
    uniques: DataFrame, err: np.ndarray | None, error_function: Callable[[np.ndarray], np.ndarray] = E.loess_errors, self_consist: bool = False, pool: bool | str = False, prior: DataFrame | None = None, opt: Options = Options()
) -> Denoised:
    """uniques: (sample, seq, abundance, qual), qual being mean qualities or null.

    Each sample is one task, which holds its unique sequences; all rounds read one written table, and only the counts of
    transitions (at most 16 * 251 numbers) come to the driver. Without ``err`` a first round with all rates 1 and one
    cluster for each sample gives a first estimate. With ``self_consist`` rounds are repeated until the matrix is one
    that was there before, or MAX_CONSIST is reached. pool=True denoises all samples as one and hands the clusters back
    to them; 'pseudo' runs twice, the second time with the sequences found in several samples as expected. prior: (seq).

    Sequences with letters other than A, C, G, T raise ValueError; null sequences or abundances are left out.
    """
    if pool not in (True, False, "pseudo"):
        raise ValueError(pool)
    uniques = uniques.where("seq is not null and abundance > 0").select("sample", "seq", "abundance", "qual")
    if not opt.USE_QUALS:
        uniques = uniques.withColumn("qual", F.lit(None).cast("array<double>"))
        error_function = E.flat_errors
    uniques = write_table(uniques, "uniques")
    if not uniques.where(~F.col("seq").rlike(r"^[ACGT]+\z")).isEmpty():
        raise ValueError("sequences to denoise may have no letters but A, C, G, T")
    work = _pooled(uniques) if pool is True else uniques
    known = prior
    start = err is None
    if start:
        err = np.ones((16, 41))
    err = E.checked(err)
    err_in, seen, rounds = err, [], 0
    while True:
        rounds += 1
        first = start and rounds == 1
        done = write_table(_run(work, err, known, opt.with_(MAX_CLUST=1) if first else opt), "denoised")
        trans = E.to_matrix(done.select(F.explode("trans").alias("x")).select("x.*"), max(err.shape[1], 41))
        err_out = error_function(trans)
        if first:
            err_out[[0, 5, 10, 15]] = 1.0
            err, err_in = err_out, err_out
            if not self_consist:
                start = False
                continue
        elif pool == "pseudo" and rounds == 1 + start:
            table = done.select("sample", F.explode("clusters").alias("c")).select("sample", F.col("c.sequence").alias("seq"), F.col("c.abundance").alias("abundance"))
            found = priors(table, opt.PSEUDO_PREVALENCE, opt.PSEUDO_ABUNDANCE).select("seq")
            known = write_table(found if known is None else found.unionByName(known.select("seq")), "priors")
            err = err_out
            continue
        elif not self_consist or rounds >= opt.MAX_CONSIST or any(np.array_equal(err_out, s) for s in [err, *seen]):
            break
        seen.append(err)
        err = err_out
    if pool is True:
        done = _unpool(uniques, done)
    return Denoised(done, err_in, err_out, opt, rounds, tuple(float(np.abs(s - err_out).sum()) for s in seen))


def _pooled(uniques: DataFrame) -> DataFrame:
    """All samples as one: abundances added up, qualities weighted by them."""
    q = uniques.where("qual is not null").select("seq", "abundance", F.posexplode("qual").alias("p", "v")).groupBy("seq", "p").agg((F.sum(F.col("v") * F.col("abundance")) / F.sum("abundance")).alias("m"))
    q = q.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("qual"))
    return uniques.groupBy("seq").agg(F.sum("abundance").alias("abundance")).join(q, "seq", "left").withColumn("sample", F.lit("pool"))


def _unpool(uniques: DataFrame, done: DataFrame) -> DataFrame:
    """Clusters of the pool for each sample: those that it has reads in, with its own abundances and numbers."""
    pooled = done.select(F.explode("map").alias("m")).select("m.seq", F.col("m.cluster").alias("pool_cluster"), "m.p")
    clusters = done.select(F.explode("clusters").alias("c")).select("c.*").withColumnRenamed("cluster", "pool_cluster")
    own = uniques.join(pooled, "seq").select("sample", "seq", "abundance", "pool_cluster", "p")
    count = own.where("pool_cluster is not null").join(clusters.select("pool_cluster", F.col("sequence").alias("_s")), "pool_cluster").groupBy("sample", "pool_cluster").agg(F.sum("abundance").alias("abundance"), F.sum(F.when(F.col("seq") == F.col("_s"), F.col("abundance")).otherwise(0)).alias("n0"), F.count(F.lit(1)).cast("int").alias("nunq"))
    count = count.withColumn("cluster", F.row_number().over(Window.partitionBy("sample").orderBy("pool_cluster")))
    full = count.join(clusters.drop("abundance", "n0", "nunq"), "pool_cluster").groupBy("sample").agg(F.array_sort(F.collect_list(F.struct(*[x.split(":")[0] for x in _CLUSTER.split(",")]))).alias("clusters"))
    mapped = own.join(count.select("sample", "pool_cluster", "cluster"), ["sample", "pool_cluster"], "left").groupBy("sample").agg(F.collect_list(F.struct("seq", "cluster", "p")).alias("map"))
    # transitions and births are of the pool, and are not those of any sample
    return full.join(mapped, "sample").withColumns({"trans": F.array().cast(f"array<struct<{_TRANS}>>"), "births": F.array().cast(f"array<struct<{_BIRTH}>>"), "quals": F.array().cast("array<array<double>>")})


def learn_errors(reads: DataFrame, uniques: DataFrame, n_bases: int = 100_000_000, error_function: Callable[[np.ndarray], np.ndarray] = E.loess_errors, opt: Options = Options(), randomize: int | None = None) -> Denoised:
    """Rates learned from the first samples (in order, or with ``randomize`` in one drawn with that seed) that together have more than n_bases bases. Nothing is left uncorrected while learning."""
    first = samples_up_to(reads, n_bases, seed=randomize).select("sample")
    return denoise(uniques.join(first, "sample", "left_semi"), None, error_function, self_consist=True, opt=opt.with_(OMEGA_C=0.0))
