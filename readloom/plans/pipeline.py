"""Whole pipelines: from reads to a table of variants and their lineages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import errors as E
from readloom.cluster import write_table
from readloom.operators import chimera, derep, pairs, qc, taxonomy
from readloom.operators.denoise import Denoised, denoise, learn_errors
from readloom.options import Options


@dataclass(frozen=True)
class Study:
    """report: reads in and out of each sample; table: (sample, seq, abundance) without chimeras; model: the error rates that were learned; taxa: lineages of the table's sequences, or None."""

    report: DataFrame
    table: DataFrame
    model: Denoised
    denoised: Denoised
    taxa: DataFrame | None = None


def variants(reads: DataFrame, f: qc.Filter, n_bases: int = 100_000_000, error_function: Callable[[np.ndarray], np.ndarray] = E.loess_errors, pool: bool | str = False, refs: DataFrame | None = None, opt: Options = Options(), **how) -> Study:
    """reads: (sample, read_idx, id, seq, qual) of single reads. Filters, learns error rates, denoises, removes chimeras and, with refs (header, seq), classifies."""
    kept = write_table(qc.filter_reads(reads, f).select("sample", "read_idx", "seq", "qual"), "kept")
    uniques = write_table(derep.quality_arrays(kept), "uniques")
    model = learn_errors(kept, uniques, n_bases, error_function, opt)
    result = denoise(uniques, model.err_out, error_function, pool=pool, opt=opt)
    table = write_table(chimera.remove_chimeras(derep.sequence_table(result.denoised), **how), "table")
    taxa = taxonomy.classify(table.select("seq"), refs) if refs is not None else None
    return Study(qc.filter_report(reads, f), table, model, result, taxa)


@dataclass(frozen=True)
class PairedStudy:
    """As Study, for read pairs: models and denoised are those of the forward and of the reverse mates; merged has one row for each pair of clusters that was accepted."""

    report: DataFrame
    table: DataFrame
    models: tuple[Denoised, Denoised]
    denoised: tuple[Denoised, Denoised]
    merged: DataFrame
    taxa: DataFrame | None = None


def paired_variants(
    mates: DataFrame, fwd: qc.Filter, rev: qc.Filter, n_bases: int = 100_000_000, error_function: Callable[[np.ndarray], np.ndarray] = E.loess_errors, pool: bool | str = False, refs: DataFrame | None = None, opt: Options = Options(),
    merge: dict | None = None, **how,
) -> PairedStudy:
    """mates: (sample, read_idx, f, fq, r, rq) of read pairs, r as it was read. Filters pairs, learns error rates and denoises for each side by itself, merges, removes chimeras and, with refs (header, seq), classifies. merge: arguments of ``merge_denoised``; how: of ``remove_chimeras``."""
    kept = write_table(qc.filter_pairs(mates, fwd, rev).select("sample", "read_idx", "f", "fq", "r", "rq"), "kept-pairs")
    sides, models, results = [], [], []
    for seq, qual in (("f", "fq"), ("r", "rq")):
        reads = kept.select("sample", "read_idx", F.col(seq).alias("seq"), F.col(qual).alias("qual"))
        uniques = write_table(derep.quality_arrays(reads), "uniques")
        models.append(learn_errors(reads, uniques, n_bases, error_function, opt))
        results.append(denoise(uniques, models[-1].err_out, error_function, pool=pool, opt=opt))
        sides += [reads, results[-1].clusters, results[-1].unique_map]
    merged = write_table(pairs.merge_denoised(*sides, **(merge or {})), "merged")
    table = derep.sequence_table(merged.where("accept").select("sample", F.col("sequence").alias("seq"), "abundance"))
    table = write_table(chimera.remove_chimeras(table, **how), "table")
    taxa = taxonomy.classify(table.select("seq"), refs) if refs is not None else None
    report = mates.groupBy("sample").agg(F.count(F.lit(1)).alias("reads_in")).join(kept.groupBy("sample").agg(F.count(F.lit(1)).alias("reads_out")), "sample", "left").select("sample", "reads_in", F.coalesce("reads_out", F.lit(0)).alias("reads_out"))
    return PairedStudy(report, table, tuple(models), tuple(results), merged, taxa)
