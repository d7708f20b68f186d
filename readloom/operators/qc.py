"""Quality control of reads: filters and trims in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import seq as S


@dataclass(frozen=True)
class Filter:
    """What a read must pass, in the order of the fields. A value of 0 or None turns a stage off where it would do nothing."""

    orient_fwd: str | None = None
    max_len: int | None = None
    trim_left: int = 0
    trim_right: int = 0
    trunc_q: int | None = 2
    trunc_len: int = 0
    min_len: int = 20
    max_n: int | None = 0
    min_q: int = 0
    max_ee: float | None = None
    contaminant: str | None = None
    low_complexity: float = 0.0


def _stage(df: DataFrame, keep: Column, seq: str, qual: str, start: Column | None = None, length: Column | None = None) -> DataFrame:
    """Narrow to the substring that begins at start (from 1) and note whether the read passes."""
    df = df.withColumn("_keep", F.col("_keep") & F.coalesce(keep, F.lit(False)))
    if start is not None:
        n = F.greatest(length, F.lit(0)) if length is not None else F.length(seq)
        s = F.greatest(start, F.lit(1))
        df = df.withColumns({seq: F.substring(F.col(seq), s, n), qual: F.slice(F.col(qual), s, n)})
    return df


def ring(genome: str, word: int) -> frozenset[str]:
    """The words of a circular genome."""
    closed = genome + genome[: word - 1]
    return frozenset(closed[i : i + word] for i in range(len(genome)))


def read_genome(path: str) -> str:
    """The letters of the first record of a FASTA file, such as that of a contaminant."""
    from readloom.sources.fasta import _open, fasta_records

    with _open(path) as f:
        return next(fasta_records(f))[1]


def contaminated(seq: Column, genome: str, word: int = 16, min_matches: int = 2, non_overlapping: bool = True) -> Column:
    """At least min_matches words of the read stand in the circular genome, or in its reverse complement."""
    flags = []
    for strand in (genome, genome[::-1].translate(str.maketrans("ACGT", "TGCA"))):
        flags.append(S.word_hits(seq, ring(strand, word), word, non_overlapping) >= min_matches)
    return flags[0] | flags[1]


def flag_reads(df: DataFrame, f: Filter, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """df with seq and qual trimmed and two more columns: _keep, whether the read passes, and _flipped, whether it was reverse-complemented.

    Reads with a null sequence never pass; those with a null quality pass unless a stage needs it (trunc_q, min_q, max_ee).
    Repeated reads are each judged; an empty table stays empty.
    """
    df = df.withColumns({"_keep": F.col(seq).isNotNull(), "_flipped": F.lit(False)})
    n = F.length(seq)
    if f.orient_fwd:
        p = f.orient_fwd
        fwd = F.startswith(F.col(seq), F.lit(p))
        back = ~fwd & F.startswith(S.reverse_complement(F.col(seq)), F.lit(p))
        df = df.withColumns({"_keep": F.col("_keep") & (fwd | back), "_flipped": F.coalesce(back, F.lit(False))})
        df = df.withColumns({seq: F.when(F.col("_flipped"), S.reverse_complement(F.col(seq))).otherwise(F.col(seq)), qual: F.when(F.col("_flipped"), F.reverse(qual)).otherwise(F.col(qual))})
    if f.max_len is not None:
        df = _stage(df, n <= f.max_len, seq, qual)
    if f.trim_left:
        df = _stage(df, n > f.trim_left, seq, qual, F.lit(f.trim_left + 1), n)
    if f.trim_right:
        df = _stage(df, n > f.trim_right, seq, qual, F.lit(1), n - f.trim_right)
    if f.trunc_q is not None:
        cut = S.first_at_most(F.col(qual), f.trunc_q)
        df = df.withColumn("_cut", F.when(cut > 0, cut - 1).when(cut == 0, n))
        df = _stage(df, F.col("_cut") > 0, seq, qual, F.lit(1), F.col("_cut")).drop("_cut")
    if f.trunc_len:
        end = f.trunc_len - f.trim_left
        df = _stage(df, n >= end, seq, qual, F.lit(1), F.lit(end))
    df = _stage(df, n >= f.min_len, seq, qual)
    if f.max_n is not None:
        df = _stage(df, S.count_ambiguous(F.col(seq)) <= f.max_n, seq, qual)
    if f.min_q > (f.trunc_q or 0):  # strictly more, and only where truncation doesn't see to it
        df = _stage(df, F.array_min(qual) > f.min_q, seq, qual)
    if f.max_ee is not None:
        df = _stage(df, S.expected_errors(F.col(qual)) <= f.max_ee, seq, qual)
    if f.contaminant:
        df = _stage(df, ~contaminated(F.col(seq), f.contaminant), seq, qual)
    if f.low_complexity > 0:
        df = _stage(df, S.complexity(F.col(seq)) >= f.low_complexity, seq, qual)
    return df


def filter_reads(df: DataFrame, f: Filter, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """The reads that pass, trimmed. No shuffle."""
    return flag_reads(df, f, seq, qual).where("_keep").drop("_keep", "_flipped")


def filter_report(df: DataFrame, f: Filter, by: str = "sample", seq: str = "seq", qual: str = "qual") -> DataFrame:
    """(by, reads_in, reads_out), also for samples of which nothing is left."""
    return flag_reads(df, f, seq, qual).groupBy(by).agg(F.count(F.lit(1)).alias("reads_in"), F.count_if("_keep").alias("reads_out"))


def pair_by_position(fwd: DataFrame, rev: DataFrame, on: Sequence[str] = ("sample", "read_idx")) -> DataFrame:
    """Mates at the same place of both files."""
    return fwd.join(rev, list(on))


def read_key(id_col: Column) -> Column:
    """The part of a read's name that both mates share: the blank-separated field with six colons, else the one with four, without what follows '#'. Null if there is none."""
    fields = F.split(id_col, " ")
    colons = lambda x, n: F.length(x) - F.length(F.replace(x, F.lit(":"), F.lit(""))) == n
    return F.coalesce(F.try_element_at(F.filter(fields, lambda x: colons(x, 6)), F.lit(1)), F.regexp_replace(F.try_element_at(F.filter(fields, lambda x: colons(x, 4)), F.lit(1)), "#.*", ""))


def match_ids(fwd: DataFrame, rev: DataFrame, id_col: str = "id") -> DataFrame:
    """Mates with the same name part within a sample. Reads without one, or without a mate, drop out."""
    a = fwd.withColumn("_key", read_key(F.col(id_col)))
    b = rev.select("sample", read_key(F.col(id_col)).alias("_key"), *[c for c in rev.columns if c not in ("sample", id_col)])
    return a.join(b, ["sample", "_key"]).drop("_key")


def filter_pairs(pairs: DataFrame, fwd: Filter, rev: Filter, cols: tuple[str, str, str, str] = ("f", "fq", "r", "rq")) -> DataFrame:
    """Pairs of which both mates pass. With an orientation probe, mates whose second read begins with it are swapped and none is reverse-complemented."""
    f, fq, r, rq = cols
    if fwd.orient_fwd:
        p = F.lit(fwd.orient_fwd)
        swap = ~F.startswith(F.col(f), p) & F.startswith(F.col(r), p)
        pairs = pairs.where(F.startswith(F.col(f), p) | F.startswith(F.col(r), p)).withColumn("_swap", swap)
        pairs = pairs.withColumns({x: F.when(F.col("_swap"), F.col(y)).otherwise(F.col(x)) for x, y in ((f, r), (r, f), (fq, rq), (rq, fq))}).drop("_swap")
    one = filter_reads(pairs, replace(fwd, orient_fwd=None, contaminant=None, low_complexity=0.0), f, fq)
    both = filter_reads(one, replace(rev, orient_fwd=None, contaminant=None, low_complexity=0.0), r, rq)
    for x, side in ((f, fwd), (r, rev)):
        if side.contaminant:
            both = both.where(~contaminated(F.col(x), side.contaminant))
        if side.low_complexity > 0:
            both = both.where(S.complexity(F.col(x)) >= side.low_complexity)
    return both
