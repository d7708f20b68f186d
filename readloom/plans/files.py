"""From files to files, and from files to unique sequences. Paths are of a file system that all executors share."""

from __future__ import annotations

import os
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.cluster import write_table
from readloom.operators import derep, qc
from readloom.sources.fasta import FASTQ_ENDINGS, file_name, find_files, register

#: Fixed value: the quality given to letters of files that have none.
UNIFORM = 26


def read_fastq(spark: SparkSession, files: Sequence[str], whole: bool = False, quality: str = "auto") -> DataFrame:
    """(sample, read_idx, id, seq, qual) of all files, sample being a file's name without its ending. whole: no file is split, so read_idx counts reads and mates of two files have the same."""
    register(spark)
    out = None
    for folder in sorted({os.path.dirname(f) for f in files}):
        here = sorted(os.path.basename(f) for f in files if os.path.dirname(f) == folder)
        pattern = os.path.join(folder or ".", here[0]) if len(here) == 1 else os.path.join(folder or ".", "*")
        reader = spark.read.format("fastq").option("sampleName", "file").option("qualityOffset", quality)
        part = (reader.option("splitBytes", str(1 << 60)) if whole else reader).option("files", "\n".join(here)).load(pattern)
        out = part if out is None else out.unionByName(part)
    return out


def _inputs(given: str | Sequence[str]) -> list[str]:
    files = find_files(given, FASTQ_ENDINGS) if isinstance(given, str) else list(given)
    missing = [f for f in files if not os.path.exists(f)]
    if missing:
        raise FileNotFoundError(f"no such files: {missing[:5]}")
    if len({file_name(f) for f in files}) < len(files):
        raise ValueError("files must have different names")
    return files


def filter_and_trim(
    spark: SparkSession, fwd: str | Sequence[str], out: str, f: qc.Filter, rev: str | Sequence[str] | None = None, out_rev: str | None = None, f_rev: qc.Filter | None = None, match_ids: bool = False, compress: bool = True, quality: str = "auto"
) -> DataFrame:
    """Filters FASTQ files into the folder ``out``, and mates into ``out_rev``; returns (file, reads_in, reads_out), one row for each input file (the forward one).

    fwd, rev: a folder, a pattern, a file, or a list of files; the k-th file of rev (in order of names) holds the mates of
    the k-th of fwd, at the same places in the file or, with ``match_ids``, under the same read names. The output has a file
    (or several, one for each task) name_N.fastq.gz for each input file; one of which no read is left has none. Output
    folders must differ from each other and from those of the inputs, and are overwritten.
    """
    files = sorted(_inputs(fwd))
    sources = {os.path.abspath(os.path.dirname(x)) for x in files}
    mates = None
    if rev is not None:
        if out_rev is None:
            raise ValueError("a folder for the reverse reads is required")
        mates = sorted(_inputs(rev))
        if len(mates) != len(files):
            raise ValueError("forward and reverse files must correspond")
        sources |= {os.path.abspath(os.path.dirname(x)) for x in mates}
    targets = [os.path.abspath(x) for x in (out, out_rev) if x is not None]
    if len(set(targets)) < len(targets) or sources & set(targets):
        raise ValueError("output folders must differ from each other and from those of the inputs")
    names = [file_name(x) for x in files]
    reads = read_fastq(spark, files, mates is not None, quality)
    if mates is None:
        flagged = write_table(qc.flag_reads(reads, f).select("sample", "read_idx", "id", "seq", "qual", F.col("_keep").alias("keep")), "flagged")
        kept, counted = flagged.where("keep"), flagged
        sides = [(kept.select("sample", "read_idx", "id", "seq", "qual"), out, names)]
    else:
        # the files of both lists are known to the driver, and so is which belongs to which
        of = spark.createDataFrame(list(zip([file_name(x) for x in mates], names, strict=True)), "sample string, own string")
        other = read_fastq(spark, mates, True, quality).join(F.broadcast(of), "sample")
        other = other.select(F.col("own").alias("sample"), "read_idx", F.col("id").alias("rid"), F.col("seq").alias("r"), F.col("qual").alias("rq"))
        fw = reads.select("sample", "read_idx", "id", F.col("seq").alias("f"), F.col("qual").alias("fq"))
        if match_ids:
            pairs = qc.match_ids(fw, other.drop("read_idx").withColumn("id", F.col("rid")))
        else:
            pairs = qc.pair_by_position(fw, other)
        kept = write_table(qc.filter_pairs(pairs, f, f_rev or f).select("sample", "read_idx", "id", "f", "fq", "rid", "r", "rq"), "kept-pairs")
        counted = fw.select("sample", F.lit(False).alias("keep")).unionByName(kept.select("sample", F.lit(True).alias("keep")))
        turn = dict(zip(names, [file_name(x) for x in mates], strict=True))
        sides = [(kept.select("sample", "read_idx", "id", F.col("f").alias("seq"), F.col("fq").alias("qual")), out, names)]
        back = spark.createDataFrame(list(turn.items()), "sample string, name string")
        sides.append((kept.join(F.broadcast(back), "sample").select(F.col("name").alias("sample"), "read_idx", F.col("rid").alias("id"), F.col("r").alias("seq"), F.col("rq").alias("qual")), out_rev, list(turn.values())))
    for df, folder, _ in sides:
        df.write.format("fastq").option("compress", str(compress).lower()).mode("overwrite").save(folder)
    own = F.count_if(~F.col("keep")) if mates is not None else F.count(F.lit(1))
    report = counted.groupBy(F.col("sample").alias("file")).agg(own.alias("reads_in"), F.count_if("keep").alias("reads_out"))
    every = spark.createDataFrame([(n,) for n in names], "file string")
    report = write_table(every.join(report, "file", "left").select("file", F.coalesce("reads_in", F.lit(0)).alias("reads_in"), F.coalesce("reads_out", F.lit(0)).alias("reads_out")), "report")
    empty, n = report.agg(F.count_if(F.col("reads_out") == 0), F.count(F.lit(1))).first()
    if empty:
        warnings.warn("no reads passed the filter" if empty == n else f"of {empty} files no read passed the filter", stacklevel=2)
    return report


def dereplicate_fastq(spark: SparkSession, files: str | Sequence[str], quality: str = "auto", in_errors: bool = False) -> tuple[DataFrame, DataFrame]:
    """((sample, seq, abundance, qual), (sample, read_idx, seq)) of FASTQ files: unique sequences with their mean qualities, and which sequence each read has."""
    reads = read_fastq(spark, _inputs(files), quality=quality)
    return derep.quality_arrays(reads, in_errors=in_errors), reads.select("sample", "read_idx", "seq")


def dereplicate_fasta(spark: SparkSession, path: str, quality: int = UNIFORM) -> DataFrame:
    """(sample, seq, abundance, qual) of FASTA files, every letter having the same quality."""
    register(spark)
    found = spark.read.format("fasta").option("sampleName", "file").load(path).where(F.length("seq") > 0)
    counted = found.groupBy("sample", "seq").agg(F.count(F.lit(1)).alias("abundance"))
    return counted.withColumn("qual", F.array_repeat(F.lit(float(quality)), F.length("seq")))
