"""FASTA and FASTQ as data sources, and tables written as such files.

``spark.dataSource.register(FastaSource)``, then ``spark.read.format("fasta").load(path)``. A file is a partition; an
uncompressed FASTQ or FASTA file larger than ``splitBytes`` is split at record boundaries. Options: ``splitBytes``;
``qualityOffset`` (33, 64 or 'auto', see ``quality_offset``); ``sampleName`` ('prefix': a file's name up to the first '_' or
'.', or 'file': all of it but the ending). ``path`` may be a file, a folder or a pattern. Records are handed over as Arrow batches.
"""

from __future__ import annotations

import bz2
import glob
import gzip
import os
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from readloom.cluster import write_table
from readloom.operators.derep import with_rank

#: Endings tried in this order; the first with any file in a folder is taken for all.
FASTQ_ENDINGS = (".fastq.gz", ".fastq.bz2", ".fastq")


def find_files(path: str, endings: tuple[str, ...] = FASTQ_ENDINGS) -> list[str]:
    """Files of a folder with the first ending that any has; a file or pattern stands for itself. Raises FileNotFoundError if there is none."""
    if not os.path.isdir(path):
        found = sorted(glob.glob(path))
    else:
        by_ending = {e: f for e in endings if (f := sorted(glob.glob(os.path.join(glob.escape(path), f"*{e}"))))}
        if len(by_ending) > 1:
            warnings.warn(f"files with several endings in {path}; only those with {next(iter(by_ending))} are read", stacklevel=2)
        found = next(iter(by_ending.values()), [])
    if not found:
        raise FileNotFoundError(f"no sequence files in {path}")
    return found


def _open(path: str):
    return gzip.open(path, "rb") if path.endswith(".gz") else bz2.open(path, "rb") if path.endswith(".bz2") else open(path, "rb")


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int | None


def _parts(paths: list[str], split: int) -> list[Part]:
    out = []
    for p in paths:
        size = os.path.getsize(p)
        if p.endswith((".gz", ".bz2")) or size <= split:
            out.append(Part(p, 0, None))
        else:
            out += [Part(p, at, min(at + split, size)) for at in range(0, size, split)]
    return out


def _sample(path: str) -> str:
    """What a file's name says about its sample: the part before the first '_' or '.'."""
    return os.path.basename(path).split(".")[0].split("_")[0]


def file_name(path: str) -> str:
    """The name of a file without the ending that says it holds sequences."""
    name = os.path.basename(path)
    return next((name[: -len(e)] for e in (*FASTQ_ENDINGS, ".fq.gz", ".fq", ".fasta.gz", ".fa.gz", ".fasta", ".fa") if name.endswith(e)), name)


def fasta_records(f, start: int = 0, end: int | None = None) -> Iterator[tuple[str, str]]:
    """(header, sequence) of the records whose '>' lies in [start, end). Upper case; U is kept."""
    f.seek(start)
    if start:
        f.seek(start - 1)
        f.readline()  # the rest of a line that the part before begins
    header, parts = None, []
    while True:
        at = f.tell() if end is not None else 0
        line = f.readline()
        if not line or line.startswith(b">"):
            if header is not None:
                yield header, "".join(parts)
            if not line or (end is not None and at >= end):
                return
            header, parts = line[1:].decode().rstrip("\r\n"), []
        elif header is not None:
            parts.append(line.decode().strip().upper())


def fastq_records(f, start: int = 0, end: int | None = None) -> Iterator[tuple[str, str, str]]:
    """(id, sequence, quality letters) of the records that begin in [start, end). A record has four lines; a line that begins with '@' is a header if the one two later begins with '+'."""
    f.seek(start)
    if start:
        f.seek(start - 1)
        f.readline()
        while True:
            at = f.tell()
            line = f.readline()
            if not line:
                return
            if line.startswith(b"@"):
                f.readline()
                third = f.readline()
                f.seek(at)
                if third.startswith(b"+"):
                    break
                f.readline()
    while True:
        at = f.tell() if end is not None else 0
        if end is not None and at >= end:
            return
        name = f.readline()
        if not name:
            return
        if not name.strip():
            continue
        seq, plus, qual = f.readline(), f.readline(), f.readline()
        if not name.startswith(b"@") or not plus.startswith(b"+"):
            raise ValueError(f"not a FASTQ record: {name[:60]!r}")
        yield name[1:].decode().rstrip("\r\n"), seq.decode().strip().upper(), qual.decode().rstrip("\r\n")


#: Records of one Arrow batch.
BATCH = 4096


def quality_offset(f) -> int:
    """From which number the letters of a file's qualities count: 64 if no letter in the whole file lies below ';' and some lie above 'J', else 33. The first letter below ';' decides; where there is none the file is read to its end."""
    high = False
    for _, _, qual in fastq_records(f):
        if qual and min(qual) < ";":
            return 33
        high = high or (bool(qual) and max(qual) > "J")
    return 64 if high else 33


class _Reader(DataSourceReader):
    def __init__(self, options: dict, endings: tuple[str, ...]):
        self.paths = find_files(options["path"], endings)
        if options.get("files"):  # only these names of what the path has
            wanted = set(options["files"].split("\n"))
            self.paths = [f for f in self.paths if os.path.basename(f) in wanted]
        self.split = int(options.get("splitBytes", 128 << 20))
        self.offset = options.get("qualityOffset", "auto")
        self.sample = _sample if options.get("sampleName", "prefix") == "prefix" else file_name

    def partitions(self):
        return _parts(self.paths, self.split)

    def read(self, p: Part) -> Iterator[pa.RecordBatch]:
        with _open(p.path) as f:
            records = self.records(f, p)
            while rows := list(islice(records, BATCH)):
                yield self.batch(p, rows)


class _FastaReader(_Reader):
    def records(self, f, p: Part) -> Iterator[tuple]:
        return fasta_records(f, p.start, p.end)

    def batch(self, p: Part, rows: list[tuple]) -> pa.RecordBatch:
        header, seq = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([self.sample(p.path)] * len(rows)), pa.array(header, pa.string()), pa.array(seq, pa.string())], ["sample", "header", "seq"])


class _FastqReader(_Reader):
    def records(self, f, p: Part) -> Iterator[tuple]:
        self.base = quality_offset(f) if self.offset == "auto" else int(self.offset)
        self.at = p.start * 1_000_000
        return fastq_records(f, p.start, p.end)

    def batch(self, p: Part, rows: list[tuple]) -> pa.RecordBatch:
        name, seq, qual = zip(*rows, strict=True)
        letters = np.frombuffer("".join(qual).encode("latin-1"), np.uint8).astype(np.int16) - self.base
        ends = np.concatenate([[0], np.cumsum([len(q) for q in qual])]).astype(np.int32)
        index = np.arange(self.at, self.at + len(rows))
        self.at += len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.sample(p.path)] * len(rows)), pa.array(index, pa.int64()), pa.array(name, pa.string()), pa.array(seq, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(letters.astype(np.int8)))], ["sample", "read_idx", "id", "seq", "qual"]
        )


class FastaSource(DataSource):
    """(sample, header, seq)"""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "sample string, header string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _FastaReader(self.options, (".fasta.gz", ".fa.gz", ".fasta", ".fa"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, "fasta", overwrite)


class FastqSource(DataSource):
    """(sample, read_idx, id, seq, qual). read_idx grows with the place in the file."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "sample string, read_idx long, id string, seq string, qual array<tinyint>"

    def reader(self, schema) -> DataSourceReader:
        return _FastqReader(self.options, FASTQ_ENDINGS)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, "fastq", overwrite)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceWriter):
    """A file for each sample and partition: sample_part.fastq(.gz). A sample without rows has no file."""

    def __init__(self, options: dict, schema, kind: str, overwrite: bool):
        self.path, self.kind, self.names = options["path"], kind, schema.fieldNames()
        self.gz = str(options.get("compress", "true")).lower() == "true"
        os.makedirs(self.path, exist_ok=True)
        if overwrite:
            for f in glob.glob(os.path.join(glob.escape(self.path), f"*.{kind}*")):
                os.remove(f)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task, files = TaskContext.get().taskAttemptId(), {}
        try:
            for r in rows:
                sample = (r["sample"] if "sample" in self.names else None) or "all"
                if sample not in files:
                    name = os.path.join(self.path, f"{sample}_{task}.{self.kind}{'.gz' * self.gz}")
                    files[sample] = (name, gzip.open(name + ".part", "wt") if self.gz else open(name + ".part", "w"))
                out = files[sample][1]
                if self.kind == "fasta":
                    out.write(f">{r['header']}\n{r['seq']}\n")
                else:
                    out.write(f"@{r['id']}\n{r['seq']}\n+\n{''.join(chr(q + 33) for q in r['qual'])}\n")
        finally:
            for _, f in files.values():
                f.close()
        return _Written([name for name, _ in files.values()])

    def commit(self, messages) -> None:
        for m in messages:
            for name in m.files if m else []:
                os.rename(name + ".part", name)

    def abort(self, messages) -> None:
        for m in messages:
            for name in m.files if m else []:
                os.remove(name + ".part")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)
    spark.dataSource.register(FastqSource)


def uniques_to_fasta(uniques: DataFrame, header: Column | None = None) -> DataFrame:
    """(header, seq): headers sq1;size=9; in the order of abundance unless others are given. Repeated sequences stay apart."""
    ranked = with_rank(uniques, "i", F.desc("abundance"), F.col("seq"))
    return ranked.select((header if header is not None else F.concat(F.lit("sq"), F.col("i").cast("string"), F.lit(";size="), F.col("abundance").cast("string"), F.lit(";"))).alias("header"), "seq")


def _mothur_lines(table: DataFrame) -> DataFrame:
    """(line_no, line): the head and a line for each sample. Each line has a number for every sequence, as the layout asks, made from the sample's own rows; there is no column for each sequence in any plan."""
    from readloom.operators.derep import column_order

    order = write_table(column_order(table).select("seq", "col"), "otu-columns")
    n = order.count()
    head = order.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "seq"))), lambda x: x["seq"]), " ").alias("s")).select(F.lit("").alias("line_no"), F.concat_ws(" ", F.lit("label Group numOtus"), F.nullif("s", F.lit(""))).alias("line"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for sample, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = ["0"] * n
                for c in cells:
                    counts[c["col"] - 1] = str(c["abundance"])
                out.append(" ".join(["all", sample, str(n), *counts]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["line_no", "line"])

    cells = table.groupBy("sample", "seq").agg(F.sum("abundance").alias("abundance")).join(order, "seq").groupBy("sample").agg(F.collect_list(F.struct("col", "abundance")).alias("cells"))
    return head.unionByName(cells.mapInArrow(lines, "line_no string, line string"))


def write_otu_table(table: DataFrame, path: str, layout: str) -> None:
    """A table of counts as text: 'qiime' (sequences as rows, tabs, '#OTU ID' first) or 'mothur' (samples as rows: label, Group, numOtus, counts)."""
    from readloom.operators.derep import pivot_samples

    if layout == "qiime":
        pivot_samples(table).withColumnRenamed("seq", "#OTU ID").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)
    elif layout == "mothur":
        _mothur_lines(table).coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)
    else:
        raise ValueError(layout)


def write_metadata(samples: DataFrame, path: str, id_col: str = "sample") -> None:
    """Sample metadata as tab-separated text whose first column is '#SampleID'."""
    samples.select(F.col(id_col).alias("#SampleID"), *[F.col(c).cast("string") for c in samples.columns if c != id_col]).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)
