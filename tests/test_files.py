"""From files to files, single and paired, and the readers behind it."""

import gzip
import random
import warnings
from collections import Counter

import pytest
from pyspark.sql import functions as F

from readloom.operators import qc
from readloom.operators.derep import dereplicate, quality_arrays, samples_up_to
from readloom.plans import files
from readloom.sources.fasta import find_files, quality_offset, register, write_otu_table

from .conftest import rows

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def put(path, records, zipped=True):
    text = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records)
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") if zipped else open(path, "w") as f:
        f.write(text)


def got(folder):
    out = []
    for p in sorted(folder.glob("*.gz")):
        lines = gzip.open(p, "rt").read().split("\n")[:-1]
        out += [(p.name.rsplit("_", 1)[0], *lines[i : i + 4 : 1][:2], lines[i + 3]) for i in range(0, len(lines), 4)]
    return sorted(out)


def test_single(spark, tmp_path):
    rng = random.Random(1)
    made = {}
    for name in ("a_1", "a_2", "empty"):
        made[name] = [(f"{name}:{k}", "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=30)) if name != "empty" else "N" * 30, "".join(rng.choices("#5I", k=30))) for k in range(20)]
        put(tmp_path / "in" / f"{name}.fastq.gz", made[name])
    f = qc.Filter(trunc_q=None, trunc_len=25, max_n=0)
    with pytest.warns(UserWarning, match="no read passed"):
        report = files.filter_and_trim(spark, str(tmp_path / "in"), str(tmp_path / "out"), f)
    keep = {n: [(n, i, s[:25], q[:25]) for i, s, q in r if "N" not in s[:25]] for n, r in made.items()}
    assert rows(report) == sorted((n, 20, len(k)) for n, k in keep.items())
    assert [(n, i[1:], s, q) for n, i, s, q in got(tmp_path / "out")] == sorted(r for k in keep.values() for r in k)
    assert not list((tmp_path / "out").glob("empty*"))
    uniques, reads = files.dereplicate_fastq(spark, str(tmp_path / "out"))
    assert uniques.agg(F.sum("abundance")).first()[0] == reads.count() == sum(map(len, keep.values()))


def test_paired(spark, tmp_path):
    rng = random.Random(2)
    want = []
    for name in ("x", "y"):
        fwd, rev = [], []
        for k in range(15):
            f, r = ("".join(rng.choices("ACGTN", [9, 9, 9, 9, 0.4], k=30)) for _ in range(2))
            fwd.append((f"{name}:{k}/1", f, "I" * 30))
            rev.append((f"{name}:{k}/2", r, "I" * 30))
            if "N" not in f[:20] + r[:22]:
                want.append((name, k, f[:20], r[:22]))
        put(tmp_path / "f" / f"{name}_F.fastq.gz", fwd)
        put(tmp_path / "r" / f"{name}_R.fastq.gz", rev)
    one, two = qc.Filter(trunc_len=20), qc.Filter(trunc_len=22)
    report = files.filter_and_trim(spark, str(tmp_path / "f"), str(tmp_path / "of"), one, str(tmp_path / "r"), str(tmp_path / "or"), two)
    n = Counter(w[0] for w in want)
    assert rows(report) == [("x_F", 15, n["x"]), ("y_F", 15, n["y"])]
    fwd = {(a[:-2], int(i.split(":")[1].split("/")[0])): s for a, i, s, _ in got(tmp_path / "of")}
    rev = {(a[:-2], int(i.split(":")[1].split("/")[0])): s for a, i, s, _ in got(tmp_path / "or")}
    assert fwd == {(a, k): f for a, k, f, _ in want} and rev == {(a, k): r for a, k, _, r in want}


def test_bad_paths(spark, tmp_path):
    put(tmp_path / "in" / "a.fastq.gz", [("a", "ACGT", "IIII")])
    f, here = qc.Filter(), str(tmp_path / "in")
    with pytest.raises(FileNotFoundError):
        files.filter_and_trim(spark, str(tmp_path / "nothing"), str(tmp_path / "o"), f)
    with pytest.raises(FileNotFoundError):
        files.filter_and_trim(spark, [here + "/a.fastq.gz", here + "/b.fastq.gz"], str(tmp_path / "o"), f)
    with pytest.raises(ValueError):
        files.filter_and_trim(spark, here, here, f)
    with pytest.raises(ValueError):
        files.filter_and_trim(spark, here, str(tmp_path / "o"), f, rev=here)
    put(tmp_path / "in" / "b.fastq", [("a", "ACGT", "IIII")], False)
    with pytest.warns(UserWarning, match="several endings"):
        assert len(find_files(here)) == 1


def test_encoding_is_of_the_whole_file(tmp_path):
    high = [("r", "ACGT", "hhhh")] * 3000
    put(tmp_path / "old.fastq", high, False)
    put(tmp_path / "new.fastq", [*high, ("r", "ACGT", "#hhh")], False)
    assert [quality_offset(open(tmp_path / n, "rb")) for n in ("old.fastq", "new.fastq")] == [64, 33]


def test_parts_of_a_plain_file(spark, tmp_path):
    rng = random.Random(3)
    made = [(f"r{k}", "".join(rng.choices("ACGT", k=rng.randint(1, 50))), None) for k in range(300)]
    made = [(n, s, "@" * len(s)) for n, s, _ in made]
    put(tmp_path / "p.fastq", made, False)
    register(spark)
    df = spark.read.format("fastq").option("splitBytes", "1000").option("qualityOffset", "33").load(str(tmp_path / "p.fastq"))
    assert df.rdd.getNumPartitions() > 5
    assert [(r.id, r.seq, r.qual) for r in df.orderBy("read_idx").collect()] == [(n, s, [31] * len(s)) for n, s, _ in made]


def test_fasta_uniques_and_error_space(spark, tmp_path):
    (tmp_path / "s.fasta").write_text(">a\nACGT\n>b\nAC\nGT\n>c\nGG\n")
    assert rows(files.dereplicate_fasta(spark, str(tmp_path / "s.fasta"))) == [("s", "ACGT", 2, [26.0] * 4), ("s", "GG", 1, [26.0] * 2)]
    reads = spark.createDataFrame([("s", "AC", [10, 20]), ("s", "AC", [30, 20]), ("s", "AC", None)], "sample string, seq string, qual array<int>")
    (r,) = quality_arrays(reads, in_errors=True).collect()
    assert r.abundance == 3 and r.qual == pytest.approx([(0.1 + 0.001) / 2, 0.01])


def test_mothur_and_random_order(spark, tmp_path):
    t = spark.createDataFrame([("s", "AC", 3), ("s", "GT", 1), ("u", "GT", 5)], "sample string, seq string, abundance long")
    write_otu_table(t, str(tmp_path / "m"), "mothur")
    assert "".join(p.read_text() for p in (tmp_path / "m").glob("part*")) == "label Group numOtus GT AC\nall s 2 1 3\nall u 2 5 0\n"
    reads = spark.createDataFrame([(f"s{i}", "ACGT") for i in range(12)], "sample string, seq string")
    orders = {tuple(r["sample"] for r in samples_up_to(reads, 20, seed=k).orderBy("running").collect()) for k in range(5)}
    assert len(orders) > 1 and all(len(o) == 6 for o in orders)


def test_numbers_within_a_sample_of_most_reads(spark):
    rng = random.Random(4)
    data = [("big" if rng.random() < 0.8 else rng.choice(("a", "z", None)), "".join(rng.choices("ACGT", k=3))) for _ in range(600)]
    n = Counter(data)
    want, at = [], Counter()
    for (s, q), k in sorted(n.items(), key=lambda x: (x[0][0] or "", -x[1], x[0][1])):
        at[s] += 1
        want.append((s, q, k, at[s]))
    assert rows(dereplicate(spark.createDataFrame(data, "sample string, seq string"))) == sorted(want, key=repr)
    assert dereplicate(spark.createDataFrame([], "sample string, seq string")).count() == 0


def test_functions_in_sql(spark):
    from readloom.functions.register import register as functions

    rng = random.Random(5)
    genome = "".join(rng.choices("ACGT", k=200))
    functions(spark, genome)
    inside = genome[180:] + genome[:40]
    other = "".join(rng.choices("ACGT", k=60))
    turned = inside[::-1].translate(COMPLEMENT)
    (r,) = spark.sql(f"select is_phix('{inside}') a, is_phix('{turned}') b, is_phix('{other}') c, is_phix(null) d, nw_hamming('ACGTACGT', 'ACGAACGT') h, nw_align(null, 'A').al0 n, round(seq_complexity('ACGTACGT'), 3) x").collect()
    assert (r.a, r.b, r.c, r.d, r.h, r.n) == (True, True, False, None, 1, None) and r.x == pytest.approx(3.942, abs=0.1)
    assert [tuple(x) for x in spark.sql("select * from kmers('ACGTA', 4)").collect()] == [(1, "ACGT"), (2, "CGTA")]
    assert spark.sql("select * from kmers('AC', 4)").count() == 0
