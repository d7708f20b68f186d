"""Operators on reads and variants: small planted cases, and every query against its SQL."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom import errors as E
from readloom.operators import chimera, derep, pairs, primers, qc
from readloom.operators import taxonomy as T
from readloom.sources import fasta

from .conftest import rows

SMALL = "/root/testdata/sf0.001"


def _reads(spark, data):
    return spark.createDataFrame([(s, i, q, [int(x) for x in v] if v is not None else None) for i, (s, q, v) in enumerate(data)], "sample string, read_idx long, seq string, qual array<tinyint>")


def test_filter_edges(spark):
    df = _reads(spark, [("a", "ACGTACGT", [30] * 8), ("a", None, None), ("a", "", []), ("b", "ACGNACGT", [30] * 8), ("b", "ACGTAC", None)])
    plain = qc.Filter(trunc_q=None, min_len=1)
    assert {r.read_idx for r in qc.filter_reads(df, plain).collect()} == {0, 4}
    assert {r.read_idx for r in qc.filter_reads(df, qc.Filter(min_len=1)).collect()} == {0}
    assert rows(qc.filter_report(df, plain)) == [("a", 3, 1), ("b", 2, 1)]
    assert qc.filter_reads(df.limit(0), qc.Filter(max_ee=1.0, orient_fwd="A")).count() == 0
    low = _reads(spark, [("a", "A" * 40, [30] * 40), ("a", "ACGTTGCAAC" * 4, [30] * 40)])
    assert {r.read_idx for r in qc.filter_reads(low, qc.Filter(low_complexity=4.0)).collect()} == {1}


def test_read_names(spark):
    df = spark.createDataFrame([("I:1:F:1:2:3:4 1:N:0",), ("HW:1:2:3:4#ACG/1",), ("nothing",), (None,)], "id string")
    assert [r[0] for r in df.select(qc.read_key(F.col("id"))).collect()] == ["I:1:F:1:2:3:4", "HW:1:2:3:4", None, None]


def test_primers(spark):
    df = spark.createDataFrame([("TTACGYA".replace("Y", "C") + "GGGGGGGG" + "CCTT", [30] * 19), ("AAGG" + "CCCCCCCC" + "TGCGTAA", [30] * 19), ("GATTACA", [30] * 7), (None, None)], "seq string, qual array<tinyint>")
    out = primers.remove_primers(df, "ACGYA", "CCTT", max_mismatch=0)
    assert sorted(r.seq for r in out.collect()) == ["GGGGGGGG", "GGGGGGGG"]
    assert primers.find_primer("TTACGTTCA", primers._sets("ACGTCA"), 1, True)


def test_merge_pairs(spark):
    whole = "ACGTTGCATGCCATTGACCAGTACGATTTGC"
    df = spark.createDataFrame([("s", whole[:22], whole[8:][::-1].translate(str.maketrans("ACGT", "TGCA")), 5, 5)] * 3 + [("s", "A" * 22, "ACGTACGTTTGACCAGATTGCA", 1, 1), ("s", None, "A", 1, 1)], "sample string, f string, r string, n0_f int, n0_r int")
    out = pairs.merge_pairs(df)
    assert [(r.sequence, r.abundance, r.nmatch) for r in out.collect()] == [(whole, 3, 14)]
    assert pairs.merge_pairs(df, return_rejects=True).where("sequence = ''").count() == 1
    assert pairs.merge_pairs(df.limit(0)).count() == 0


def test_chimeras(spark):
    a, b = "ACGTTGCATGCCATTGACCA", "GGATCCAAGTCTCAGTTTAC"
    table = spark.createDataFrame([(s, q, n) for s in ("x", "y", "z") for q, n in ((a, 100), (b, 90), (a[:10] + b[10:], 5))], "sample string, seq string, abundance long")
    out = {r.seq: r.chimeric for r in chimera.chimera_votes(table).collect()}
    assert out == {a: False, b: False, a[:10] + b[10:]: True}
    for method in ("consensus", "pooled", "per-sample"):
        assert {r.seq for r in chimera.remove_chimeras(table, method).collect()} == {a, b}
    assert chimera.chimera_votes(table.limit(0)).count() == 0


def test_shift_and_collapse(spark):
    a = "ACGTTGCATGCCATTGACCAGTACGATTTGCCA"
    df = spark.createDataFrame([("s", a, 100), ("s", "TT" + a[:-2], 10), ("s", a[:25], 5), ("t", a[:25], 7), ("t", "G" * 30, 1)], "sample string, seq string, abundance long")
    assert {r.seq for r in chimera.shifted(df).where("shifted").collect()} == {"TT" + a[:-2]}
    out = rows(chimera.collapse_no_mismatch(df))
    assert ("t", a, 7) in out and ("t", "G" * 30, 1) in out and ("s", a, 115) in out
    assert sum(r[2] for r in out) == 123


def _store(spark, path, name, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")


def _store_reads(spark, path, data):
    _store(spark, path, "reads", [(i, s, f"r{i}", q, [40] * len(q)) for i, (s, q) in enumerate(data)], "read_idx long, sample string, id string, seq string, qual array<tinyint>")


def test_shifts_of_all_uniques(spark, tmp_path):
    from readloom.queries.variants import queries

    a = "ACGTTGCATGCCATTGACCAGTACGATTTGCCA"
    once, other = "TT" + a[:-2], "GGATCCAAGTCTCAGTTTACGGATCCTTACAGA"
    _store_reads(spark, tmp_path, [("x", a)] * 2 + [("y", a), ("x", once), ("y", other)])
    assert rows(queries()["shift_denovo"](spark, str(tmp_path))) == sorted([(a, False), (once, True), (other, False)])


def test_merge_tables(spark):
    t = spark.createDataFrame([("s", "AAC", 3), ("s", "GTT", 2)], "sample string, seq string, abundance long")
    with pytest.raises(ValueError):
        derep.merge_tables([t, t])
    assert rows(derep.merge_tables([t, t], repeats="sum", try_rc=True)) == [("s", "AAC", 10)]


def test_error_models():
    trans = np.zeros((16, 41), int)
    for q in (2, 12, 23, 37):
        for k in range(16):
            trans[k, q] = 1_000_000 if k % 5 == 0 else int(1e6 * 10 ** (-q / 10) / 3)
    for f in (E.loess_errors, E.binned_errors([2, 12, 23, 37]), E.long_read_errors):
        err = f(trans)
        assert np.allclose(err.reshape(4, 4, -1).sum(1), 1) and (err >= 0).all()
        assert err[1, 5] > err[1, 30]
    with pytest.raises(ValueError):
        E.binned_errors([12, 23])(trans)
    assert E.inflate(E.nominal_errors(), 2)[1, 10] > E.nominal_errors()[1, 10]
    with pytest.raises(ValueError):
        E.checked(np.full((16, 2), 2.0))


def test_denoise_of_samples(spark):
    from readloom.operators.denoise import denoise

    rng = np.random.default_rng(1)
    truth = ["".join(rng.choice(list("ACGT"), 60)) for _ in range(2)]
    data = []
    for s in ("x", "y"):
        for t, n in zip(truth, (300, 200), strict=True):
            data.append((s, t, n, [30.0] * 60))
            data += [(s, t[:i] + ("A" if t[i] != "A" else "C") + t[i + 1 :], 1, [30.0] * 60) for i in range(5, 25, 4)]
    df = spark.createDataFrame(data, "sample string, seq string, abundance long, qual array<double>")
    for pool in (False, True, "pseudo"):
        out = denoise(df, E.nominal_errors(), E.flat_errors, pool=pool)
        assert {r.seq for r in out.denoised.collect()} == set(truth)
        assert out.denoised.agg(F.sum("abundance")).first()[0] == 1020
    assert out.unique_map.where("cluster is null").count() == 0
    learned = denoise(df, None, E.flat_errors, self_consist=True)
    assert learned.rounds >= 2 and learned.err_out.shape[0] == 16


def test_taxonomy(spark):
    rng = np.random.default_rng(5)
    seqs = ["".join(rng.choice(list("ACGT"), 120)) for _ in range(4)]
    refs = spark.createDataFrame([(f"K;P{i % 2};G{i};", s) for i, s in enumerate(seqs)] + [("K;", "ACG")], "header string, seq string")
    q = spark.createDataFrame([(seqs[2][10:90],), (seqs[1][::-1].translate(str.maketrans("ACGT", "TGCA")),), ("ACGT",), (None,)], "seq string")
    out = {r.seq: r for r in T.classify(q, refs, ranks=("Kingdom", "Phylum", "Genus"), try_rc=True, block=2).collect()}
    assert out[seqs[2][10:90]].Genus == "G2" and out[seqs[2][10:90]].boot_Genus > 90
    assert {r.Genus for r in out.values()} == {"G1", "G2", None}
    sp = spark.createDataFrame([("r1", "Aus", "bus", seqs[0]), ("r2", "Aus", "cus", seqs[0]), ("r3", "Shigella", "x", seqs[1])], "ref_id string, genus string, species string, seq string")
    hits = {r.seq: (r.Genus, r.Species) for r in T.assign_species(spark.createDataFrame([(seqs[0][:50],), (seqs[1][:50],), (seqs[3],)], "seq string"), sp).collect()}
    assert hits == {seqs[0][:50]: ("Aus", None), seqs[1][:50]: ("Escherichia/Shigella", "x"), seqs[3]: (None, None)}


def test_whole_variants_are_classified(spark, tmp_path):
    from readloom.queries.variants import queries

    rng = np.random.default_rng(6)
    seqs = ["".join(rng.choice(list("ACGT"), 220)) for _ in range(2)]
    seqs.append(seqs[0][:180] + seqs[1][:40])
    _store(spark, tmp_path, "reffasta", [(i, f"K;P;C;O;F;G{i}", s) for i, s in enumerate(seqs)], "ref_id long, id string, sequence string")
    _store(spark, tmp_path, "clustering", [(s[:100].lower() + " " + s[100:],) for s in seqs[:2]] + [(None,)], "sequence string")
    _store(spark, tmp_path, "makesequencetable", [(s,) for s in seqs], "sequence string")
    assert {r.seq for r in queries()["tax_classify"](spark, str(tmp_path)).collect()} == set(seqs)
    assert [(r.Phylum, r.n) for r in queries()["tax_bootstrap"](spark, str(tmp_path)).collect()] == [("P", 3)]


def test_reference_headers(spark):
    rdp = spark.createDataFrame([("S1 Aus bus; strain 1\tLineage=Root;rootrank;Bacteria;domain;P;phylum;C;class;O;order;F;family;Aus;genus", "ACGT"), ("S2 uncultured thing\tLineage=Root;rootrank;Bacteria;domain", "ACGT")], "header string, seq string")
    assert [r.header for r in T.rdp_taxonomy(rdp).collect()] == ["Bacteria;P;C;O;F;Aus;", "Bacteria;"]
    assert [r.header for r in T.rdp_species(rdp).collect()] == ["S1 Aus bus"]
    gg = T.greengenes_taxonomy(spark.createDataFrame([("1", "ACGT")], "header string, seq string"), spark.createDataFrame([("1", "d__B; p__P; c__; o__O; f__; g__; s__")], "id string, taxon string"))
    assert [r.header for r in gg.collect()] == ["B;P;"]
    silva = spark.createDataFrame([("A.1.2 Bacteria;P;C;Aus bus", "ACGU"), ("E.1.2 Eukaryota;X", "ACGU")], "header string, seq string")
    taxa = spark.createDataFrame([("Bacteria;", "domain"), ("Bacteria;P;", "phylum"), ("Bacteria;P;C;", "class")], "path string, rank string")
    assert sorted(r.header for r in T.silva_taxonomy(silva, taxa).collect()) == ["Bacteria;P;C;", "Eukaryota;"]


def test_files(spark, tmp_path):
    fasta.register(spark)
    df = _reads(spark, [("a", "ACGT", [30] * 4), ("a", "GG", [2, 40]), ("b", "TTTTT", [10] * 5)]).withColumn("id", F.concat(F.lit("r"), F.col("read_idx").cast("string")))
    for compress in ("true", "false"):
        out = str(tmp_path / compress)
        df.select("sample", "read_idx", "id", "seq", "qual").coalesce(1).write.format("fastq").mode("append").option("path", out).option("compress", compress).save()
        back = spark.read.format("fastq").option("splitBytes", "24").option("qualityOffset", "33").load(out)
        assert rows(back.select("sample", "id", "seq")) == rows(df.select("sample", "id", "seq"))
        assert sorted(map(tuple, (r.qual for r in back.collect()))) == sorted([(30,) * 4, (2, 40), (10,) * 5])
    u = derep.dereplicate(df).groupBy("seq").agg(F.sum("abundance").alias("abundance"))
    fasta.uniques_to_fasta(u).write.format("fasta").mode("append").option("path", str(tmp_path / "fa")).save()
    assert rows(spark.read.format("fasta").load(str(tmp_path / "fa")).select("seq")) == rows(u.select("seq"))
    with pytest.raises(FileNotFoundError):
        fasta.find_files(str(tmp_path / "true" / "none"))


def test_sql_functions(spark):
    from readloom.functions.register import register

    register(spark)
    r = spark.sql("select rc('AACG') r, nw_hamming('ACGTACGTAC', 'ACGTTCGTAC') h, pois_sf(1L, 0.1D) p, seq_complexity('AAAA') c").first()
    assert (r.r, r.h) == ("CGTT", 1) and r.p == pytest.approx(0.0951626, abs=1e-6) and r.c == pytest.approx(1)
    assert [x.kmer for x in spark.sql("select * from kmers('ACGT', 3)").collect()] == ["ACG", "CGT"]


def test_stream_equals_batch(spark, tmp_path):
    from readloom.streaming import reads as R

    src = spark.read.parquet(f"{SMALL}/reads.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    f = qc.Filter(trunc_q=None, min_len=50)
    q = R.dereplicate_stream(R.filter_stream(stream, f)).writeStream.format("memory").queryName("uniq").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = qc.filter_reads(src, f).groupBy("sample", "seq").agg(F.count(F.lit(1)).alias("abundance"))
    assert rows(spark.table("uniq")) == rows(batch)


def _same(a, b):
    def plain(v):
        if v is None or v != v:
            return None
        return round(v, 6) if isinstance(v, float) else v

    cols = sorted(a.columns)
    left = sorted((tuple(plain(r[c]) for c in cols) for r in a.collect()), key=repr)
    names = [x[0] for x in b.description]
    right = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in b.fetchall()), key=repr)
    return sorted(names) == cols and left == right


def _core():
    from readloom.queries import general, reads, variants

    return [(m.queries()[k], sql, k) for m in (general, reads, variants) for k, sql in m.oracle_sql().items()]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
@pytest.mark.parametrize("case", _core(), ids=lambda c: c[2])
def test_query_equals_sql(spark, case):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    assert _same(case[0](spark, SMALL), con.execute(case[1]))


def test_pipeline(spark):
    from readloom.plans.pipeline import variants

    rng = np.random.default_rng(2)
    truth = ["".join(rng.choice(list("ACGT"), 70)) for _ in range(3)]
    data = [(s, t, [30] * 70) for s in ("x", "y") for t, n in zip(truth, (60, 40, 30), strict=True) for _ in range(n)]
    refs = spark.createDataFrame([(f"K;P;G{i};", t) for i, t in enumerate(truth)], "header string, seq string")
    out = variants(_reads(spark, data), qc.Filter(), error_function=E.flat_errors, refs=refs)
    assert {r.seq for r in out.table.collect()} == set(truth)
    assert rows(out.report) == [("x", 130, 130), ("y", 130, 130)]
    assert out.taxa.count() == 3


def test_tables(spark):
    from readloom.operators import tables as B

    df = spark.createDataFrame([("s", "acg", 2), ("s", "ACG", None), ("t", "TT", 5), ("t", None, 1), ("t", "", 1)], "sample string, sequence string, abundance int")
    assert rows(B.as_uniques(df)) == [("ACG", 2), ("TT", 5)]
    assert rows(B.as_uniques(df.drop("abundance"), "sample")) == [("s", "ACG", 2), ("t", "TT", 1)]
    assert tuple(B.abundance(df).first()) == (7, 2) and B.as_sequences(df).count() == 4
    with pytest.raises(ValueError):
        B.as_sequences(spark.range(1))
    good = spark.createDataFrame([("s", "A", 1)], "sample string, seq string, abundance int")
    assert B.is_sequence_table(good) and not B.is_sequence_table(df)
    assert not B.is_sequence_table(good.withColumn("abundance", F.lit(-1)))
    clusters = spark.createDataFrame([("s", i, "A" * 100, 1 if i > 1 else None) for i in range(1, 32)], "sample string, cluster int, sequence string, birth_ham int")
    births = spark.createDataFrame([("s", 17 if i < 27 else i + 40, i) for i in range(2, 32)], "sample string, pos int, clust int")
    assert rows(B.bad_positions(clusters, births)) == [("s", 17, 25)]
    assert B.from_bad_positions(clusters, births).where("false_positive").count() == 25
