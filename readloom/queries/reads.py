"""Queries on raw reads: quality control, unique sequences and tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import seq as S
from readloom.operators import derep as D
from readloom.operators import qc


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Each read once; a repeated delivery fills what another one lacks."""
    t = spark.read.parquet(f"{d}/reads.parquet")
    return t.groupBy("read_idx").agg(*[F.max(c).alias(c) for c in ("sample", "id", "seq", "qual")])


R = "r as (select read_idx, max(sample) sample, max(id) id, max(seq) seq, max(qual) qual from reads group by read_idx)"
QUERIES: dict = {}
SQL: dict[str, str] = {}

#: A fixed stretch against which contaminants are looked for in the queries (the library takes the genome as a parameter).
GENOME = "TCTACGCCGGTGCAATCACTCCCTAGTTAGTACAAGGGTGCACAGTGGCAGAATGAGAGC"
OFF = qc.Filter(trunc_q=None, min_len=0, max_n=None)


def query(name: str, sql: str | None = None):
    def note(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return note


def _filtered(name: str, f: qc.Filter, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = qc.filter_reads(reads(spark, d), f)
        return out.select("read_idx", "seq", F.aggregate("qual", F.lit(0), lambda a, q: a + q).alias("q_sum"))

    QUERIES[name] = run
    SQL[name] = f"with {R}, {sql} select read_idx, seq, cast(list_sum(qual) as int) q_sum from z"


_filtered("qc_trim_left_right", qc.Filter(trunc_q=None, min_len=0, max_n=None, trim_left=5, trim_right=7), "z as (select read_idx, substr(seq, 6, length(seq) - 12) seq, qual[6:length(seq) - 7] qual from r where length(seq) > 12)")
_filtered("qc_trunc_q", qc.Filter(trunc_q=12, min_len=0, max_n=None), "k as (select *, list_position(list_transform(qual, lambda x: x <= 12), true) p from r where qual is not null), z as (select read_idx, substr(seq, 1, coalesce(nullif(p, 0) - 1, length(seq))) seq, qual[1:coalesce(nullif(p, 0) - 1, length(seq))] qual from k where coalesce(nullif(p, 0) - 1, length(seq)) > 0)")
_filtered("qc_trunc_len", qc.Filter(trunc_q=None, min_len=0, max_n=None, trim_left=4, trunc_len=60), "z as (select read_idx, substr(seq, 5, 56) seq, qual[5:60] qual from r where length(seq) >= 60)")
_filtered("qc_min_max_len", qc.Filter(trunc_q=2, min_len=40, max_len=96, max_n=None), "k as (select *, coalesce(nullif(list_position(list_transform(qual, lambda x: x <= 2), true), 0) - 1, length(seq)) e from r where qual is not null and length(seq) <= 96), z as (select read_idx, substr(seq, 1, e) seq, qual[1:e] qual from k where e >= 40)")
_filtered("qc_max_n", qc.Filter(trunc_q=None, min_len=0, max_n=0), "z as (select * from r where not regexp_matches(seq, '[^ACGT]'))")
_filtered("qc_min_q", qc.Filter(trunc_q=None, min_len=0, max_n=None, min_q=2), "z as (select * from r where list_min(qual) > 2)")
_filtered("qc_max_ee", qc.Filter(trunc_q=None, min_len=0, max_n=None, max_ee=2.0), "z as (select * from r where list_sum(list_transform(qual, lambda x: pow(10.0, -x / 10.0))) <= 2.0)")
_filtered("qc_orient", qc.Filter(trunc_q=None, min_len=0, max_n=None, orient_fwd="TC"), "k as (select *, reverse(translate(seq, 'ACGTN', 'TGCAN')) c from r), z as (select read_idx, seq, qual from k where starts_with(seq, 'TC') union all select read_idx, c, list_reverse(qual) from k where not starts_with(seq, 'TC') and starts_with(c, 'TC'))")


@query("phix_overlapping", f"""with {R}, g as (select '{GENOME}' s union all select reverse(translate('{GENOME}', 'ACGT', 'TGCA'))), w as (select distinct s, substr(concat(s, substr(s, 1, 15)), i, 16) x from g, unnest(range(1, {len(GENOME)} + 1)) t(i)),
h as (select read_idx, s, count(*) n from (select read_idx, substr(seq, i, 16) x from r, unnest(range(1, 82)) t(i)) k join w using (x) group by 1, 2)
select read_idx, max(n) >= 2 hit from h group by 1 having max(n) >= 2""")  # fmt: skip
def _phix(spark, d):
    return reads(spark, d).where(qc.contaminated(F.col("seq"), GENOME, non_overlapping=False)).select("read_idx", F.lit(True).alias("hit"))


@query("phix_nonoverlapping", f"""with recursive {R}, g as (select 1 strand, '{GENOME}' s union all select 2, reverse(translate('{GENOME}', 'ACGT', 'TGCA'))), w as (select distinct strand, substr(concat(s, substr(s, 1, 15)), i, 16) x from g, unnest(range(1, {len(GENOME)} + 1)) t(i)),
h as (select read_idx, strand, list(p) ps from (select read_idx, seq, unnest(range(1, length(seq) - 14)) p from r) k join w on w.x = substr(seq, p, 16) group by 1, 2),
c as (select read_idx, strand, ps, list_min(ps) now, 1 n from h union all select read_idx, strand, ps, list_min(list_filter(ps, lambda p: p > now + 16)), n + 1 from c where len(list_filter(ps, lambda p: p > now + 16)) > 0)
select read_idx, true hit from c group by read_idx having max(n) >= 2""")
def _phix2(spark, d):
    return reads(spark, d).where(qc.contaminated(F.col("seq"), GENOME)).select("read_idx", F.lit(True).alias("hit"))


@query("qc_report", f"with {R} select sample, count(*) reads_in, count(*) filter (where qual is not null and list_min(qual) > 2 and not regexp_matches(seq, '[^ACGT]') and list_sum(list_transform(qual, lambda x: pow(10.0, -x / 10.0))) <= 1.0) reads_out from r group by sample")
def _report(spark, d):
    return qc.filter_report(reads(spark, d), qc.Filter(trunc_q=2, trunc_len=96, max_ee=1.0))


PAIRS = f"{R}, p as (select sample, read_idx, id, substr(seq, 1, 60) f, qual[1:60] fq, reverse(translate(substr(seq, 37, 60), 'ACGTN', 'TGCAN')) r, list_reverse(qual[37:96]) rq from r)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Mates made of each read: its first 60 letters, and the reverse complement of its last 60."""
    return reads(spark, d).select("sample", "read_idx", "id", F.substring("seq", 1, 60).alias("f"), F.slice("qual", 1, 60).alias("fq"), S.reverse_complement(F.substring("seq", 37, 60)).alias("r"), F.reverse(F.slice("qual", 37, 60)).alias("rq"))


@query("qc_paired", f"with {PAIRS} select sample, read_idx, substr(f, 1, 50) f, substr(r, 1, 40) r from p where fq is not null and list_min(fq[1:50]) > 2 and list_min(rq[1:40]) > 2 and not regexp_matches(substr(f, 1, 50), 'N') and not regexp_matches(substr(r, 1, 40), 'N')")
def _paired(spark, d):
    return qc.filter_pairs(pairs(spark, d), qc.Filter(trunc_q=2, trunc_len=50), qc.Filter(trunc_q=2, trunc_len=40)).select("sample", "read_idx", "f", "r")


TABLE = f"{R}, t as (select sample, seq, count(*) abundance from r where length(seq) > 0 and list_sum(list_transform(qual, lambda x: pow(10.0, -x / 10.0))) <= 4.0 and not regexp_matches(seq, '[^ACGT]') group by 1, 2)"


@query("qc_match_ids", f"with {PAIRS}, a as (select * from p where not regexp_matches(f, 'N')), b as (select * from p where list_sum(list_transform(rq, lambda x: pow(10.0, -x / 10.0))) <= 2.0) select a.sample, a.read_idx, b.read_idx mate_idx from a join b on a.sample = b.sample and a.id = b.id and length(a.id) - length(replace(a.id, ':', '')) = 6")
def _match(spark, d):
    """Mates that were filtered each by itself, so many have lost theirs; a number of the file instead of a place, so they aren't in order."""
    p = pairs(spark, d)
    fwd = p.where(~F.col("f").contains("N")).select("sample", F.concat("id", F.lit(" 1:N:0")).alias("id"), "read_idx")
    rev = p.where(S.expected_errors(F.col("rq")) <= 2.0).select("sample", F.concat("id", F.lit(" 2:N:0")).alias("id"), F.col("read_idx").alias("mate_idx"))
    return qc.match_ids(fwd, rev).select("sample", "read_idx", "mate_idx")


@query("qc_low_complexity", f"with {R}, k as (select seq, substr(seq, i, 2) w, count(*) n from (select distinct seq from r where seq is not null), unnest(range(1, 96)) t(i) where regexp_matches(substr(seq, i, 2), '^[ACGT]*$') group by 1, 2), c as (select seq, exp(-sum(n / t * ln(n / t))) v from (select *, cast(sum(n) over (partition by seq) as double) t from k) group by seq) select read_idx, sample from r join c using (seq) where v >= 14.5")
def _low_complexity(spark, d):
    return qc.filter_reads(reads(spark, d), qc.Filter(trunc_q=None, min_len=0, max_n=None, low_complexity=14.5)).select("read_idx", "sample")


@query("seq_table_prevalence", f"with {TABLE}, o as (select seq, cast(sum(abundance) as bigint) total, count(*) n_samples from t group by 1) select *, row_number() over (order by n_samples desc, seq) col from o")
def _prevalence(spark, d):
    return D.column_order(seq_table(spark, d), "nsamples")


@query("stream_uniques", "select sample, seq, count(*) abundance from reads where length(seq) > 0 group by 1, 2")
def _stream(spark, d):
    """Unique sequences counted over a stream of the deliveries, until all that is there has been read."""
    import uuid

    from readloom.cluster import shared_dir
    from readloom.streaming.reads import dereplicate_stream

    folder = f"{shared_dir(spark)}/readloom/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/reads.parquet").schema
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/reads.parquet")
    folder_of_files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder_of_files else "reads.parquet")
    counted = dereplicate_stream(source.parquet(f"{d}/reads.parquet" if folder_of_files else d))
    # in mode complete each batch has all counts so far; the last one stays
    sink = counted.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    sink.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/counts")).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{folder}/counts")


def _column(name: str, expr, sql: str) -> None:
    def run(spark, d):
        return reads(spark, d).where("seq is not null").select("read_idx", expr(F.col("seq")).alias("v"))

    QUERIES[name] = run
    SQL[name] = f"with {R} select read_idx, {sql} v from r where seq is not null"


#: The other side of comparisons.
OTHER = "TCTACGCCGGTGCAATCACTCCCTAGTTAGTACAAGGGTGCACAGTGGCAGAATGAGAGCCGAACGCGGCCTGTTAACAGCAATCACCCGAGTCCG"
_WORDS = "list_transform(range(1, length({0}) - 3), lambda i: substr({0}, cast(i as int), 5))"
_column("fn_reverse_complement", S.reverse_complement, "reverse(translate(seq, 'ACGTN', 'TGCAN'))")
_column("fn_is_acgt", S.is_acgt, "not regexp_matches(seq, '[^ACGT]')")
_column("fn_kmers", lambda s: F.array_join(S.kmers(s, 5), ","), f"array_to_string({_WORDS.format('seq')}, ',')")
_column("fn_strdiff", lambda s: F.array_join(F.transform(S.differences(s, F.lit(OTHER)), lambda x: F.concat(x["pos"].cast("string"), x["a"], x["b"])), " "), f"array_to_string(list_transform(list_filter(range(1, 97), lambda i: substr(seq, cast(i as int), 1) <> substr('{OTHER}', cast(i as int), 1)), lambda i: concat(cast(i as varchar), substr(seq, cast(i as int), 1), substr('{OTHER}', cast(i as int), 1))), ' ')")
_column("fn_kmer_matches", lambda s: S.equal_ordered_kmers(s, F.lit(OTHER), 5), f"cast(len(list_filter(range(1, 93), lambda i: substr(seq, cast(i as int), 5) = substr('{OTHER}', cast(i as int), 5))) as int)")
_column("fn_kord_dist", lambda s: F.round(S.ordered_kmer_distance(s, F.lit(OTHER), 5), 6), f"round(1 - len(list_filter(range(1, 93), lambda i: substr(seq, cast(i as int), 5) = substr('{OTHER}', cast(i as int), 5))) / 92.0, 6)")


def _distinct_pairs(name, expr, sql):
    def run(spark, d):
        seqs = reads(spark, d).where("seq is not null").select("seq").distinct()
        return seqs.select("seq", expr(F.col("seq"), F.lit(OTHER)).alias("v"))

    QUERIES[name] = run
    SQL[name] = f"""with s as (select distinct seq from reads where seq is not null), a as (select seq, substr(seq, i, 5) w, count(*) n from s, unnest(range(1, 93)) t(i) group by 1, 2), b as (select substr('{OTHER}', i, 5) w, count(*) m from unnest(range(1, 93)) t(i) group by 1),
k as (select seq, cast(sum(least(n, m)) as int) c from a join b using (w) group by 1) select s.seq, {sql} v from s left join k using (seq)"""


_distinct_pairs("fn_kdist_matches", lambda a, b: S.shared_kmers(a, b, 5), "coalesce(c, 0)")
_distinct_pairs("fn_kmer_dist", lambda a, b: F.round(S.kmer_distance(a, b, 5), 6), "round(1 - coalesce(c, 0) / 92.0, 6)")


@query("seq_complexity", "with s as (select distinct seq from reads where seq is not null), k as (select seq, substr(seq, i, 2) w, count(*) n from s, unnest(range(1, 96)) t(i) where regexp_matches(substr(seq, i, 2), '^[ACGT]*$') group by 1, 2) select seq, round(exp(-sum(n / t * ln(n / t))), 6) v from (select *, cast(sum(n) over (partition by seq) as double) t from k) group by seq")
def _complexity(spark, d):
    return reads(spark, d).where("seq is not null").select("seq").distinct().select("seq", F.round(S.complexity(F.col("seq")), 6).alias("v"))


@query("seq_complexity_windowed", "with s as (select distinct seq from reads where seq is not null), k as (select seq, j, substr(seq, cast(j + i as int), 2) w, count(*) n from s, unnest(range(1, 48, 5)) u(j), unnest(range(0, 49)) t(i) where regexp_matches(substr(seq, cast(j + i as int), 2), '^[ACGT]*$') group by 1, 2, 3), e as (select seq, j, exp(-sum(n / t * ln(n / t))) v from (select *, cast(sum(n) over (partition by seq, j) as double) t from k) group by 1, 2) select seq, round(min(v), 6) v from e group by seq")
def _complexity_w(spark, d):
    return reads(spark, d).where("seq is not null").select("seq").distinct().select("seq", F.round(S.complexity(F.col("seq"), window=50), 6).alias("v"))


@query("complexity_histogram", "with s as (select distinct seq from reads where seq is not null), k as (select seq, substr(seq, i, 2) w, count(*) n from s, unnest(range(1, 96)) t(i) where regexp_matches(substr(seq, i, 2), '^[ACGT]*$') group by 1, 2), e as (select seq, exp(-sum(n / t * ln(n / t))) v from (select *, cast(sum(n) over (partition by seq) as double) t from k) group by seq) select cast(floor(round(v, 6) * 2) as bigint) bin, count(*) n from e group by 1")
def _histogram(spark, d):
    return _complexity(spark, d).groupBy(F.floor(F.col("v") * 2).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("derep_uniques", f"with {R}, u as (select sample, seq, count(*) abundance from r where length(seq) > 0 group by 1, 2) select sample, seq, abundance, cast(row_number() over (partition by sample order by abundance desc, seq) as int) uidx from u")
def _uniques(spark, d):
    return D.dereplicate(reads(spark, d))


@query("derep_quals", f"with {R}, q as (select sample, seq, unnest(qual) q, generate_subscripts(qual, 1) pos from r where qual is not null) select sample, seq, cast(pos as int) pos, count(*) n, round(avg(q), 6) mean_q from q group by 1, 2, 3")
def _quals(spark, d):
    return D.mean_quality(reads(spark, d)).withColumn("mean_q", F.round("mean_q", 6))


@query("derep_map", f"with {R}, u as (select sample, seq, count(*) abundance from r where length(seq) > 0 group by 1, 2), k as (select *, cast(row_number() over (partition by sample order by abundance desc, seq) as int) uidx from u) select r.sample, read_idx, uidx from r left join k using (sample, seq)")
def _map(spark, d):
    r = reads(spark, d)
    return D.read_map(r, D.dereplicate(r))


@query("derep_pool", f"with {R}, u as (select seq, count(*) abundance, count(distinct sample) n_samples from r where length(seq) > 0 group by 1) select *, row_number() over (order by abundance desc, seq) uidx from u")
def _pool(spark, d):
    return D.pool(D.dereplicate(reads(spark, d))).select("seq", "abundance", "n_samples", "uidx")


def seq_table(spark: SparkSession, d: str) -> DataFrame:
    kept = qc.filter_reads(reads(spark, d), qc.Filter(trunc_q=None, max_ee=4.0))
    return D.sequence_table(D.dereplicate(kept))


@query("seq_table_long", f"with {TABLE}, o as (select seq, sum(abundance) total, count(*) n_samples from t group by 1), c as (select seq, row_number() over (order by total desc, seq) col from o) select sample, seq, cast(abundance as bigint) abundance, col from t join c using (seq)")
def _table_long(spark, d):
    t = seq_table(spark, d)
    return t.join(D.column_order(t).select("seq", "col"), "seq").select("sample", "seq", "abundance", "col")


def _samples(spark: SparkSession, d: str) -> list[str]:
    """The names of all samples, one for each column of the result."""
    return sorted(r[0] for r in spark.read.parquet(f"{d}/samples.parquet").where("sample is not null").select("sample").distinct().collect())


@query("seq_table_pivot")
def _pivot(spark, d):
    """All samples, in the order of their names."""
    return D.pivot_samples(seq_table(spark, d), _samples(spark, d))


@query("export_otu_matrix", f"with {TABLE}, q as (select distinct seq from t), s as (select distinct sample from samples where sample is not null) select q.seq otu, s.sample, cast(coalesce(t.abundance, 0) as bigint) abundance from q cross join s left join t on t.seq = q.seq and t.sample = s.sample")
def _otu_matrix(spark, d):
    """The matrix of all samples by all sequences, cell by cell (SQL can't name a column for each sample)."""
    names = _samples(spark, d)
    wide = D.pivot_samples(seq_table(spark, d), names)
    return wide.unpivot("seq", names, "sample", "abundance").withColumnRenamed("seq", "otu")


@query("seq_table_merge", f"with {TABLE} select sample, seq, cast(sum(abundance) as bigint) abundance from (select * from t union all select concat('B', sample), seq, abundance from t union all select * from t) group by 1, 2")
def _merge(spark, d):
    """Whole tables: one is added to its own samples, one brings new ones."""
    t = seq_table(spark, d)
    other = t.withColumn("sample", F.concat(F.lit("B"), "sample"))
    return D.merge_tables([D.merge_tables([t, other]), t], repeats="sum")


@query("seq_table_merge_rc", f"""with {TABLE}, x as (select * from t union all select sample, reverse(translate(seq, 'ACGT', 'TGCA')), abundance from t), m as (select sample, seq, sum(abundance) abundance from x group by 1, 2), o as (select seq, sum(abundance) total from m group by 1),
e as (select a.seq, b.seq mate from o a join o b on b.seq = reverse(translate(a.seq, 'ACGT', 'TGCA')) where b.total > a.total or b.total = a.total and b.seq < a.seq) select sample, coalesce(mate, m.seq) seq, cast(sum(abundance) as bigint) abundance from m left join e using (seq) group by 1, 2""")  # fmt: skip
def _merge_rc(spark, d):
    t = seq_table(spark, d)
    return D.merge_tables([t, t.withColumn("seq", S.reverse_complement(F.col("seq")))], repeats="sum", try_rc=True)


@query("prevalence_priors", f"with {TABLE} select seq, count(distinct sample) n_samples, cast(sum(abundance) as bigint) total from t group by 1 having count(distinct sample) >= 2")
def _priors(spark, d):
    return D.priors(seq_table(spark, d))


@query("nbases_prefix", f"with {R}, b as (select sample, cast(coalesce(sum(length(seq)), 0) as bigint) bases from r group by 1), k as (select *, cast(sum(bases) over (order by sample) as bigint) running from b) select * from k where running - bases <= 200000")
def _prefix(spark, d):
    return D.samples_up_to(reads(spark, d), 200_000)


_PROFILE = """c as (select {0}cast(pos as int) cycle, cast(q as int) q, count(*) c from (select sample, unnest(qual) q, generate_subscripts(qual, 1) pos from r where qual is not null) group by all),
k as (select *, sum(c) over (partition by {0}cycle order by q) cum, sum(c) over (partition by {0}cycle) total from c)
select {0}cycle, cast(sum(c) as bigint) n, round(sum(q * c) / sum(c), 6) mean_q, min(case when cum >= 0.25 * total then q end) q25, min(case when cum >= 0.5 * total then q end) q50, min(case when cum >= 0.75 * total then q end) q75 from k group by {0}cycle"""


@query("quality_profile", f"with {R}, {_PROFILE.format('sample, ')}")
def _profile(spark, d):
    return D.quality_profile(reads(spark, d), ["sample"]).withColumn("mean_q", F.round("mean_q", 6))


@query("quality_profile_agg", f"with {R}, {_PROFILE.format('')}")
def _profile_all(spark, d):
    return D.quality_profile(reads(spark, d), []).withColumn("mean_q", F.round("mean_q", 6))


@query("export_fasta_ids", f"with {TABLE}, u as (select seq, cast(sum(abundance) as bigint) abundance from t group by 1), k as (select *, row_number() over (order by abundance desc, seq) i from u) select concat('sq', cast(i as varchar), ';size=', cast(abundance as varchar), ';') header, seq from k")
def _fasta_ids(spark, d):
    from readloom.sources.fasta import uniques_to_fasta

    return uniques_to_fasta(seq_table(spark, d).groupBy("seq").agg(F.sum("abundance").alias("abundance")))


@query("collapse_identical", f"with {TABLE} select sample, seq, cast(2 * abundance as bigint) abundance from t")
def _collapse_identical(spark, d):
    from readloom.operators.chimera import collapse_no_mismatch

    t = seq_table(spark, d)
    return collapse_no_mismatch(t.unionByName(t), identical_only=True)


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
