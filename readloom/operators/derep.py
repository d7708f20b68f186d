"""Reads to unique sequences, and from samples to tables of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.seq import reverse_complement


def dereplicate(reads: DataFrame, by: str = "sample", seq: str = "seq") -> DataFrame:
    """(by, seq, abundance, uidx): unique sequences, numbered by falling abundance, then by sequence. Null and empty sequences are left out."""
    counted = reads.where(F.length(seq) > 0).groupBy(by, F.col(seq).alias("seq")).agg(F.count(F.lit(1)).alias("abundance"))
    return rank_within(counted, by, "uidx", F.desc("abundance"), F.col("seq"))


def mean_quality(reads: DataFrame, by: str = "sample", seq: str = "seq", qual: str = "qual") -> DataFrame:
    """(by, seq, pos, n, mean_q): mean quality at every place of a unique sequence, over the reads that have qualities. One row for each place; place from 1."""
    places = reads.where(F.length(seq) > 0).select(by, F.col(seq).alias("seq"), F.posexplode(qual).alias("p", "q"))
    return places.groupBy(by, "seq", (F.col("p") + 1).alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("q").cast("double")).alias("mean_q"))


def quality_arrays(reads: DataFrame, by: str = "sample", seq: str = "seq", qual: str = "qual", in_errors: bool = False) -> DataFrame:
    """(by, seq, abundance, qual): as dereplicate, with the mean qualities as one array for each unique sequence. in_errors: the mean is taken of the error probabilities 10^(-Q/10), and is given as such.

    Sums by place are kept in the aggregation buffer of Spark's built-in sum over exploded places only where the places are
    needed apart; here each distinct (sequence, quality array) is counted first, which a few thousand reads of a template often share.
    """
    distinct = reads.where(F.length(seq) > 0).groupBy(by, F.col(seq).alias("seq"), F.col(qual).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    value = F.pow(F.lit(10.0), -F.col("v").cast("double") / 10) if in_errors else F.col("v")
    sums = distinct.where("q is not null").select(by, "seq", "n", F.posexplode("q").alias("p", "v")).groupBy(by, "seq", "p").agg((F.sum(value * F.col("n")) / F.sum("n")).alias("m"))
    arrays = sums.groupBy(by, "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("qual"))
    return distinct.groupBy(by, "seq").agg(F.sum("n").alias("abundance")).join(arrays, [by, "seq"], "left")


def read_map(reads: DataFrame, uniques: DataFrame, by: str = "sample") -> DataFrame:
    """(by, read_idx, uidx): which unique sequence each read is; null for reads without one."""
    return reads.select(by, "read_idx", "seq").join(uniques.select(by, "seq", "uidx"), [by, "seq"], "left").select(by, "read_idx", "uidx")


def pool(uniques: DataFrame) -> DataFrame:
    """Uniques of all samples as one: (seq, abundance, n_samples, uidx)."""
    total = uniques.groupBy("seq").agg(F.sum("abundance").alias("abundance"), F.countDistinct("sample").alias("n_samples"))
    return with_rank(total, "uidx", F.desc("abundance"), F.col("seq"))


def with_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Number rows from 1 in a total order without a window over everything: ranges are sorted apart, and each begins after the counts of those before it."""
    from readloom.cluster import write_table

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33))
    ranged = write_table(ranged, "ranked")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("long")).drop("_part", "_at", "_before")


def rank_within(df: DataFrame, by: str, name: str, *order: Column) -> DataFrame:
    """Number rows from 1 in a total order within each value of ``by``, of which one may hold most rows: ranges of all rows are sorted apart, so the rows of one value may lie in several; each range numbers its own, after those of the ranges before it."""
    from readloom.cluster import write_table

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, F.col(by), *order).sortWithinPartitions(F.col(by), *order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33))
    ranged = write_table(ranged, "ranked")
    runs = ranged.groupBy("_part", by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))  # a row for each value in a range
    w = Window.partitionBy(by).orderBy("_part")
    runs = runs.select("_part", F.col(by).alias("_by"), (F.sum("_n").over(w) - F.col("_n") - F.col("_first")).alias("_shift"))
    out = ranged.join(runs, (ranged["_part"] == runs["_part"]) & ranged[by].eqNullSafe(runs["_by"]))
    return out.withColumn(name, (F.col("_at") + F.col("_shift") + 1).cast("int")).select(*df.columns, name)


def sequence_table(uniques: DataFrame) -> DataFrame:
    """(sample, seq, abundance), the long form of a table of samples by sequences."""
    return uniques.where("seq is not null and abundance > 0").groupBy("sample", "seq").agg(F.sum("abundance").alias("abundance"))


def column_order(table: DataFrame, by: str = "abundance") -> DataFrame:
    """(seq, total, n_samples, col): sequences in the order of the columns, by total 'abundance' or by number of samples ('nsamples'), then by sequence."""
    if by not in ("abundance", "nsamples"):
        raise ValueError(by)
    totals = table.groupBy("seq").agg(F.sum("abundance").alias("total"), F.count_if(F.col("abundance") > 0).alias("n_samples"))
    return with_rank(totals, "col", F.desc("total" if by == "abundance" else "n_samples"), F.col("seq"))


def pivot_samples(table: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """One row for each sequence and one column for each sample, 0 where it isn't found. Samples are few; pass them to save a pass."""
    return table.groupBy("seq").pivot("sample", samples).agg(F.sum("abundance")).na.fill(0)


def merge_tables(tables: list[DataFrame], repeats: str = "error", try_rc: bool = False) -> DataFrame:
    """Union by sequence of several tables.

    repeats: what to do with a sample that two tables hold: 'error' or 'sum'. try_rc: a sequence whose reverse complement
    comes earlier (by total abundance, then by sequence) is counted as that one.
    """
    tagged = tables[0].withColumn("_t", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        tagged = tagged.unionByName(t.withColumn("_t", F.lit(i)))
    if repeats == "error":
        twice = tagged.groupBy("sample").agg(F.min("_t").alias("a"), F.max("_t").alias("b")).where("a <> b").limit(3).collect()
        if twice:
            raise ValueError(f"samples in more than one table: {[r.sample for r in twice]}")
    elif repeats != "sum":
        raise ValueError(repeats)
    merged = tagged.groupBy("sample", "seq").agg(F.sum("abundance").alias("abundance"))
    return merge_orientations(merged) if try_rc else merged


def merge_orientations(table: DataFrame) -> DataFrame:
    """Each sequence that is the reverse complement of an earlier one (more abundant, or as abundant and first in order) becomes that one. Palindromes stay."""
    totals = table.groupBy("seq").agg(F.sum("abundance").alias("total"))
    mate = totals.select(reverse_complement(F.col("seq")).alias("seq"), F.col("seq").alias("mate"), F.col("total").alias("mate_total"))
    earlier = (F.col("mate_total") > F.col("total")) | ((F.col("mate_total") == F.col("total")) & (F.col("mate") < F.col("seq")))
    turned = totals.join(mate, "seq").where(earlier).select("seq", "mate")
    return table.join(turned, "seq", "left").groupBy("sample", F.coalesce("mate", "seq").alias("seq")).agg(F.sum("abundance").alias("abundance"))


def priors(table: DataFrame, prevalence: int = 2, abundance: float = float("inf")) -> DataFrame:
    """Sequences to expect in other samples: found in at least ``prevalence`` samples, or with that total abundance."""
    cond = F.col("n_samples") >= prevalence
    if abundance != float("inf"):
        cond |= F.col("total") >= abundance
    return table.groupBy("seq").agg(F.countDistinct("sample").alias("n_samples"), F.sum("abundance").alias("total")).where(cond)


def samples_up_to(reads: DataFrame, n_bases: int, order: str = "sample", seed: int | None = None) -> DataFrame:
    """(sample, bases, running): the samples in order (with a seed in one drawn at random), up to the one with which the bases exceed n_bases. There is one row for each sample here."""
    per = reads.groupBy("sample").agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))
    running = per.withColumn("running", F.sum("bases").over(Window.orderBy(order) if seed is None else Window.orderBy(F.xxhash64(F.lit(seed), order), order)))
    return running.where(F.col("running") - F.col("bases") <= n_bases)


def quality_profile(reads: DataFrame, by: list[str], qual: str = "qual") -> DataFrame:
    """(by..., cycle, n, mean_q, q25, q50, q75): qualities at each place of a read. A quantile is the first score whose share of all is at least that."""
    counted = reads.select(*by, F.posexplode(qual).alias("p", "q")).groupBy(*by, (F.col("p") + 1).alias("cycle"), F.col("q").cast("int").alias("q")).agg(F.count(F.lit(1)).alias("c"))
    # scores are few (at most 94 for each place), so this window never holds many rows
    w = Window.partitionBy(*by, "cycle").orderBy("q")
    cum = counted.withColumns({"cum": F.sum("c").over(w), "total": F.sum("c").over(Window.partitionBy(*by, "cycle"))})
    quantile = lambda x: F.min(F.when(F.col("cum") >= F.lit(x) * F.col("total"), F.col("q")))
    return cum.groupBy(*by, "cycle").agg(F.sum("c").alias("n"), (F.sum(F.col("q") * F.col("c")) / F.sum("c")).alias("mean_q"), *[quantile(x).alias(f"q{int(x * 100)}") for x in (0.25, 0.5, 0.75)])


def sample_records(df: DataFrame, n: int, key: str) -> DataFrame:
    """A fixed-size sample that is the same on every run: the n rows with the least hash of their key."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def gapless_transitions(reads: DataFrame, center: str, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """(nti, ntj, q, n): how often each letter of a centre was read as which letter at which quality, for reads laid on it without gaps. Other letters than A, C, G, T don't count."""
    at = reads.where(F.col(qual).isNotNull()).select(F.posexplode(F.zip_with(F.split(seq, ""), F.col(qual), lambda s, q: F.struct(s.alias("s"), q.cast("int").alias("q")))).alias("p", "x"))
    nti = F.instr(F.lit("ACGT"), F.substring(F.lit(center), F.col("p") + 1, F.lit(1))) - 1
    ntj = F.instr(F.lit("ACGT"), F.col("x.s")) - 1
    return at.select(nti.alias("nti"), ntj.alias("ntj"), F.col("x.q").alias("q")).where("nti >= 0 and ntj >= 0 and q is not null").groupBy("nti", "ntj", "q").agg(F.count(F.lit(1)).alias("n"))


def gapless_log_rate(seq: Column, qual: Column, center: str) -> Column:
    """log of the rate at which a centre gives a read by the definition of qualities, laid on it without gaps; a letter that isn't A, C, G, T counts as read right."""
    e = lambda q: F.pow(F.lit(10.0), -q.cast("double") / 10)
    letters = F.zip_with(F.split(seq, ""), F.split(F.lit(center), ""), lambda a, b: (a == b) | ~a.isin("A", "C", "G", "T"))
    return F.aggregate(F.zip_with(letters, qual, lambda same, q: F.when(same, F.ln(1 - e(q))).otherwise(F.ln(e(q) / 3))), F.lit(0.0), lambda s, x: s + x)
