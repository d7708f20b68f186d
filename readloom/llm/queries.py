"""Queries of this subpackage: each reads whole tables and applies an operator with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.cluster import write_table
from readloom.functions.text import bases, header_field
from readloom.llm import duplicates, frequent, leaks, mojibake, packing, similar, spans, terms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derep_copies(spark: SparkSession, d: str) -> duplicates.Copies:
    canon = F.concat_ws("|", *[header_field(F.col("header"), n) for n in ("sq", "size", "sample", "chunk")], bases(F.col("uniques")))
    return duplicates.fold_copies(table(spark, d, "derep"), "derep_id", F.when(F.col("header").isNotNull() & F.col("uniques").isNotNull(), canon))


def _clustering_copies(spark: SparkSession, d: str) -> duplicates.Copies:
    canon = F.concat_ws("|", F.coalesce(F.lower("sample"), F.lit("")), F.coalesce(F.col("cluster_no").cast("string"), F.lit("")), bases(F.col("sequence")))
    return duplicates.fold_copies(table(spark, d, "clustering"), "clustering_id", F.when(F.col("sequence").isNotNull(), canon))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    both = [c.pairs().select(F.lit(src).alias("src"), "first_id", "copy_id") for src, c in (("derep", _derep_copies(spark, d)), ("clustering", _clustering_copies(spark, d)))]
    return both[0].unionByName(both[1])


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """Each record once, with the number of its copies."""
    both = [duplicates.records(c).select(F.lit(src).alias("src"), "first_id", "n_copies") for src, c in (("derep", _derep_copies(spark, d)), ("clustering", _clustering_copies(spark, d)))]
    return both[0].unionByName(both[1])


def _p2(spark: SparkSession, d: str) -> DataFrame:
    return similar.similar_groups(table(spark, d, "clustering"), "clustering_id", bases(F.col("sequence")), 0.6, 8)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).where("id <> group_id").select("group_id", F.col("id").alias("clustering_id"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each group with the number of its members and the sum of their abundance (null counts 0)."""
    members = _p2(spark, d).join(table(spark, d, "clustering").select(F.col("clustering_id").alias("id"), "abundance"), "id")
    return members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"), F.coalesce(F.sum("abundance"), F.lit(0)).alias("abundance"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """A value with 0.2% of all rows is among the 500 most frequent ones."""
    return frequent.frequent_values(table(spark, d, "derep"), "uniques", 500, 0.002).select(F.col("value").alias("uniques"))


def p3_top(spark: SparkSession, d: str) -> DataFrame:
    """The 25 most frequent values with their counts."""
    return frequent.frequent_values(table(spark, d, "derep"), "uniques", 25).select(F.col("value").alias("uniques"), "n_rows")


def _p4(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_table(table(spark, d, "makesequencetable"), "sequence", "sample", "abundance")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d).where("mark is not null").select(F.col("term").alias("sequence"), "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence with total abundance, samples and mark, and whether nsamples was reported rightly for each of its runs (null: never reported)."""
    rows = table(spark, d, "makesequencetable").where("sequence is not null and sample is not null")
    by_run = rows.groupBy("sequence", "run", "sample").agg(F.min("nsamples").alias("lo"), F.max("nsamples").alias("hi")).groupBy("sequence", "run").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    told = by_run.groupBy("sequence").agg(F.min((F.col("lo") == F.col("n")) & (F.col("hi") == F.col("n"))).alias("nsamples_right"))
    return _p4(spark, d).withColumnRenamed("term", "sequence").join(told, "sequence").select("sequence", "total", "n_records", "mark", "nsamples_right")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "clustering"), "clustering_id", bases(F.col("sequence")), 50).withColumnRenamed("id", "clustering_id")


def p6_levels(spark: SparkSession, d: str) -> DataFrame:
    """For every row the number of its bases, how many of them are shared, and the longest level of the doubling at which it still shares a window."""
    return spans.shared_levels(table(spark, d, "clustering"), "clustering_id", bases(F.col("sequence")), 50).withColumnRenamed("id", "clustering_id")


#: Tokens of a training window.
WINDOW = 2048


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    """Where each text, or each piece of one larger than a window, lies in which window."""
    return packing.pack_windows(write_table(packing.token_counts(table(spark, d, "documents"), "doc_id", "text"), "tokens"), WINDOW).withColumnRenamed("id", "doc_id")


def p8_balance(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the windows: every document is placed, in one piece unless it is larger than a window; pieces of one document follow one another; no window holds more than fits, and no two pieces in it overlap."""
    placed = write_table(p8_windows(spark, d), "windows")
    docs = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("token_from") + F.col("n_tokens")).alias("end"), F.countDistinct("piece").alias("numbers"))
    w = Window.partitionBy("window_id").orderBy("window_from")
    inside = placed.where("window_id is not null").withColumn("before", F.lag(F.col("window_from") + F.col("n_tokens")).over(w))
    wrong = lambda what, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    out = wrong("documents", docs)
    out = out.unionByName(wrong("cut in vain", docs.where((F.col("n") <= WINDOW) & (F.col("pieces") > 1))))
    out = out.unionByName(wrong("pieces apart", docs.where("n <> end or pieces <> numbers")))
    out = out.unionByName(wrong("overfull", placed.where(F.col("window_from") + F.col("n_tokens") > WINDOW)))
    return out.unionByName(wrong("overlapping", inside.where("window_from < before")))


def _p9(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d).where("exact_words >= 13").select("doc_id", "item_id")


def p9_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Also passages in which single words were replaced, with the length of the overlap."""
    return _p9(spark, d)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents"), "doc_id", "text", "repo").select(F.col("id").alias("doc_id"))


def p10_method(spark: SparkSession, d: str) -> DataFrame:
    """Those found by pairs of characters and inverse mappings alone, without the texts that only have lost characters."""
    return mojibake.garbled(table(spark, d, "documents"), "doc_id", "text", "repo").where("how is not null").select(F.col("id").alias("doc_id"))


def p10_lost(spark: SparkSession, d: str) -> DataFrame:
    """Texts in which characters were lost for good."""
    return mojibake.lost_characters(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled texts with what could be restored, and which encodings were confused."""
    return mojibake.garbled(table(spark, d, "documents"), "doc_id", "text", "repo").withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    from readloom.llm import sql

    return sql.oracle_sql()
