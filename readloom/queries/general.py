"""Queries for packed fields and uneven keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.packed import split_packed
from readloom.operators.skew import heavy_keys, heavy_share, salted_aggregate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "reffasta"), "ref_id", "id")


def _p7(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    derep = table(spark, d, "derep").select(F.col("uniques").alias("key"), "abundance", "sample")
    clustering = table(spark, d, "clustering").select(F.col("abundance").cast("string").alias("key"), "abundance", "sample")
    return {"derep": derep, "clustering": clustering}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for src, df in _p7(spark, d).items():
        heavy, total = heavy_keys(df, "key", heavy_share(spark, 0.002))
        per_key = salted_aggregate(df, "key", "abundance", "sample", heavy=heavy)
        out.append(per_key.where(F.col("n_rows") >= 0.01 * total).select(F.lit(src).alias("src"), F.col("key").alias("hot_key")))
    return out[0].unionByName(out[1])


def p7_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Rows, total abundance and samples of every value of both columns."""
    out = [salted_aggregate(df, "key", "abundance", "sample").select(F.lit(src).alias("src"), "key", "n_rows", F.col("total").alias("total_abundance"), F.col("n_members").alias("n_samples")) for src, df in _p7(spark, d).items()]
    return out[0].unionByName(out[1])


P7_SQL = """
select 'derep' src, uniques "key", count(*) n_rows, cast(coalesce(sum(abundance), 0) as bigint) total_abundance, count(distinct sample) n_samples from derep where uniques is not null group by uniques
union all
select 'clustering', cast(abundance as varchar), count(*), cast(coalesce(sum(abundance), 0) as bigint), count(distinct sample) from clustering where abundance is not null group by abundance
"""


#: Values with the separator before each: a literal where a value begins, then what belongs to values outside quotes.
_IN = r"\p{L}\p{N} _\-./()\[\]"
P5_SQL = rf"""with v as (select ref_id, regexp_extract_all(concat(';', id), '(?s)[^{_IN}]( *(?:"(?:[^"]|"")*"|''(?:[^'']|'''')*'')?[{_IN}]*)', 1) x from reffasta where length(id) > 0),
u as (select ref_id, cast(unnest(range(1, len(x) + 1)) as int) pos, trim(unnest(x)) item from v),
q as (select ref_id, pos, case left(item, 1) when '"' then concat(trim(replace(regexp_extract(item, '(?s)^"((?:[^"]|"")*)"', 1), '""', '"')), regexp_extract(item, '(?s)^"(?:[^"]|"")*"(.*)$', 1)) when '''' then concat(trim(replace(regexp_extract(item, '(?s)^''((?:[^'']|'''')*)''', 1), '''''', '''')), regexp_extract(item, '(?s)^''(?:[^'']|'''')*''(.*)$', 1)) else item end item from u)
select ref_id, pos, trim(item) item from q where trim(item) <> ''"""


def queries() -> dict:
    return {"p5_found": p5_found, "p7_found": p7_found, "p7_per_key": p7_per_key}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": P5_SQL,
        "p7_found": f"with k as ({P7_SQL}), n as (select 'derep' src, count(*) n from derep union all select 'clustering', count(*) from clustering) select k.src, k.\"key\" hot_key from k join n on k.src = n.src where k.n_rows >= 0.01 * n.n",
        "p7_per_key": P7_SQL,
    }
