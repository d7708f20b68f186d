"""How often every distinct term occurs and in how many records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import skew

UNSEEN = np.iinfo(np.int64).min
#: Cells of the local arrays of a task; when they are full, it sends them and begins anew.
CELLS = 8_000_000


def term_table(df: DataFrame, term: str, record: str, amount: str, heavy_share: float = 0.0005, common_above: float = 0.5, rare_records: int = 1, rare_total: int = 2) -> DataFrame:
    """(term, total, n_records, mark) for every distinct term.

    A (term, record) pair counts once; of its rows the largest amount holds, and one with no known amount adds 0.
    ``mark`` is 'common' for a term in more than ``common_above`` of all records that occur in df, 'rare' for one in at
    most ``rare_records`` with a total of at most ``rare_total``, else null.

    Heavy terms (at least ``heavy_share`` of all rows, or half of what a shuffle partition holds on average if that is
    less: a bounded number, see ``skew.heavy_share``) are broadcast; each task adds them up in exact local arrays indexed by
    term and record, and sends (term number, record, amount) once for each pair it saw. Only the other terms are shuffled as
    text. Both go through one shuffle by term and record, combined on the map side, and a second one by term, so that no
    term below the share makes a long task either; the union of both tables is the result.

    Null terms and null records are left out, but records with null terms only count among all records; the empty string is a term. An empty table gives no rows.
    """
    src = df.select(F.col(term).cast("string").alias("term"), F.col(record).cast("string").alias("record"), F.col(amount).cast("long").alias("amount")).where("record is not null")
    n_all = src.agg(F.countDistinct("record")).first()[0]
    src = src.where("term is not null")
    spark = df.sparkSession
    heavy, _ = skew.heavy_keys(src, "term", skew.heavy_share(spark, heavy_share))
    names = sorted(r[0] for r in heavy.collect())
    words = spark.sparkContext.broadcast(pa.array(names, pa.string()))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, records, best = words.value, {}, np.full((len(words.value), 64), UNSEEN, np.int64)

        def seen() -> pa.RecordBatch:
            t, r = np.nonzero(best != UNSEEN)
            return pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.nulls(len(t), pa.string()), pa.array(list(records), pa.string()).take(pa.array(r)), pa.array(best[t, r])], ["t", "term", "record", "amount"])

        for b in batches:
            at = pc.index_in(b.column(0), value_set=dictionary)
            known = pc.is_valid(at)
            light = b.filter(pc.invert(known))
            yield pa.RecordBatch.from_arrays([pa.nulls(light.num_rows, pa.int32()), light.column(0), light.column(1), pc.fill_null(light.column(2), 0)], ["t", "term", "record", "amount"])
            rec = b.column(1).filter(known).dictionary_encode()
            if not len(rec):
                continue
            if (len(records) + len(rec.dictionary)) * len(dictionary) > CELLS and records:
                yield seen()
                records, best = {}, np.full((len(dictionary), 64), UNSEEN, np.int64)
            here = np.array([records.setdefault(r, len(records)) for r in rec.dictionary.to_pylist()], np.int64)
            if len(records) > best.shape[1]:
                best = np.concatenate([best, np.full((best.shape[0], max(best.shape[1], len(records) - best.shape[1])), UNSEEN, np.int64)], axis=1)
            np.maximum.at(best, (at.filter(known).to_numpy(), here[rec.indices.to_numpy()]), pc.fill_null(b.column(2).filter(known), 0).to_numpy())
        yield seen()

    rows = src.mapInArrow(local, "t int, term string, record string, amount long") if names else src.select(F.lit(None).cast("int").alias("t"), "term", "record", F.coalesce("amount", F.lit(0)).alias("amount"))
    pairs = rows.groupBy("t", "term", "record").agg(F.max("amount").alias("amount"))
    both = pairs.groupBy("t", "term").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n_records"))
    numbered = F.broadcast(spark.createDataFrame(list(enumerate(names)), "t int, name string"))
    both = both.join(numbered, "t", "left").select(F.coalesce("name", "term").alias("term"), "total", "n_records")
    mark = F.when(F.col("n_records") > F.lit(common_above * n_all), "common").when((F.col("n_records") <= rare_records) & (F.col("total") <= rare_total), "rare")
    return both.withColumn("mark", mark)
