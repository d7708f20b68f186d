"""Records that are identical but for layout."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.cluster import write_table
from readloom.functions.text import hash128
from readloom.operators.skew import skew_join


@dataclass(frozen=True)
class Copies:
    """rows: (id, k1, k2), one for each row that has a canonical form. groups: (k1, k2, first_id, n), one for each record."""

    rows: DataFrame
    groups: DataFrame
    total: int

    def expand(self, groups: DataFrame) -> DataFrame:
        """The rows of those records in ``groups`` (some of self.groups, with any further columns) and the record's columns. Skew-proof."""
        return skew_join(self.rows, groups, ["k1", "k2"], "n", self.total, F.col("id")).drop("k1", "k2")

    def pairs(self) -> DataFrame:
        """(first_id, copy_id): every copy of a record but the one with the smallest id."""
        return self.expand(self.groups.where("n > 1")).where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def fold_copies(df: DataFrame, id_col: str, canon: Column, hashes: Callable[[Column], list[Column]] = hash128, text: bool = False) -> Copies:
    """Group rows whose canonical text ``canon`` is the same, by a 128-bit hash of it.

    Only hashes, a check value and the id are shuffled, after partial aggregation on the map side; no group is ever
    gathered. The check (CRC and length of the text) must agree within each group; if it does not anywhere, two texts
    collided and the whole grouping is done again by the text itself, which is exact.

    With ``text``, groups also have the canonical text of each record.

    Rows with a null canonical text have no record and are left out; an empty text is a text. Repeated rows with one id
    are one row. An empty table gives empty results.
    """
    src = df.select(F.col(id_col).alias("id"), canon.alias("canon")).where("canon is not null and id is not null")
    k1, k2 = hashes(F.col("canon"))
    check = F.crc32(F.col("canon").cast("binary")) * F.lit(1 << 20) + F.length("canon") % (1 << 20)
    rows = src.select("id", k1.alias("k1"), k2.alias("k2"))
    also = [F.first("canon").alias("text")] if text else []
    kept = ["text"] if text else []
    folded = src.select("id", k1.alias("k1"), k2.alias("k2"), check.alias("c"), *["canon"] * text).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.min("c").alias("lo"), F.max("c").alias("hi"), *also)
    groups = write_table(folded.select("k1", "k2", "n", "first_id", (F.col("lo") != F.col("hi")).alias("collided"), *kept), "copies")
    total, collided = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.col("collided").cast("int")), F.lit(0))).first()
    if collided:
        rows = src.select("id", F.col("canon").alias("k1"), F.lit(0).cast("long").alias("k2"))
        groups = write_table(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), *([F.first("k1").alias("text")] if text else [])), "copies-exact")
    return Copies(rows, groups.select("k1", "k2", "n", "first_id", *kept), total)


def records(copies: Copies) -> DataFrame:
    """(first_id, n_copies): each record once, with the number of its rows."""
    return copies.groups.select("first_id", F.col("n").alias("n_copies"))
