"""Several values packed in one field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that belong to a value outside quotes, as a regular expression's class; all others separate values.
INSIDE = r"\p{L}\p{N} _\-./()\[\]"
#: Pieces folded at a time: a fold appends to an array, so a very long field is folded in parts.
PART = 64


def _fold(pieces: Column, inside: str) -> Column:
    """Folds pieces into (kind, text) marks. kind 0: text outside quotes, 1: text of a literal, 2: a quote that separates.

    The state is the quote that is open ('' if none), whether it closed just now, and whether the value that is being
    read has no text yet, in which case a quote opens a literal.
    """
    blank = rf"(?:^|[^{inside}])[ ]*\z"

    def step(s: Column, p: Column) -> Column:
        quote = p.isin('"', "'")
        opened = s["open"] != ""
        closes = opened & (p == s["open"])
        doubled = ~opened & (p == s["shut"])
        opens = ~opened & ~doubled & quote & s["fresh"]
        mark = (
            F.when(opened & ~closes, F.struct(F.lit(1).alias("kind"), p.alias("text")))
            .when(doubled, F.struct(F.lit(1).alias("kind"), p.alias("text")))
            .when(closes | opens, F.struct(F.lit(1).alias("kind"), F.lit("").alias("text")))
            .when(quote, F.struct(F.lit(2).alias("kind"), p.alias("text")))
            .otherwise(F.struct(F.lit(0).alias("kind"), p.alias("text")))
        )
        return F.struct(
            F.when(closes, F.lit("")).when(doubled | opens, p).otherwise(s["open"]).alias("open"),
            F.when(closes, p).otherwise(F.lit("")).alias("shut"),
            F.when(opened | doubled | opens, F.lit(False)).when(quote, F.lit(True)).when(p.rlike(blank), F.when(p.rlike(r"^ *\z"), s["fresh"]).otherwise(F.lit(True))).otherwise(F.lit(False)).alias("fresh"),
            F.array_append(s["marks"], mark).alias("marks"),
        )

    none = F.array().cast("array<struct<kind:int,text:string>>")
    start = F.struct(F.lit("").alias("open"), F.lit("").alias("shut"), F.lit(True).alias("fresh"), none.alias("marks"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / PART).cast("int")), lambda i: F.slice(pieces, i * PART + 1, PART))
    return F.aggregate(
        parts,
        F.struct(start.alias("s"), F.array().cast("array<array<struct<kind:int,text:string>>>").alias("all")),
        lambda acc, part: _carry(acc, F.aggregate(part, acc["s"].withField("marks", none), step)),
        lambda acc: F.flatten(acc["all"]),
    )


def _carry(acc: Column, s: Column) -> Column:
    return F.struct(s.alias("s"), F.array_append(acc["all"], s["marks"]).alias("all"))


#: Signs of the joined text, and what they are in it where a literal has them.
ESCAPES = (("\x1d", "\x1d0"), ("\x1f", "\x1d1"), ("\x1e", "\x1d2"))


def _escaped(text: Column) -> Column:
    for sign, name in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _plain(text: Column) -> Column:
    for sign, name in reversed(ESCAPES):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def split_packed(df: DataFrame, id_col: str, field: str, inside: str = INSIDE) -> DataFrame:
    """(id_col, pos, item): one row for each value packed in ``field``, in order from 1.

    The field is split on its quote characters into pieces; a fold over them tells literals from the rest and which
    doubled quotes stand for one. Outside literals every character not in ``inside`` separates two values; pieces are
    split there, and what belongs to one value is put together again: pieces outside quotes are given separators
    (U+001F) that stand in literals under another name, all are joined and split once. All in SQL expressions, row by row, without a shuffle.

    A quote opens a literal only where a value has no text yet; elsewhere it separates, like any other such sign. Blanks
    around a value and its quotes don't belong to it, blanks within a literal's ends do not either. An empty value keeps
    its number and gives no row; text after a closed literal belongs to its value. A quote never closed reads to the end.
    Null and empty fields give no rows; repeated rows are split each by itself; other columns are ignored.
    """
    pieces = F.split(F.col(field), r"""(?=["'])|(?<=["'])""")
    marks = _fold(F.filter(pieces, lambda p: p != ""), inside)
    joined = F.array_join(F.transform(marks, lambda m: F.when(m["kind"] == 1, F.translate(_escaped(m["text"]), " ", "\x1e")).when(m["kind"] == 2, F.lit("\x1f")).otherwise(F.regexp_replace(m["text"], rf"[^{inside}]", "\x1f"))), "")
    values = F.split(joined, "\x1f")
    trimmed = F.transform(values, lambda v: _plain(F.trim(F.translate(F.trim(v), "\x1e", " "))))
    return df.where(F.length(field) > 0).select(id_col, F.posexplode(trimmed).alias("p", "item")).where("item <> ''").select(id_col, (F.col("p") + 1).alias("pos"), "item")
