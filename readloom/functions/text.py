"""Column expressions on layout: the parts of a field that carry its meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bases(col: Column) -> Column:
    """The letters of a sequence field in upper case; everything else is layout. Null stays null; a field without letters gives ''."""
    up = F.upper(col)
    # \\z and not $, which also matches before a line break at the end.
    return F.when(up.rlike(r"^[A-Z]*\z"), up).otherwise(F.regexp_replace(up, r"[^\p{L}]+", ""))


def header_field(col: Column, name: str) -> Column:
    """The value of one named field of a header, in lower case, whatever the order, case, blanks and punctuation around it; '' if it isn't there."""
    return F.regexp_extract(F.lower(col), rf"(?:^|[^a-z0-9]){name}[^a-z0-9]*([a-z0-9]+)", 1)


def hash128(col: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(col), F.xxhash64(F.lit("second half"), col)]
