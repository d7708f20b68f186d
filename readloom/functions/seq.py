"""Column expressions on nucleotide sequences and their qualities. All but complexity, shared_kmers and word_hits stay in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.kernels import words

#: The nucleotide codes and their complements.
CODES, COMPLEMENTS = "ACGTRYKMBVDHSWN", "TGCAYRMKVBHDSWN"


def filled(known: np.ndarray, values, kind: str) -> pd.Series:
    """The values where something is known, in order, and nulls elsewhere."""
    out = np.full(len(known), None, object)
    out[known] = values
    return pd.Series(out, dtype=kind)


def reverse_complement(seq: Column) -> Column:
    """IUPAC-aware; '' gives '', null gives null."""
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


def is_acgt(seq: Column) -> Column:
    """Only A, C, G, T; true for ''."""
    return seq.rlike(r"^[ACGT]*\z")


def count_ambiguous(seq: Column) -> Column:
    """Letters other than A, C, G, T."""
    return F.length(F.translate(seq, "ACGT", ""))


def expected_errors(qual: Column) -> Column:
    """Sum of 10^(-Q/10); 0 for an empty array, null for null."""
    return F.aggregate(qual, F.lit(0.0), lambda a, q: a + F.pow(F.lit(10.0), -q.cast("double") / 10.0))


def first_at_most(qual: Column, q: int) -> Column:
    """1-based place of the first quality of at most q; 0 if there is none."""
    return F.array_position(F.transform(qual, lambda x: x <= q), F.lit(True)).cast("int")


def kmers(seq: Column, k: int) -> Column:
    """All words of k letters in order; an empty array for a shorter sequence."""
    n = F.length(seq) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def window_codes(seq: Column, k: int) -> Column:
    """A 64-bit hash of each word of k letters in order; an empty array for a shorter sequence."""
    return F.transform(kmers(seq, k), lambda x: F.xxhash64(x))


def complexity(seq: Column, k: int = 2, window: int | None = None, by: int = 5) -> Column:
    """Effective number of different k-mers (exp of their Shannon entropy) among those of A, C, G and T.

    With a window, the least of all windows that begin at 1, 1 + by, ... and fit in the sequence; 4^k where none fits.
    A sequence without k-mers gives 1, null gives null. Arrow batches: expressions would count each word by a scan of its own.
    """

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        return filled(known, words.complexities(x[known].tolist(), k, window, by), "float64")

    return run(seq)


def shared_kmers(a: Column, b: Column, k: int) -> Column:
    """Sum over words of the smaller of both counts."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = (x.notna() & y.notna()).to_numpy()
        p, q = x[known].tolist(), y[known].tolist()
        return filled(known, words.shared_counts(p, q, k) if k <= 7 else [words.shared(s, t, k) for s, t in zip(p, q, strict=True)], "Int32")

    return run(a, b)


def equal_ordered_kmers(a: Column, b: Column, k: int) -> Column:
    """Places at which both sequences have the same word, over the length of the shorter one."""
    return F.aggregate(F.zip_with(kmers(a, k), kmers(b, k), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)


def _places(a: Column, b: Column, k: int) -> Column:
    return F.least(F.length(a), F.length(b)) - k + 1


def kmer_distance(a: Column, b: Column, k: int = 5) -> Column:
    """1 - shared words / words of the shorter one; null if that has none."""
    return 1 - F.try_divide(shared_kmers(a, b, k), F.when(_places(a, b, k) > 0, _places(a, b, k)))


def ordered_kmer_distance(a: Column, b: Column, k: int = 5) -> Column:
    """1 - words equal at the same place / words of the shorter one. Over sequences of different length it compares the common prefix."""
    return 1 - F.try_divide(equal_ordered_kmers(a, b, k), F.when(_places(a, b, k) > 0, _places(a, b, k)))


def differences(a: Column, b: Column) -> Column:
    """array of (pos, a, b) where two sequences of equal length differ; pos from 1."""
    zipped = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    marked = F.transform(zipped, lambda s, i: F.struct((i + 1).alias("pos"), s["x"].alias("a"), s["y"].alias("b")))
    return F.filter(marked, lambda s: s["a"] != s["b"])


def genus_matches(tax: Column, binomial: Column, glyph: str = "/") -> Column:
    """Does a genus of a binomial agree with an assigned genus? False for nulls and ''. True if equal, or if ``tax`` begins with the binomial's genus and a blank, '_' or ``glyph``, or ends with ``glyph`` and it."""
    starts = [F.startswith(tax, F.concat(binomial, F.lit(s))) for s in (" ", "_", glyph)]
    return F.coalesce((tax != "") & (binomial != "") & ((tax == binomial) | starts[0] | starts[1] | starts[2] | F.endswith(tax, F.concat(F.lit(glyph), binomial))), F.lit(False))


def word_hits(seq: Column, known: frozenset[str], word: int, non_overlapping: bool) -> Column:
    """How many of a sequence's words are among ``known``; without overlaps a hit is followed by the word that begins ``word`` + 1 later. Words with other letters than A, C, G, T are never known. Arrow batches: all words of a batch are looked up at once."""

    look_up = words.Known(known, word)

    @F.pandas_udf("int")
    def run(x: pd.Series) -> pd.Series:
        valid = x.notna().to_numpy()
        return filled(valid, look_up.hits(x[valid].tolist(), non_overlapping), "Int32")

    return run(seq)
