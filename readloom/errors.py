"""Error models: from counts of transitions to rates. Matrices have 16 rows (from * 4 + to, in the order A, C, G, T) and a column for each quality; small arithmetic on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ErrorFunction = Callable[[np.ndarray], np.ndarray]
#: Bounds of an estimated rate.
LEAST, MOST = 1e-7, 0.25


def _finish(rates: np.ndarray) -> np.ndarray:
    """Clamp the rates of substitutions and give each letter the rest for staying itself."""
    out = np.clip(rates, LEAST, MOST)
    for i in range(4):
        out[5 * i] = 0
        out[5 * i] = 1 - out[4 * i : 4 * i + 4].sum(0)
    return out


def local_regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, at: np.ndarray, span: float = 0.75) -> np.ndarray:
    """Local quadratic regression with tricube weights at each of ``at``; NaN outside the range of x. Fitted directly at each point, not interpolated between vertices."""
    n = len(x)
    q = min(n, int(np.floor(n * span + 1e-5)))
    out = np.full(len(at), np.nan)
    for i, a in enumerate(at):
        if n == 0 or a < x.min() or a > x.max():
            continue
        d = np.abs(x - a)
        h = max(np.sort(d)[q - 1], 1e-12) * 1.001
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0) * weight
        root = np.sqrt(w)
        terms = min(3, int((w > 0).sum()))
        basis = np.vander(x - a, terms, increasing=True)
        out[i] = np.linalg.lstsq(basis * root[:, None], y * root, rcond=None)[0][0]
    return out


def loess_errors(trans: np.ndarray) -> np.ndarray:
    """Smooth log10 of (count + 1) / total over quality for each substitution, weighted by totals; flat beyond the qualities seen."""
    q = np.arange(trans.shape[1], dtype=float)
    out = np.zeros(trans.shape)
    for i in range(4):
        total = trans[4 * i : 4 * i + 4].sum(0)
        seen = total > 0
        for j in range(4):
            if i == j or not seen.any():
                continue
            y = np.log10((trans[4 * i + j][seen] + 1) / total[seen])
            fit = local_regression(q[seen], y, total[seen].astype(float), q)
            known = np.flatnonzero(~np.isnan(fit))
            out[4 * i + j] = 10 ** np.interp(q, q[known], fit[known])
    return _finish(out)


def binned_errors(bins: Sequence[int]) -> ErrorFunction:
    """For reads with few different qualities: rates at each of ``bins``, lines between them and flat beyond. Qualities in the data beyond the bins raise ValueError."""
    bins = sorted(set(bins))

    def estimate(trans: np.ndarray) -> np.ndarray:
        q = np.arange(trans.shape[1])
        seen = np.flatnonzero(trans.sum(0) > 0)
        if len(seen) and (seen.min() < bins[0] or seen.max() > bins[-1]):
            raise ValueError(f"qualities {seen.min()} to {seen.max()} lie beyond the bins {bins[0]} to {bins[-1]}")
        out = np.zeros(trans.shape)
        for i in range(4):
            total = trans[4 * i : 4 * i + 4].sum(0)
            use = [b for b in bins if b < len(q) and total[b] > 0]
            for j in range(4):
                if i != j and use:
                    out[4 * i + j] = np.interp(q, use, [trans[4 * i + j][b] / total[b] for b in use])
        return _finish(out)

    return estimate


def long_read_errors(trans: np.ndarray) -> np.ndarray:
    """Smoothed below quality 93; at 93, which means 'best', the plain rates (count + 1) / (total + 4), those of staying included."""
    if trans.shape[1] < 94:
        return loess_errors(trans)
    low = loess_errors(trans[:, :93])
    last = np.array([(trans[4 * i + j, 93] + 1) / (trans[4 * i : 4 * i + 4, 93].sum() + 4) for i in range(4) for j in range(4)])
    return np.hstack([low, last[:, None]])


def flat_errors(trans: np.ndarray, pseudocount: float = 1) -> np.ndarray:
    """One rate for each substitution whatever the quality."""
    n = trans.sum(1) + pseudocount
    return np.repeat(np.array([n[k] / n[4 * (k // 4) : 4 * (k // 4) + 4].sum() for k in range(16)])[:, None], trans.shape[1], 1)


def nominal_errors(max_q: int = 40) -> np.ndarray:
    """What qualities mean by definition: 10^(-Q/10), shared by the three other letters."""
    e = 10 ** (-np.arange(max_q + 1) / 10)
    return np.array([1 - e if k // 4 == k % 4 else e / 3 for k in range(16)])


def inflate(err: np.ndarray, factor: float, itself: bool = False) -> np.ndarray:
    """Rates of substitutions raised to f * e / (1 + (f - 1) * e)."""
    out = factor * err / (1 + (factor - 1) * err)
    if not itself:
        out[[0, 5, 10, 15]] = err[[0, 5, 10, 15]]
    return out


def checked(err: np.ndarray) -> np.ndarray:
    """The matrix itself if it can be one."""
    err = np.asarray(err, float)
    if err.ndim != 2 or err.shape[0] != 16 or not ((err >= 0) & (err <= 1)).all():
        raise ValueError("an error matrix has 16 rows of rates from 0 to 1")
    return err


def to_matrix(trans: DataFrame, columns: int | None = None) -> np.ndarray:
    """(nti, ntj, q, n), at most 16 * 251 rows, as a matrix of counts."""
    rows = trans.groupBy("nti", "ntj", "q").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((16, columns or max([41, *(r.q + 1 for r in rows)])), np.int64)
    for r in rows:
        out[4 * r.nti + r.ntj, r.q] = r.n
    return out


def accumulate(trans: list[DataFrame]) -> DataFrame:
    """Counts of several samples or runs added up, whatever qualities each has."""
    out = trans[0].select("nti", "ntj", "q", "n")
    for t in trans[1:]:
        out = out.unionByName(t.select("nti", "ntj", "q", "n"))
    return out.groupBy("nti", "ntj", "q").agg(F.sum("n").alias("n"))


def observed_rates(trans: DataFrame) -> DataFrame:
    """(nti, ntj, q, n, total, rate, nominal): for a plot of rates against quality."""
    totals = trans.groupBy("nti", "q").agg(F.sum("n").alias("total"))
    e = F.pow(F.lit(10.0), -F.col("q") / 10)
    return trans.join(totals, ["nti", "q"]).select("nti", "ntj", "q", "n", "total", (F.col("n") / F.col("total")).alias("rate"), F.when(F.col("nti") == F.col("ntj"), 1 - e).otherwise(e / 3).alias("nominal"))
