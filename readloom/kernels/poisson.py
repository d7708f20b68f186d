"""Tails of the Poisson distribution."""

from __future__ import annotations

from functools import lru_cache
from math import lgamma

import numpy as np


@lru_cache(maxsize=8)
def _log_factorials(n: int) -> np.ndarray:
    return np.array([lgamma(i + 1) for i in range(n + 1)])


def log_tail(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """log P(X >= k) for X with the given means; down to the smallest numbers a logarithm can hold.

    Where k lies above the mean the terms from k on fall and are added up, relative to the first one; below it, 1 minus the
    sum of the terms before k, which fall from k - 1 downwards.
    """
    k, mean = np.broadcast_arrays(np.asarray(k, np.int64), np.asarray(mean, np.float64))
    out = np.zeros(k.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        first = k * np.log(mean) - mean - _log_factorials(1 << int(max(k.max(initial=1), 1)).bit_length())[np.maximum(k, 0)]
    up = (k > mean) & (k > 0)
    total, term, j = np.ones(k.shape), np.ones(k.shape), 1
    while up.any() and j < 100_000:
        term = np.where(up, term * mean / (k + j), 0)
        total += term
        if (term < total * 1e-17).all():
            break
        j += 1
    out = np.where(up, first + np.log(total), out)
    down = ~up & (k > 0)
    if down.any():
        total, term, j = np.ones(k.shape), np.ones(k.shape), 1
        while j < 1_000_000:
            term = np.where(down & (k - j > 0), term * (k - j) / np.maximum(mean, 1e-300), 0)
            total += term
            if (term < total * 1e-17).all():
                break
            j += 1
        with np.errstate(divide="ignore"):
            below = np.exp(first + np.log(np.maximum(k, 1)) - np.log(np.maximum(mean, 1e-300)) + np.log(total))
        out = np.where(down, np.log1p(-np.minimum(below, 1 - 1e-16)), out)
    return np.where((mean <= 0) & (k > 0), -np.inf, out)


def tail(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """P(X >= k)."""
    return np.exp(log_tail(k, mean))
