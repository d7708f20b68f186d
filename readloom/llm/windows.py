"""Hashes of all windows of many texts at once (numpy)."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _SEEDS[0]
    return h ^ (h >> np.uint64(32))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order, by sorting."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def concat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in one array, and where each text begins (one more entry at the end)."""
    ends = np.cumsum([0, *map(len, texts)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), ends


def window_hashes(codes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` values; those that reach over the end of a text are the caller's to drop. Built by doubling."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, out, at = mix(codes + _SEEDS[seed]), 1, None, 0
    while True:
        if width & size:
            out = level[at : at + n].copy() if out is None else mix(out * _MIX + level[at : at + n])
            at += size
        if size * 2 > width:
            return out
        level = mix(level[:-size] * _SEEDS[seed] + level[size:])
        size *= 2


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    level, size, out, at = h, 1, None, 0
    while True:
        if width & size:
            out = level[at : at + n] if out is None else np.minimum(out, level[at : at + n])
            at += size
        if size * 2 > width:
            return out
        level = np.minimum(level[:-size], level[size:])
        size *= 2


def window_starts(ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows that lie within one text: where they begin in the whole array, and their text's number."""
    counts = np.maximum(np.diff(ends) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return ends[:-1][owner] + within, owner
