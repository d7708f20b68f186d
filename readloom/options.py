"""Parameters of denoising."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    """Defaults are fixed values. Two more names, SSE and VECTORIZED_ALIGNMENT, are known and ignored: one kernel serves all."""

    OMEGA_A: float = 1e-40
    OMEGA_P: float = 1e-4
    OMEGA_C: float = 1e-40
    DETECT_SINGLETONS: bool = False
    USE_KMERS: bool = True
    KDIST_CUTOFF: float = 0.42
    MAX_CONSIST: int = 10
    MATCH: int = 5
    MISMATCH: int = -4
    GAP_PENALTY: int = -8
    BAND_SIZE: int = 16
    MAX_CLUST: int = 0
    MIN_FOLD: float = 1.0
    MIN_HAMMING: int = 1
    MIN_ABUNDANCE: int = 1
    USE_QUALS: bool = True
    HOMOPOLYMER_GAP_PENALTY: int | None = None
    GAPLESS: bool = True
    GREEDY: bool = True
    PSEUDO_PREVALENCE: int = 2
    PSEUDO_ABUNDANCE: float = float("inf")

    def with_(self, **changes) -> Options:
        """Changed options; unknown names warn and are left out, a value of another kind raises TypeError."""
        known = {f.name for f in fields(self)}
        good = {}
        for name, value in changes.items():
            if name in ("SSE", "VECTORIZED_ALIGNMENT"):
                continue
            if name not in known:
                warnings.warn(f"unknown option {name}", stacklevel=2)
                continue
            now = getattr(self, name)
            if name == "HOMOPOLYMER_GAP_PENALTY":
                if value is not None and not isinstance(value, int):
                    raise TypeError(name)
            elif isinstance(now, bool) != isinstance(value, bool) or not isinstance(value, (int, float)):
                raise TypeError(name)
            good[name] = value
        return replace(self, **good)
