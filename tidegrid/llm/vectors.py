"""Vectors in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def vectors(column: pa.ListArray) -> list[np.ndarray | None]:
    """Each row's vector in double precision; None for a null, empty, zero or not wholly finite one."""
    out = []
    for x in column:
        v = None
        if x.is_valid and len(x.values):
            v = x.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            v = v if np.isfinite(v).all() and v.any() else None
        out.append(v)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def planes(dim: int, n: int, seed: int) -> np.ndarray:
    """``n`` random directions; the same in every task."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))
