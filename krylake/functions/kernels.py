"""Kernels of pairs of points: as Columns for SQL, and over blocks in numpy."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sqdist(a: Column, b: Column) -> Column:
    """Squared distance of two arrays, by differences: nothing cancels."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def rbf(d2: Column, gamma: Column | float) -> Column:
    return F.exp(-gamma * F.greatest(d2, F.lit(0.0))) if isinstance(gamma, Column) else F.exp(F.lit(-gamma) * F.greatest(d2, F.lit(0.0)))


def block_sqdist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) squared distances by one product of matrices, cut off at zero."""
    d = a @ (-2.0 * b.T)
    d += (a * a).sum(1)[:, None]
    d += (b * b).sum(1)[None]
    return np.maximum(d, 0.0, out=d)


def rbf_block(gamma: float) -> Callable:
    def block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = block_sqdist(a, b)
        d *= -gamma
        return np.exp(d, out=d)

    block.gamma = gamma
    return block


def bem_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 / (1 + distance). Where squares nearly cancel, their root isn't accurate enough: those pairs are done again by differences."""
    d = block_sqdist(a, b)
    i, j = np.nonzero(d < 1e-6 * ((a * a).sum(1).max(initial=0.0) + (b * b).sum(1).max(initial=0.0)))
    for k in range(0, len(i), 1 << 14):
        at = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
        d[at] = ((a[at[0]] - b[at[1]]) ** 2).sum(axis=1)
    np.sqrt(d, out=d)
    d += 1.0
    return np.divide(1.0, d, out=d)


def estimate_gamma(points: DataFrame, sample: int = 512) -> float:
    """1 / (2 * mean squared distance) over the first `sample` points by id, each with itself too; 1 where they coincide."""
    p = np.array([r["p"] for r in points.orderBy("id").limit(sample).select("p").collect()])
    mean = float(block_sqdist(p, p).mean()) if len(p) else 0.0
    return 1.0 / (2.0 * mean) if mean > 1e-30 else 1.0
