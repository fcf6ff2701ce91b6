"""Uniform cubic B-spline basis (P-splines, Eilers & Marx 1996).

A feature with range [lo, hi] gets ``n_basis`` basis functions over
``n_basis - 3`` equal intervals. A value in interval j has exactly four
non-zero weights, at basis indices j..j+3, given in closed form by the
fractional position t inside the interval. The Gram pass uses the numpy kernel,
which fills whole design rows; scoring and the effect curve use the Column
expressions, which touch the four weights alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = 3


def _cubic_weights(t):
    t2, t3, r = t * t, t * t * t, 1 - t
    return (r * r * r / 6.0, (3 * t3 - 6 * t2 + 4) / 6.0,
            (-3 * t3 + 3 * t2 + 3 * t + 1) / 6.0, t3 / 6.0)


def position_np(x: np.ndarray, lo: float, hi: float, n_basis: int):
    k = n_basis - ORDER
    span = hi - lo if hi > lo else 1.0
    u = np.clip((x - lo) / span, 0.0, 1.0) * k
    j = np.minimum(np.floor(u), k - 1).astype(np.int64)
    return j, u - j


def basis_np(x: np.ndarray, lo: float, hi: float, n_basis: int) -> np.ndarray:
    """Dense (len(x), n_basis) basis matrix."""
    j, t = position_np(np.asarray(x, dtype=float), lo, hi, n_basis)
    out = np.zeros((len(j), n_basis))
    rows = np.arange(len(j))
    for i, w in enumerate(_cubic_weights(t)):
        out[rows, j + i] = w
    return out


def second_difference_penalty(n_basis: int) -> np.ndarray:
    d = np.diff(np.eye(n_basis), n=2, axis=0)
    return d.T @ d


def place(x: Column, lo: Column, hi: Column, n_basis: int) -> tuple[Column, Column]:
    """(interval, position in it) of a value; values beyond the range count as
    its ends, and a range without extent has one place."""
    k = n_basis - ORDER
    span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / span)) * F.lit(float(k))
    j = F.least(F.floor(u), F.lit(k - 1)).cast("int")
    return j, u - j


def spline_value(coefs: Column, first: int, j: Column, t: Column) -> Column:
    """Value at place (j, t) of the spline whose coefficients start at index
    ``first`` of the array ``coefs``."""
    return sum(w * F.get(coefs, j + (first + i)) for i, w in enumerate(_cubic_weights(t)))


def spline_variance(blocks: Column, j: Column, t: Column) -> Column:
    """The same quadratic form for a covariance matrix given by rows."""
    w = _cubic_weights(t)
    return sum(w[a] * w[b] * F.get(F.get(blocks, j + a), j + b) for a in range(4) for b in range(4))
