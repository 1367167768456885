"""Tail probabilities Spark has no built-in for, as vectorised pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: From this a + b on the uniform expansion is used; its error there is below 1e-8, and falls as 1 / (a + b).
LARGE = 1e6


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erfc, x), dtype=float, count=len(x))


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x), dtype=float, count=len(x))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function of arrays."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    out = np.full(a.shape, np.nan)
    out[x <= 0.0], out[x >= 1.0] = 0.0, 1.0
    inside = (x > 0.0) & (x < 1.0)
    # A tail with a tiny a or b is far from normal; its fraction converges in few terms.
    wide = inside & (a + b >= LARGE) & (np.minimum(a, b) >= 1e4)
    out[wide] = _expansion(a[wide], b[wide], x[wide])
    rest = inside & ~wide
    turned = rest & (x > (a + 1.0) / (a + b + 2.0))
    plain = rest & ~turned
    out[plain] = _fraction(a[plain], b[plain], x[plain])
    out[turned] = 1.0 - _fraction(b[turned], a[turned], 1.0 - x[turned])
    return out


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction (modified Lentz), every element until it has converged."""
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) if len(a) else a
    tiny = 1e-300

    def away(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) > tiny, v, tiny)

    c, d = np.ones_like(a), 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    value, open_ = d.copy(), np.arange(len(a))
    m = 0
    while len(open_):
        m += 1
        p, q, y = a[open_], b[open_], x[open_]
        for top in (
            m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d[open_] = 1.0 / away(1.0 + top * d[open_])
            c[open_] = away(1.0 + top / c[open_])
            step = c[open_] * d[open_]
            value[open_] *= step
        open_ = open_[np.abs(step - 1.0) >= 4e-16]
    return front * value / a


def _expansion(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Uniform normal expansion for large a + b with its first correction (Temme)."""
    r = a + b
    centre = a / r
    gap = x - centre
    # -eta**2 / 2 = centre ln(x / centre) + (1 - centre) ln((1 - x) / (1 - centre)), free of cancellation
    u, v = gap / centre, -gap / (1.0 - centre)
    half = -(centre * _log1p_rest(u) + (1.0 - centre) * _log1p_rest(v))
    eta = np.sign(gap) * np.sqrt(np.maximum(2.0 * half, 0.0))
    spread = np.sqrt(centre * (1.0 - centre))
    near = np.abs(gap) < 1e-5 * spread * spread
    safe = np.where(near, 1.0, gap)
    first = np.where(near, (1.0 - 2.0 * centre) / (3.0 * spread), 1.0 / np.where(near, 1.0, eta) - spread / safe)
    return 0.5 * _erfc(-eta * np.sqrt(r / 2.0)) + np.exp(-0.5 * r * eta * eta) / np.sqrt(2.0 * np.pi * r) * first if len(a) else a


def _log1p_rest(u: np.ndarray) -> np.ndarray:
    """ln(1 + u) - u without cancellation near 0."""
    small = np.abs(u) < 1e-2
    series = sum(((-1) ** (k + 1)) * u**k / k for k in range(2, 10))
    return np.where(small, series, np.log1p(np.where(small, 0.0, u)) - np.where(small, 0.0, u))


@F.pandas_udf(DoubleType())
def _binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    k, n, p = (v.to_numpy(dtype=float) for v in (k, n, p))
    out = np.full(len(k), np.nan)
    known = ~(np.isnan(k) | np.isnan(n) | np.isnan(p))
    out[known & (k <= 0)] = 1.0
    out[known & (k > n)] = 0.0
    at = known & (k > 0) & (k <= n)
    out[at] = incomplete_beta(k[at], n[at] - k[at] + 1.0, p[at])
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def _normal_tail(z: pd.Series) -> pd.Series:
    return pd.Series(0.5 * _erfc(z.to_numpy(dtype=float) / math.sqrt(2)) if len(z) else np.zeros(0))


def binomial_upper_tail(k: Column | str, n: Column | str, p: Column | str) -> Column:
    """P(X >= k) for X ~ Binomial(n, p)."""
    return _binomial_tail(k, n, p)


def normal_upper_tail(z: Column | str) -> Column:
    return _normal_tail(z)
