"""Multivariate normal densities with parameters small enough to ship to every task."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def whiten(cov: np.ndarray) -> tuple[np.ndarray, float, int]:
    """(W, log pseudo-determinant, rank) with W W' the pseudo-inverse; singular cov is allowed."""
    values, vectors = np.linalg.eigh(np.atleast_2d(cov))
    cut = 1e6 * np.finfo(float).eps * np.max(np.abs(values))
    keep = values > cut
    return vectors[:, keep] / np.sqrt(values[keep]), float(np.log(values[keep]).sum()), int(keep.sum())


def log_densities(x: np.ndarray, params: Sequence[tuple[np.ndarray, np.ndarray] | None]) -> np.ndarray:
    """n x K log densities; a component without parameters scores 0 everywhere."""
    out = np.zeros((len(x), len(params)))
    for k, p in enumerate(params):
        if p is None:
            continue
        w, logdet, rank = whiten(p[1])
        z = (x - p[0]) @ w
        out[:, k] = -0.5 * (rank * np.log(2 * np.pi) + logdet + (z * z).sum(axis=1))
    return out


def normal_log_density(
    features: Column | str, params: Sequence[tuple[np.ndarray, np.ndarray] | None]
) -> Column:
    """array<double> of the log density of every component."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def density(batch: pd.Series) -> pd.Series:
        if len(batch) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(log_densities(np.stack(batch.to_numpy()), params)))

    return density(features)
