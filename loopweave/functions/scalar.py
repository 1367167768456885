"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_of(pos: Column, resolution: int, up: bool = False) -> Column:
    """Bin number of a base position, rounded down or ``up``."""
    return (F.ceil if up else F.floor)(pos / F.lit(resolution)).cast("bigint")


def ceil_div(a: Column, b: Column) -> Column:
    """Integer division rounding up."""
    return -F.floor(-a / b)


def is_autosome(chrom: Column) -> Column:
    return chrom.rlike("^chr([1-9]|1[0-9]|2[0-2])$")


def log_transform(x: Column, pseudocount: float = 1e-100) -> Column:
    return F.log(x + F.lit(pseudocount))


def round_significant(x: Column, digits: int = 2) -> Column:
    """Rounded to ``digits`` significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def saturated_sigmoid(x: Column, bound: float = 6.0) -> Column:
    """1 / (1 + exp(-x)), exactly 0 or 1 beyond +-bound."""
    return F.when(x > bound, 1.0).when(x < -bound, 0.0).otherwise(1 / (1 + F.exp(-x)))


def name_has_suffix(path: Column, suffix: str) -> Column:
    """Whether the last path element carries the extension."""
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), -1) == suffix


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit_vector(v: Column) -> Column:
    """v / |v|; a zero vector gives NaN elements."""
    norm = vector_norm(v)
    return F.transform(v, lambda x: F.when(norm == 0, F.lit(float("nan"))).otherwise(x.cast("double") / norm))
