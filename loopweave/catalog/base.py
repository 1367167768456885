"""Shared pieces of the query definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounded double whose zero carries no sign, as the SQL side rounds."""
    return F.round(col, digits) + F.lit(0.0)


def longs(df: DataFrame, *names: str) -> DataFrame:
    """Counts and positions as bigint, the SQL side's integer type."""
    for name in names:
        df = df.withColumn(name, F.col(name).cast("bigint"))
    return df


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    for name in names:
        df = df.withColumn(name, r(name, digits))
    return df
