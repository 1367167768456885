"""Binning of piecewise-constant tracks and the bin x track feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def covered_bins(df: DataFrame, resolution: int, name: str = "pos") -> DataFrame:
    """One row per bin an interval covers, with the number of covered bases ``covered``.

    Empty intervals cover nothing and are dropped.
    """
    first = F.expr(f"start div {resolution}")
    last = F.expr(f"(`end` - 1) div {resolution}")
    return (
        df.filter(F.col("end") > F.col("start"))
        .withColumn(name, F.explode(F.sequence(first, last)))
        .withColumn(
            "covered",
            F.least(F.col("end"), (F.col(name) + 1) * resolution)
            - F.greatest(F.col("start"), F.col(name) * resolution),
        )
    )


def overlap_sums(df: DataFrame, resolution: int, keys: Sequence[str] = ()) -> DataFrame:
    """Per key, chrom and bin the covered bases and the value integral over them."""
    return (
        covered_bins(df, resolution)
        .groupBy("chrom", *keys, "pos")
        .agg(
            F.sum(F.col("value") * F.col("covered")).alias("weighted"),
            F.sum("covered").alias("covered"),
        )
    )


def bin_track(df: DataFrame, resolution: int, keys: Sequence[str] = ()) -> DataFrame:
    """Length-weighted mean of the covered bases of each bin: chrom, keys, pos, value."""
    return overlap_sums(df, resolution, keys).select(
        "chrom", *keys, "pos", (F.col("weighted") / F.col("covered")).alias("value")
    )


def to_intervals(binned: DataFrame, resolution: int, virtual: bool = False) -> DataFrame:
    """Bin numbers as half-open intervals, in bins (``virtual``) or in bases."""
    step = 1 if virtual else resolution
    start = F.col("pos") * step
    return binned.withColumn("start", start).withColumn("end", start + step).drop("pos")


def track_matrix(
    binned: DataFrame,
    names: Sequence[str],
    on: Sequence[str] = ("chrom", "pos"),
    asinh: bool = False,
) -> DataFrame:
    """Inner join of all tracks on ``on``: bins lacking any named track are left out.

    One conditional aggregation replaces a chain of joins, so the tracks shuffle once.
    """
    def cell(name: str) -> Column:
        value = F.max(F.when(F.col("track") == name, F.col("value")))
        return (F.asinh(value) if asinh else value).alias(name)

    wide = binned.filter(F.col("track").isin(list(names))).groupBy(*on).agg(*[cell(n) for n in names])
    return wide.na.drop(subset=list(names))


def feature_arrays(wide: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return wide.select(*keep, F.array(*[F.col(n).cast("double") for n in names]).alias("features"))


def append_vectors(left: DataFrame, right: DataFrame, on: str = "idx") -> DataFrame:
    """Concatenate two feature tables by key instead of by row order."""
    return left.join(right.withColumnRenamed("features", "_more"), on).select(
        *[c for c in left.columns if c != "features"],
        F.concat("features", "_more").alias("features"),
    )
