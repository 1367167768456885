"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.session import materialize

PART_ROWS = 200_000


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as few parts as its rows need, so that small rounds do not leave many tiny files."""
    return df.coalesce(rows // PART_ROWS + 1)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """key, comp: the smallest key reachable from every key that occurs in ``edges(a, b)``.

    A hub's neighbours are never gathered: every step is a minimum per key and a join with it.
    Empty input gives no rows.
    """
    now = materialize(_distinct(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    seen = _state(now)
    now = _small(now, seen[0])
    while seen[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _distinct(
            both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        down = materialize(_small(large, 2 * seen[0]))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(_small(_distinct(small.union(least.select("a", F.col("m").alias("b")))), 2 * seen[0]))
        state = _state(now)
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("key"), F.col("b").alias("comp")).union(
        now.select(F.col("b").alias("key"), F.col("b").alias("comp"))
    ).distinct()
