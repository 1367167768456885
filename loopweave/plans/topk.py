"""Grouped top-k that splits hot groups before ranking them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int | str,
    tie: Sequence[str],
    salts: int | None = None,
) -> DataFrame:
    """Rows ranked first by ``order`` then by the unique columns ``tie``, ``k`` per key.

    ``k`` is a number or the name of a column constant per key. Each key is first cut down
    inside ``salts`` hash slices (as many as the session has shuffle partitions, if not given), so
    the final ranking of a key sees at most salts * k rows.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = F.lit(k) if isinstance(k, int) else F.col(k)
    ranking = [*order, *[F.col(c).asc() for c in tie]]
    slices = Window.partitionBy(*keys, "_salt").orderBy(*ranking)
    whole = Window.partitionBy(*keys).orderBy(*ranking)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*tie), F.lit(salts)))
        .withColumn("_rn", F.row_number().over(slices))
        .filter(F.col("_rn") <= bound)
        .drop("_rn", "_salt")
        .withColumn("_rn", F.row_number().over(whole))
        .filter(F.col("_rn") <= bound)
        .drop("_rn")
    )
