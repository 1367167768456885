"""Order-dependent plans that never put a whole chromosome into one task.

Positions are integers and unique per key, so a block of ``block`` consecutive positions
holds at most ``block`` rows however skewed the keys are. Every scan below works inside
such blocks and then combines one or two summary rows per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopweave.session import materialize

BLOCK = 1 << 16


def block_of(pos: Column, block: int = BLOCK) -> Column:
    return F.floor(pos / F.lit(block)).cast("bigint")


def islands(
    df: DataFrame,
    keys: Sequence[str],
    pos: str = "pos",
    label: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Maximal runs of consecutive positions (and equal labels): keys, start, stop, label.

    ``stop`` is exclusive. A run is cut at block edges first; only the pieces that touch an
    edge, at most two per block, go through the per-key stitching window. The pieces, which
    are read twice, are checkpointed.
    """
    rows = df.select(
        *keys,
        F.col(pos).cast("bigint").alias("_p"),
        (F.col(label) if label else F.lit(0)).alias("label"),
        block_of(F.col(pos), block).alias("_b"),
    )
    in_block = Window.partitionBy(*keys, "_b").orderBy("_p")
    continues = (F.lag("_p").over(in_block) == F.col("_p") - 1) & F.lag("label").over(
        in_block
    ).eqNullSafe(F.col("label"))
    pieces = materialize(
        rows.withColumn("_s", F.when(continues, 0).otherwise(1))
        .withColumn("_r", F.sum("_s").over(in_block))
        .groupBy(*keys, "_b", "_r")
        .agg(
            F.min("_p").alias("start"),
            (F.max("_p") + 1).alias("stop"),
            F.min("label").alias("label"),
        )
        .drop("_b", "_r")
    )
    touches = ((F.col("start") % block) == 0) | ((F.col("stop") % block) == 0)
    by_key = Window.partitionBy(*keys).orderBy("start")
    joins_previous = (F.lag("stop").over(by_key) == F.col("start")) & F.lag("label").over(
        by_key
    ).eqNullSafe(F.col("label"))
    stitched = (
        pieces.filter(touches)
        .withColumn("_s", F.when(joins_previous, 0).otherwise(1))
        .withColumn("_r", F.sum("_s").over(by_key))
        .groupBy(*keys, "_r")
        .agg(
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            F.min("label").alias("label"),
        )
        .drop("_r")
    )
    out = pieces.filter(~touches).unionByName(stitched)
    return out if label else out.drop("label")


def position_index(
    df: DataFrame, rank: str, pos: str = "pos", name: str = "idx", block: int = BLOCK
) -> DataFrame:
    """Dense 0-based index over (rank, pos); (rank, pos) is unique.

    Row numbers are taken inside blocks and shifted by the running count of earlier blocks,
    so the only unpartitioned window runs over one row per block. The rows are checkpointed,
    since counting and numbering both read them.
    """
    rows = materialize(df.withColumn("_b", block_of(F.col(pos), block)))
    before = Window.orderBy(rank, "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(rank, "_b")
        .agg(F.count("*").alias("_n"))
        .select(rank, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    inside = F.row_number().over(Window.partitionBy(rank, "_b").orderBy(pos))
    return (
        rows.withColumn("_k", inside)
        .join(offsets, [rank, "_b"])
        .withColumn(name, (F.col("_off") + F.col("_k") - 1).cast("bigint"))
        .drop("_b", "_k", "_off")
    )


def dense_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """Dense 0-based index by the unique columns ``order`` for any table.

    Range partitioning on unique keys splits evenly whatever one column repeats. The sorted
    rows are checkpointed so that counts and row offsets always describe the same layout;
    the offsets broadcast is one row per partition.
    """
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    part = F.shiftright("_m", 33)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_pid"))
        .agg(F.count("*").alias("_n"))
        .select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    row = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_pid", part)
        .join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_off") + row).cast("bigint"))
        .drop("_m", "_pid", "_off")
    )


def nearest_valid(
    queries: DataFrame,
    bins: DataFrame,
    key: str = "chrom",
    pos: str = "pos",
    idx: str = "idx",
    block: int = BLOCK,
) -> DataFrame:
    """For each distinct (key, pos) the first bin index at or after and the last at or before.

    Returns key, pos, next_idx (NULL if none), last_idx (NULL if none). ``idx`` grows with
    ``pos`` inside a key. Repeated query positions collapse before anything is ordered. The
    spine is checkpointed: its rows and its block summaries would otherwise each compute ``bins``.
    """
    spine = materialize(
        queries.select(key, pos, F.lit(1).alias("_q"), F.lit(None).cast("bigint").alias("_i"))
        .unionByName(bins.select(key, pos, F.lit(0).alias("_q"), F.col(idx).alias("_i")))
        .groupBy(key, pos)
        .agg(F.max("_q").alias("_q"), F.max("_i").alias("_i"))
        .withColumn("_b", block_of(F.col(pos), block))
    )
    # Looking ahead is looking back in descending order: a frame that ends at the last row
    # would be evaluated anew for every row.
    so_far = (Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(key, "_b").orderBy(F.desc(pos)).rowsBetween(*so_far)
    behind = Window.partitionBy(key, "_b").orderBy(pos).rowsBetween(*so_far)
    local = (
        spine.withColumn("_next", F.last("_i", ignorenulls=True).over(ahead))
        .withColumn("_last", F.last("_i", ignorenulls=True).over(behind))
        .filter("_q = 1")
    )
    earlier = (Window.unboundedPreceding, -1)
    carried = spine.groupBy(key, "_b").agg(
        F.min("_i").alias("_lo"), F.max("_i").alias("_hi")
    ).select(
        key,
        "_b",
        F.last("_lo", ignorenulls=True)
        .over(Window.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(*earlier))
        .alias("_after"),
        F.last("_hi", ignorenulls=True)
        .over(Window.partitionBy(key).orderBy("_b").rowsBetween(*earlier))
        .alias("_before"),
    )
    return local.join(carried, [key, "_b"]).select(
        key,
        pos,
        F.coalesce("_next", "_after").alias("next_idx"),
        F.coalesce("_last", "_before").alias("last_idx"),
    )


def running_offset(
    df: DataFrame, order: str, size: str, name: str = "offset", block: int = BLOCK
) -> DataFrame:
    """Sum of ``size`` over all rows with a smaller unique integer ``order``."""
    rows = df.withColumn("_b", block_of(F.col(order), block))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        rows.groupBy("_b")
        .agg(F.sum(size).alias("_n"))
        .select("_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    )
    inside = (
        Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(base, "_b")
        .withColumn(name, (F.col("_off") + F.col("_in")).cast("bigint"))
        .drop("_b", "_in", "_off")
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, value: str, block: int = BLOCK
) -> DataFrame:
    """Replace NULLs of ``value`` by the last non-NULL at a smaller unique integer ``order``."""
    rows = df.withColumn("_b", block_of(F.col(order), block))
    upto = (
        Window.partitionBy(*keys, "_b")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        rows.groupBy(*keys, "_b")
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_v"))
        .select(*keys, "_b", F.last("_v", ignorenulls=True).over(earlier).alias("_carry"))
    )
    return (
        rows.withColumn("_here", F.last(value, ignorenulls=True).over(upto))
        .join(carried, [*keys, "_b"])
        .withColumn(value, F.coalesce("_here", "_carry"))
        .drop("_b", "_here", "_carry")
    )
