"""Windows cut to whole frames and the frame a point falls into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.plans.scan import dense_index, running_offset


def frame_windows(df: DataFrame, resolution: int) -> DataFrame:
    """Drop windows shorter than a frame, trim the rest, number windows and frames.

    ``df(line, chrom, start, end)``; ``line`` is the unique input order. Nothing is written
    back to the input.
    """
    length = F.col("end") - F.col("start")
    kept = df.filter(length >= resolution).withColumn("end", F.col("end") - length % resolution)
    sized = kept.withColumn("_n", F.expr(f"(`end` - start) div {resolution}"))
    numbered = dense_index(sized, ["line"], "window_index")
    return running_offset(numbered, "window_index", "_n", "frame_offset").drop("_n")


def locate(points: DataFrame, windows: DataFrame, resolution: int, bucket: int = 1 << 14) -> DataFrame:
    """window_index and frame_index of each distinct point; -1 unless exactly one window holds it.

    Both sides are cut to buckets of ``bucket`` bases, which turns the range condition into an
    equality; a point lies in one bucket, so no hit is found twice.
    """
    spread = windows.withColumn(
        "_b", F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"(`end` - 1) div {bucket}")))
    ).select("chrom", "_b", F.col("start").alias("_s"), F.col("end").alias("_e"), "window_index", "frame_offset")
    hits = (
        points.select("chrom", "pos").distinct()
        .withColumn("_b", F.expr(f"pos div {bucket}"))
        .join(spread, ["chrom", "_b"], "left")
    )
    inside = (F.col("pos") >= F.col("_s")) & (F.col("pos") < F.col("_e"))
    frame = F.col("frame_offset") + F.floor((F.col("pos") - F.col("_s")) / resolution)
    only = F.col("_n") == 1
    return (
        hits.groupBy("chrom", "pos")
        .agg(
            F.count(F.when(inside, 1)).alias("_n"),
            F.max(F.when(inside, F.col("window_index"))).alias("_w"),
            F.max(F.when(inside, frame)).alias("_f"),
        )
        .select(
            "chrom",
            "pos",
            F.when(only, F.col("_w")).otherwise(-1).cast("bigint").alias("window_index"),
            F.when(only, F.col("_f")).otherwise(-1).cast("bigint").alias("frame_index"),
        )
    )
