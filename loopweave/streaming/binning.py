"""Track binning over a stream of intervals: the same sums, kept as streaming state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.operators.tracks import bin_track


def bin_stream(
    intervals: DataFrame,
    resolution: int,
    keys: Sequence[str] = ("track",),
    event_time: str | None = None,
    span: str = "1 hour",
    late: str = "10 minutes",
) -> DataFrame:
    """Binned means of a streaming DataFrame(chrom, keys, start, end, value).

    The two sums per bin are combined before the shuffle and merged into the state, so output
    mode ``update`` emits each bin whenever intervals touch it. With an ``event_time`` column the
    means are per window of ``span`` (column ``window``), rows more than ``late`` behind are dropped
    and the state of closed windows is let go; without one the state keeps every bin.
    """
    if event_time is None:
        return bin_track(intervals, resolution, keys)
    timed = intervals.withWatermark(event_time, late).withColumn("window", F.window(event_time, span))
    return bin_track(timed, resolution, [*keys, "window"])
