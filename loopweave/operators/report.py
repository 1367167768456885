"""One-row reports that bundle the scores of an annotation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.operators import evaluation as ev
from loopweave.session import materialize


def brief_stats(
    segs: DataFrame,
    labels: DataFrame,
    genes: DataFrame,
    timing: DataFrame,
    resolution: int,
    phases: Sequence[str],
) -> DataFrame:
    """avg_length, num_domains, ge_ve, rt_score1, rt_score2, ent."""
    labels, segs = materialize(labels), materialize(segs)
    scores = materialize(ev.timing_scores(timing, labels, resolution, phases))
    return segs.agg(
        F.avg(F.col("end") - F.col("start")).alias("avg_length"), F.count("*").alias("num_domains")
    ).select(
        "*",
        ev.expression_ve(genes, labels, resolution).scalar().alias("ge_ve"),
        scores.select("ve").scalar().alias("rt_score1"),
        scores.select("ari").scalar().alias("rt_score2"),
        ev.entropy(ev.coverage(segs)).scalar().alias("ent"),
    )


def stats(
    segs: DataFrame,
    labels: DataFrame,
    genes: DataFrame,
    timing: DataFrame,
    resolution: int,
    phases: Sequence[str],
    paired: Mapping[str, DataFrame],
) -> DataFrame:
    """``brief_stats`` and the observed/expected intra ratio of every set of paired regions."""
    labels, segs = materialize(labels), materialize(segs)
    shares = ev.coverage(segs)
    ratios = []
    for name, pairs in paired.items():
        table = ev.contingency(ev.paired_labels(pairs, labels, resolution), "weight")
        ratios.append(ev.intra_over_expected(table, shares).scalar().alias(name))
    return brief_stats(segs, labels, genes, timing, resolution, phases).select("*", *ratios)
