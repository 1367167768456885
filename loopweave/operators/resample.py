"""Bootstrap and permutation versions of the scores.

Every replicate is a key in one table: the draws are integers computed per (row, replicate)
and looked up by a dense row index, whose values repeat about once per replicate, so the
lookup is even by construction. All replicates run in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopweave.operators import annotation as an
from loopweave.operators import evaluation as ev
from loopweave.plans.scan import dense_index
from loopweave.session import materialize

Draw = Callable[[Column, Column, Column], Column]


def hashed_draw(seed: int = 0) -> Draw:
    """Uniform draw of a row number below n, fixed by (row, replicate, seed)."""
    return lambda i, rep, n: F.pmod(F.xxhash64(i, rep, F.lit(seed)), n)


def _replicate(rows: DataFrame, reps: int, draw: Draw) -> DataFrame:
    """rep, j and the columns of the drawing row; ``rows`` carry i."""
    n = rows.agg(F.count("*")).scalar()
    return (
        rows.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint"))))
        .withColumn("j", draw(F.col("i"), F.col("rep"), n))
    )


def bootstrap_variance_explained(
    df: DataFrame,
    order: Sequence[str],
    signals: Sequence[str],
    reps: int,
    draw: Draw | None = None,
) -> DataFrame:
    """Residual bootstrap: rep, ve (mean over ``signals``, which share their draws).

    ``df`` has ``label``, the signals and unique columns ``order``. Each row's prediction takes
    the residual of the row drawn for it.
    """
    draw = draw or hashed_draw()
    means = df.groupBy("label").agg(*[F.avg(s).alias(f"_m{k}") for k, s in enumerate(signals)])
    fitted = df.join(means, "label").select(
        *order,
        F.array(*[F.col(f"_m{k}") for k in range(len(signals))]).alias("pred"),
        F.array(*[F.col(s) - F.col(f"_m{k}") for k, s in enumerate(signals)]).alias("rest"),
    )
    rows = dense_index(fitted, order, "i")
    drawn = rows.select(F.col("i").alias("j"), F.col("rest").alias("taken"))
    pairs = _replicate(rows.select("i", "pred"), reps, draw).join(drawn, "j")
    scores = []
    for k in range(len(signals)):
        taken = F.col("taken")[k]
        scores.append(
            1 - F.sum(taken * taken) / (F.count("*") * F.var_pop(F.col("pred")[k] + taken))
        )
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return pairs.groupBy("rep").agg((total / len(signals)).alias("ve"))


def bootstrap_over_expected(
    contacts: DataFrame,
    shares: DataFrame,
    order: Sequence[str],
    reps: int,
    draw: Draw | None = None,
    on_both_axes: bool = True,
) -> DataFrame:
    """rep, oe: the intra ratio of contacts drawn with replacement.

    ``contacts`` has label1, label2, weight and unique columns ``order``; unlabelled contacts
    are drawn as well and then carry no weight in the table.
    """
    rows = dense_index(contacts.select(*order, "label1", "label2", "weight"), order, "i")
    drawn = rows.select(F.col("i").alias("j"), "label1", "label2", "weight")
    pairs = _replicate(rows.select("i"), reps, draw or hashed_draw()).join(drawn, "j")
    table = ev.contingency(pairs, "weight", keys=["rep"])
    return ev.intra_over_expected(table, shares, keys=["rep"], on_both_axes=on_both_axes)


def normalized_agreement(
    regions: DataFrame,
    labels: DataFrame,
    arms: DataFrame,
    resolution: int,
    fractions: Sequence[float],
    compound: bool = True,
) -> DataFrame:
    """Region agreement over its mean for circularly shifted labels; one row.

    ``compound`` adds each shift to the ones before it, as a permutation of permutations does.
    """
    by_arm = materialize(an.arm_labels(labels, arms, resolution))
    lengths = arms.select(
        "chrom", "arm", F.ceil(F.col("size") / resolution).cast("bigint").alias("_len")
    )
    shifts = []
    total = F.lit(0).cast("bigint")
    for rep, f in enumerate([0.0, *fractions]):
        own = F.floor(F.col("_len") * F.lit(float(f))).cast("bigint")
        total = total + own if compound else own
        shifts.append(F.struct(F.lit(rep).cast("bigint").alias("rep"), total.alias("shift")))
    versions = (
        by_arm.join(lengths, ["chrom", "arm"])
        .filter(F.col("arm_pos") < F.col("_len"))
        .withColumn("_v", F.explode(F.array(*shifts)))
        .select(
            F.col("_v.rep").alias("rep"), "chrom", "arm",
            ((F.col("arm_pos") + F.col("_v.shift")) % F.col("_len")).alias("arm_pos"), "label",
        )
    )
    scores = ev.region_agreement(
        regions, versions, arms, resolution, reps=["rep"], versions=range(len(fractions) + 1)
    )
    raw = F.max(F.when(F.col("rep") == 0, F.col("agreement")))
    shifted = F.avg(F.when(F.col("rep") > 0, F.col("agreement")))
    return scores.agg(raw.alias("raw"), shifted.alias("shifted")).select(
        (F.col("raw") / F.col("shifted")).alias("normalized")
    )


def bootstrap_stats(scores: dict[str, DataFrame]) -> DataFrame:
    """One row per replicate with a column for every named (rep, score) table."""
    out = None
    for name, df in scores.items():
        value = next(c for c in df.columns if c != "rep")
        named = df.select("rep", F.col(value).alias(name))
        out = named if out is None else out.join(named, "rep")
    return out
