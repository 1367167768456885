"""Annotations: run-length segments, per-bin labels, region labels, arms, permutations.

Per-bin form: chrom, pos, label with one row per labelled bin; an unlabelled bin has no row.
Segment form: chrom, start, end, label in bases, half open.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopweave.operators.tracks import covered_bins
from loopweave.plans.scan import BLOCK, block_of, islands, nearest_valid, position_index
from loopweave.session import materialize


def heaviest_label(
    df: DataFrame, keys: Sequence[str], label: str, tie: Column, weight: str = "weight"
) -> DataFrame:
    """One row per key: the row of largest ``weight``, the smallest ``tie`` among equals."""
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(label, weight), F.struct(-F.col(weight), tie)).alias("_best")
    ).select(*keys, f"_best.{label}", f"_best.{weight}")


def segments(labels: DataFrame, resolution: int, block: int = BLOCK) -> DataFrame:
    """Run-length encode per-bin labels; gaps, chromosome ends and label changes split."""
    runs = islands(labels, ["chrom"], "pos", "label", block)
    return runs.select(
        "chrom",
        (F.col("start") * resolution).alias("start"),
        (F.col("stop") * resolution).alias("end"),
        "label",
    )


def chunks(bins: DataFrame, block: int = BLOCK) -> DataFrame:
    """Runs of consecutive valid bins: chrom, start, stop (bins), n."""
    return islands(bins, ["chrom"], "pos", block=block).withColumn(
        "n", F.col("stop") - F.col("start")
    )


def melt(segs: DataFrame, resolution: int) -> DataFrame:
    """One row per bin of [start/res, end/res); both bounds round down."""
    first = F.expr(f"start div {resolution}")
    stop = F.expr(f"`end` div {resolution}")
    return segs.filter(stop > first).select(
        "chrom",
        F.explode(F.sequence(first, stop - 1)).alias("pos"),
        *[c for c in segs.columns if c not in ("chrom", "start", "end")],
    )


def labels_from_segments(segs: DataFrame, resolution: int, order: str | None = None) -> DataFrame:
    """Per-bin labels of a segment list; later rows by ``order`` overwrite, NA is skipped."""
    per_bin = melt(segs.filter(F.col("label").isNotNull() & (F.col("label") != "NA")), resolution)
    if order is None:
        return per_bin.select("chrom", "pos", "label")
    return per_bin.groupBy("chrom", "pos").agg(F.max_by("label", order).alias("label"))


def labels_by_valid_bin(
    segs: DataFrame,
    bins: DataFrame,
    resolution: int,
    order: str,
    virtual: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Labels by bin index: a segment fills the valid bins from the first one at or after its
    start to the last one at or before its end. ``virtual`` coordinates are bins already, and
    there the last bin itself stays out. Later rows by ``order`` overwrite.
    """
    step = 1 if virtual else resolution
    segs = segs.withColumn("_s", F.expr(f"start div {step}")).withColumn(
        "_e", F.expr(f"`end` div {step}")
    )
    points = segs.select("chrom", F.explode(F.array("_s", "_e")).alias("pos"))
    near = nearest_valid(points, bins, block=block)
    lo = near.select("chrom", F.col("pos").alias("_s"), F.col("next_idx").alias("_lo"))
    hi = near.select("chrom", F.col("pos").alias("_e"), F.col("last_idx").alias("_hi"))
    last = F.col("_hi") - 1 if virtual else F.col("_hi")
    return (
        segs.join(lo, ["chrom", "_s"])
        .join(hi, ["chrom", "_e"])
        .withColumn("_last", last)
        .filter(F.col("_lo") <= F.col("_last"))
        .select(F.explode(F.sequence("_lo", "_last")).alias("idx"), "label", order)
        .groupBy("idx")
        .agg(F.max_by("label", order).alias("label"))
    )


def align(labels: DataFrame, sizes: DataFrame, resolution: int) -> DataFrame:
    """Every bin of every chromosome with its label, NULL where there is none."""
    spine = sizes.select(
        "chrom",
        F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size + {resolution} - 1) div {resolution} - 1"))
        ).alias("pos"),
    )
    return spine.join(labels, ["chrom", "pos"], "left")


def region_weights(
    regions: DataFrame, labels: DataFrame, resolution: int, key: str = "region_id"
) -> DataFrame:
    """Overlap in bases of each region with each label: key, label (NULL = none), weight, first.

    ``first`` is the lowest bin the label was met in.
    """
    return (
        covered_bins(regions.select(key, "chrom", "start", "end"), resolution)
        .join(labels, ["chrom", "pos"], "left")
        .groupBy(key, "label")
        .agg(F.sum("covered").alias("weight"), F.min("pos").alias("first"))
    )


def region_label(
    regions: DataFrame, labels: DataFrame, resolution: int, key: str = "region_id"
) -> DataFrame:
    """The label covering most of each region; no label competes; ties go to the lowest bin."""
    return heaviest_label(
        region_weights(regions, labels, resolution, key), [key], "label", F.col("first")
    )


#: Bins of a row of ``label_rows``; the row holds as many again of the following one.
ROW_BINS = 32


def label_rows(labels: DataFrame, by: Sequence[str] = (), bins: int = ROW_BINS) -> DataFrame:
    """chrom, _row, _labels and ``by``: the labels of bins [_row * bins, (_row + 2) * bins) as one array.

    An interval of up to ``bins`` + 1 bins lies whole in the row of its first bin, so that its labels
    are counted where it is joined and no row per covered bin is shuffled.
    """
    here = block_of(F.col("pos"), bins)
    at = (F.col("pos") - F.col("_row") * bins).cast("int")
    spread = labels.select("chrom", "pos", "label", *by, F.explode(F.array(here, here - 1)).alias("_row"))
    met = spread.groupBy("chrom", "_row", *by).agg(
        F.map_from_entries(F.collect_list(F.struct(at.alias("at"), "label"))).alias("_met")
    )
    dense = F.transform(F.sequence(F.lit(0), F.lit(2 * bins - 1)), lambda i: F.col("_met")[i])
    return met.select("chrom", "_row", *by, dense.alias("_labels"))


def row_fits(resolution: int, which: str = "", bins: int = ROW_BINS) -> Column:
    """Whether the interval start/end<which> lies whole in one row of ``label_rows``; one without bases does."""
    first, last = F.expr(f"start{which} div {resolution}"), F.expr(f"(`end{which}` - 1) div {resolution}")
    return F.coalesce((F.col(f"end{which}") <= F.col(f"start{which}")) | (last - first <= bins), F.lit(True))


def row_of(resolution: int, which: str = "", bins: int = ROW_BINS) -> Column:
    return block_of(F.expr(f"start{which} div {resolution}"), bins)


def labels_inside(resolution: int, which: str = "", bins: int = ROW_BINS, found: Column | None = None) -> Column:
    """The labels (NULL = none) of the bins of a fitting interval joined with its row of labels."""
    first, last = F.expr(f"start{which} div {resolution}"), F.expr(f"(`end{which}` - 1) div {resolution}")
    n = (last - first + 1).cast("int")
    own = F.slice(found if found is not None else F.col("_labels"), F.pmod(first, F.lit(bins)).cast("int") + 1, n)
    none = F.array_repeat(F.lit(None), n)
    return F.when(F.col(f"end{which}") > F.col(f"start{which}"), F.coalesce(own, none))


def heaviest_inside(resolution: int, which: str = "", inside: str = "_inside") -> Column:
    """label, weight of the label covering most bases of an interval; ties go to the lowest bin."""
    start, end = F.col(f"start{which}"), F.col(f"end{which}")
    labels = F.col(inside)
    before = start % resolution  # bases of the first bin that lie outside
    after = (F.expr(f"(`end{which}` - 1) div {resolution}") + 1) * resolution - end

    def scored(label: Column, place: Column) -> Column:
        bins = F.size(F.filter(labels, lambda x: x.eqNullSafe(label))).cast("bigint")
        weight = (
            bins * resolution
            - F.when(F.element_at(labels, 1).eqNullSafe(label), before).otherwise(0)
            - F.when(F.element_at(labels, -1).eqNullSafe(label), after).otherwise(0)
        )
        return F.struct((-weight).alias("light"), place.alias("place"), label.alias("label"))

    best = F.array_min(F.transform(F.array_distinct(labels), scored))
    return F.struct(best["label"].alias("label"), (-best["light"]).alias("weight"))


def interval_label(
    df: DataFrame, labels: DataFrame, resolution: int, which: str, longer: bool | None = None
) -> DataFrame:
    """Label of the interval chrom/start/end<which> of each row, added as ``label<which>``.

    Intervals that fit a row of labels are looked up by one join; ``longer`` says whether there are
    others, which are found out if it is None.
    """
    fits = row_fits(resolution, which)
    if longer is None:
        longer = bool(df.filter(~fits).limit(1).count())
    short = df.filter(fits) if longer else df
    rows = label_rows(labels).withColumnRenamed("chrom", f"chrom{which}")
    out = (
        short.withColumn("_row", row_of(resolution, which))
        .join(rows, [f"chrom{which}", "_row"], "left")
        .withColumn("_inside", labels_inside(resolution, which))
        .select(*df.columns, heaviest_inside(resolution, which)["label"].alias(f"label{which}"))
    )
    return out.unionByName(_long_interval_label(df.filter(~fits), labels, resolution, which)) if longer else out


def _long_interval_label(df: DataFrame, labels: DataFrame, resolution: int, which: str) -> DataFrame:
    """As ``interval_label`` for intervals of any length; equal ones are looked up once."""
    cols = [f"chrom{which}", f"start{which}", f"end{which}"]
    distinct = df.select(*[F.col(c).alias(c[: -len(which)]) for c in cols]).distinct()
    keyed = distinct.withColumn("region_id", F.struct("chrom", "start", "end"))
    found = region_label(keyed, labels, resolution).select(
        *[F.col(f"region_id.{c[: -len(which)]}").alias(c) for c in cols],
        F.col("label").alias(f"label{which}"),
    )
    return df.join(found, cols, "left")


def point_label(df: DataFrame, labels: DataFrame, resolution: int, pos: str = "pos") -> DataFrame:
    """Label of the bin a point falls into, NULL if it has none."""
    keyed = df.withColumn("_bin", F.expr(f"{pos} div {resolution}"))
    return keyed.join(labels.withColumnRenamed("pos", "_bin"), ["chrom", "_bin"], "left").drop("_bin")


def chain_edges(bins: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pos, pos + 1) for every two consecutive valid bins, with their indices."""
    # A bin on the upper edge of a block is copied into the next block as left neighbour.
    here = block_of(F.col("pos"), block)
    homes = F.when(F.col("pos") % block == block - 1, F.array(here, here + 1)).otherwise(F.array(here))
    w = Window.partitionBy("chrom", "_b").orderBy("pos")
    return (
        bins.withColumn("_b", F.explode(homes))
        .withColumn("_p", F.lag("pos").over(w))
        .withColumn("_i", F.lag("idx").over(w))
        .filter((F.col("_p") == F.col("pos") - 1) & (F.col("_b") == block_of(F.col("pos"), block)))
        .select(
            "chrom",
            F.col("_p").alias("pos1"),
            F.col("pos").alias("pos2"),
            F.col("_i").alias("id1"),
            F.col("idx").alias("id2"),
            F.lit(1).cast("bigint").alias("weight"),
        )
    )


def label_changes(indexed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Number of neighbours in index order with different labels."""
    runs = islands(indexed.select(F.lit(0).alias("_all"), "idx", "label"), ["_all"], "idx", "label", block)
    return runs.agg((F.count("*") - 1).alias("changes"))


def mean_run_length(indexed: DataFrame, resolution: int, block: int = BLOCK) -> DataFrame:
    """Mean run length in index order; the last run is not counted."""
    runs = islands(indexed.select(F.lit(0).alias("_all"), "idx", "label"), ["_all"], "idx", "label", block)
    length = (F.col("stop") - F.col("start")) * resolution
    totals = runs.agg(
        F.sum(length).alias("s"), F.count("*").alias("n"), F.max_by(length, F.col("stop")).alias("last")
    )
    return totals.select(
        F.when(F.col("n") > 1, (F.col("s") - F.col("last")) / (F.col("n") - 1)).alias("mean_length")
    )


# --- chromosome arms -----------------------------------------------------------------------


def arm_position(df: DataFrame, arms: DataFrame, resolution: int, pos: str = "pos") -> DataFrame:
    """Adds arm and arm_pos (bin inside the arm) for base positions.

    The bin that straddles the centromere belongs to neither arm on its upper side: its q
    positions get a NULL arm_pos.
    """
    p_size = arms.filter("arm = 'p'").select("chrom", F.col("size").alias("_p"))
    first_q = F.ceil(F.col("_p") / resolution)
    bin_no = F.floor(F.col(pos) / resolution)
    in_p = F.col(pos) < F.col("_p")
    q_pos = bin_no - first_q
    return (
        df.join(p_size, "chrom")
        .withColumn("arm", F.when(in_p, "p").otherwise("q"))
        .withColumn("arm_pos", F.when(in_p, bin_no).otherwise(F.when(q_pos >= 0, q_pos)).cast("bigint"))
        .drop("_p")
    )


def arm_labels(labels: DataFrame, arms: DataFrame, resolution: int) -> DataFrame:
    """Per-bin labels re-keyed by arm: chrom, arm, arm_pos, label; the straddling bin is p's."""
    starts = labels.withColumn("_base", F.col("pos") * resolution)
    return (
        arm_position(starts, arms, resolution, "_base")
        .filter(F.col("arm_pos").isNotNull())
        .select("chrom", "arm", "arm_pos", "label")
    )


def shift_arm_labels(
    by_arm: DataFrame, arms: DataFrame, resolution: int, fractions: Sequence[float]
) -> DataFrame:
    """Circular shift of every arm by the same fraction of its length.

    One permutation (``rep`` = 0, 1, ...) per fraction; each shifts the unshifted labels.
    """
    lengths = arms.select(
        "chrom", "arm", F.ceil(F.col("size") / resolution).cast("bigint").alias("_len")
    )
    shift = F.floor(F.col("_len") * F.col("_f.r")).cast("bigint")
    packed = [
        F.struct(F.lit(rep).alias("rep"), F.lit(float(r)).alias("r"))
        for rep, r in enumerate(fractions)
    ]
    return (
        by_arm.join(lengths, ["chrom", "arm"])
        .filter(F.col("arm_pos") < F.col("_len"))
        .withColumn("_f", F.explode(F.array(*packed)))
        .select(
            F.col("_f.rep").cast("bigint").alias("rep"),
            "chrom",
            "arm",
            ((F.col("arm_pos") + shift) % F.col("_len")).alias("arm_pos"),
            "label",
        )
    )


def permutation_map(
    bins: DataFrame, arms: DataFrame, resolution: int, r: float, block: int = BLOCK
) -> DataFrame:
    """idx -> new_idx: the k-th valid bin of an arm takes the k-th valid bin after the shift.

    Arm q starts at bin ceil(p size / resolution).
    """
    sizes = arms.select("chrom", "arm", F.ceil(F.col("size") / resolution).cast("bigint").alias("n"))
    base = sizes.filter("arm = 'p'").select("chrom", F.col("n").alias("_base"))
    shape = sizes.join(base, "chrom").withColumn(
        "_lo", F.when(F.col("arm") == "p", 0).otherwise(F.col("_base"))
    )
    placed = materialize(
        bins.join(shape, "chrom")
        .filter((F.col("pos") >= F.col("_lo")) & (F.col("pos") < F.col("_lo") + F.col("n")))
        .withColumn("_at", F.col("pos") - F.col("_lo"))
        .withColumn("_sh", F.floor(F.col("n") * F.lit(r)).cast("bigint"))
        # Slot s of the shifted arm holds position (s - shift) mod n.
        .withColumn("_slot", (F.col("_at") + F.col("_sh")) % F.col("n"))
        .withColumn("_arm", F.concat_ws("/", "chrom", "arm"))
    )
    plain = _rank_in(placed, "_arm", "_at", block).select("_arm", "_rank", "idx")
    moved = _rank_in(placed, "_arm", "_slot", block).select("_arm", "_rank", F.col("idx").alias("new_idx"))
    return plain.join(moved, ["_arm", "_rank"]).select("idx", "new_idx")


def _rank_in(df: DataFrame, key: str, pos: str, block: int) -> DataFrame:
    """0-based rank inside ``key`` through block counts."""
    rows = df.withColumn("_b", block_of(F.col(pos), block))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(key, "_b").agg(F.count("*").alias("_c")).select(
        key, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")
    )
    inside = F.row_number().over(Window.partitionBy(key, "_b").orderBy(pos)) - 1
    return rows.withColumn("_k", inside).join(offsets, [key, "_b"]).withColumn(
        "_rank", F.col("_off") + F.col("_k")
    )


# --- two annotations -----------------------------------------------------------------------


def match_resolutions(bins1: DataFrame, bins2: DataFrame, res1: int, res2: int) -> DataFrame:
    """index1 -> index2: every bin of the first grid cut to the common divisor and looked up
    in the second grid by its start; NULL where the second has no such bin.
    """
    step = gcd(res1, res2)
    pieces = bins1.select(
        "chrom",
        F.col("idx").alias("index1"),
        F.explode(F.sequence(F.col("pos") * res1, (F.col("pos") + 1) * res1 - step, F.lit(step))).alias("_s"),
    ).withColumn("pos", F.expr(f"_s div {res2}"))
    return pieces.join(
        bins2.select("chrom", "pos", F.col("idx").alias("index2")), ["chrom", "pos"], "left"
    ).select("index1", "index2")


def aligned_labels(mapper: DataFrame, labels1: DataFrame, labels2: DataFrame) -> DataFrame:
    """label1, label2 of every mapped pair of indices that has both."""
    first = labels1.select(F.col("idx").alias("index1"), F.col("label").alias("label1"))
    second = labels2.select(F.col("idx").alias("index2"), F.col("label").alias("label2"))
    return mapper.join(first, "index1").join(second, "index2").select("label1", "label2")


def index_labels(labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per-bin labels numbered 0..n-1 in chromosome-number order."""
    ranked = labels.withColumn("_rank", chrom_number(F.col("chrom")))
    return position_index(ranked, "_rank", block=block).drop("_rank")


def chrom_number(col: Column) -> Column:
    return F.regexp_extract(col, "([0-9]+)$", 1).cast("int")
