"""Scores of an annotation: coverage, enrichment, variance explained, observed over expected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loopweave.functions.tails import binomial_upper_tail, normal_upper_tail
from loopweave.operators.annotation import (
    arm_position,
    covered_bins,
    heaviest_inside,
    heaviest_label,
    interval_label,
    label_rows,
    labels_inside,
    point_label,
    region_label,
    row_fits,
    row_of,
)
from loopweave.session import materialize

def _all() -> WindowSpec:
    """The whole of an already aggregated table (one row per label or cell)."""
    return Window.partitionBy()


def share(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``value`` over its total; call it only on aggregated rows (one per label or cell)."""
    return df.withColumn(name, F.col(value) / F.sum(value).over(_all())).select(*keys, name)


def coverage(segs: DataFrame) -> DataFrame:
    """Share of the labelled bases per label; NA and NULL segments are skipped."""
    length = F.col("end") - F.col("start")
    sums = (
        segs.filter(F.col("label").isNotNull() & (F.col("label") != "NA"))
        .groupBy("label")
        .agg(F.sum(length).alias("bases"))
    )
    return share(sums, ["label"], "bases", "coverage")


def label_shares(labels: DataFrame) -> DataFrame:
    """Share of the labelled bins per label."""
    counts = labels.filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return share(counts, ["label"], "n", "coverage")


def entropy(shares: DataFrame) -> DataFrame:
    """Shannon entropy (natural log) of the column ``coverage``."""
    return shares.agg((-F.sum(F.col("coverage") * F.log("coverage"))).alias("entropy"))


def segment_lengths(segs: DataFrame) -> DataFrame:
    """Length of every segment in megabases."""
    return segs.select("label", ((F.col("end") - F.col("start")) / 1e6).alias("length_mb"))


def enrichment(values: DataFrame, digits: int = 2) -> DataFrame:
    """values(track, value, label): mean by label over the mean of all bins, label or not."""
    sums = values.groupBy("track", "label").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    per_track = Window.partitionBy("track")
    overall = F.sum("s").over(per_track) / F.sum("n").over(per_track)
    return (
        sums.withColumn("enrichment", F.round((F.col("s") / F.col("n")) / overall, digits))
        .filter("label is not null")
        .select("track", "label", "enrichment")
    )


def variance_explained(
    df: DataFrame, by: Sequence[str] = (), signal: str = "signal", label: str = "label"
) -> DataFrame:
    """1 - within-label squares / total squares, per ``by``.

    One pass over the rows: counts, means and variances per label merge stably, and the sums
    of squares follow from them.
    """
    x, keys = F.col(signal), list(by)
    moments = (
        df.filter(x.isNotNull() & F.col(label).isNotNull())
        .groupBy(*keys, label)
        .agg(F.count("*").alias("_n"), F.avg(x).alias("_m"), F.var_pop(x).alias("_v"))
    )
    group = Window.partitionBy(*keys) if keys else _all()
    overall = F.sum(F.col("_n") * F.col("_m")).over(group) / F.sum("_n").over(group)
    within = F.sum(F.col("_n") * F.col("_v"))
    between = F.sum(F.col("_n") * (F.col("_m") - F.col("_g")) ** 2)
    return (
        moments.withColumn("_g", overall)
        .groupBy(*keys)
        .agg((1 - within / (within + between)).alias("ve"))
    )


def unpivot(df: DataFrame, keep: Sequence[str], names: Sequence[str], key: str, value: str) -> DataFrame:
    return df.unpivot([F.col(c) for c in keep], [F.col(c) for c in names], key, value)


def within_cluster_squares(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """Sum of squared distances to the label means."""
    long = df.select(label, F.posexplode(features).alias("_d", "_x"))
    squares = long.groupBy(label, "_d").agg((F.count("*") * F.var_pop("_x")).alias("_s"))
    return squares.agg(F.sum("_s").alias("sse"))


# --- regions, genes, replication timing ----------------------------------------------------


def region_agreement(
    regions: DataFrame,
    by_arm: DataFrame,
    arms: DataFrame,
    resolution: int,
    reps: Sequence[str] = (),
    versions: Sequence[int] = (),
    least_bins: int = 3,
) -> DataFrame:
    """Mean share of the commonest label over the regions (none competes).

    A region counts if its commonest label is a label and more than ``least_bins`` bins of it
    are labelled. Regions that fit a row of labels are scored where they are joined with it, those of
    more bins or of a repeated ``region_id`` bin by bin.
    """
    regions = regions.select("region_id", "chrom", "start", "end")
    fits = row_fits(resolution)
    odd = materialize(
        regions.groupBy("region_id").agg(F.count("*").alias("n"), F.max(~fits).alias("longer")).filter("n > 1 or longer").select("region_id")
    )
    if not odd.limit(1).count():
        kept = _short_regions(regions, by_arm, arms, resolution, reps, versions)
    else:
        # A null region_id is one region of its own, as in a group.
        some = regions.join(odd.withColumn("_odd", F.lit(True)), regions["region_id"].eqNullSafe(odd["region_id"]), "left").select(
            *[regions[c] for c in regions.columns], F.col("_odd").isNotNull().alias("_odd")
        )
        kept = _short_regions(some.filter(~F.col("_odd")).drop("_odd"), by_arm, arms, resolution, reps, versions).unionByName(
            _any_regions(some.filter("_odd").drop("_odd"), by_arm, arms, resolution, reps, versions)
        )
    counted = kept.filter(F.col("label").isNotNull() & (F.col("labelled") / resolution > least_bins))
    return counted.groupBy(*reps).agg(F.avg(F.col("weight") / F.col("all")).alias("agreement"))


def _short_regions(regions, by_arm, arms, resolution, reps, versions) -> DataFrame:
    """reps, label, weight, all, labelled of every region, all of them in one row of ``label_rows``."""
    p_size = arms.filter("arm = 'p'").select("chrom", F.col("size").alias("_p"))
    first_q = F.ceil(F.col("_p") / resolution)
    # Where arm positions lie on the chromosome; what lies beyond its arm is never met.
    placed = (
        by_arm.join(p_size, "chrom")
        .filter(((F.col("arm") == "p") & (F.col("arm_pos") < first_q)) | ((F.col("arm") == "q") & (F.col("arm_pos") >= 0)))
        .select("chrom", *reps, F.when(F.col("arm") == "p", F.col("arm_pos")).otherwise(F.col("arm_pos") + first_q).alias("pos"), "label")
    )
    rows = label_rows(placed, reps)
    if reps:
        rows = rows.groupBy("chrom", "_row").agg(F.map_from_entries(F.collect_list(F.struct(reps[0], "_labels"))).alias("_labels"))
    joined = regions.filter(F.col("end") > F.col("start")).join(p_size, "chrom").withColumn("_row", row_of(resolution)).join(rows, ["chrom", "_row"], "left")
    found = F.col("_labels")
    if reps:
        joined = joined.withColumn(reps[0], F.explode(F.array(*[F.lit(v).cast("bigint") for v in versions])))
        found = found[F.col(reps[0])]
    inside = joined.withColumn("_inside", labels_inside(resolution, found=found))
    # The bin that straddles the centromere belongs to the other arm for a region that starts in it beyond.
    beyond = (F.col("start") >= F.col("_p")) & (F.expr(f"start div {resolution}") < first_q)
    none = F.array(F.lit(None))
    cut = inside.withColumn("_inside", F.when(beyond, F.concat(none, F.expr("slice(_inside, 2, size(_inside))"))).otherwise(F.col("_inside")))
    every = F.col("end") - F.col("start")
    bare = (
        F.size(F.filter("_inside", lambda x: x.isNull())).cast("bigint") * resolution
        - F.when(F.element_at("_inside", 1).isNull(), F.col("start") % resolution).otherwise(0)
        - F.when(F.element_at("_inside", -1).isNull(), (F.expr(f"(`end` - 1) div {resolution}") + 1) * resolution - F.col("end")).otherwise(0)
    )
    return cut.select(
        *reps, heaviest_inside(resolution).alias("_top"), every.alias("all"), (every - bare).alias("labelled")
    ).select(*reps, "_top.label", "_top.weight", "all", F.when(F.col("labelled") > 0, F.col("labelled")).alias("labelled"))


def _any_regions(regions, by_arm, arms, resolution, reps, versions) -> DataFrame:
    """As ``_short_regions`` for regions of any length and repeated ids, by a row for every covered bin."""
    pieces = arm_position(
        covered_bins(regions, resolution).withColumn(
            "_at", F.greatest(F.col("start"), F.col("pos") * resolution)
        ),
        arms,
        resolution,
        "_at",
    )
    keys = ["region_id", *reps]
    if reps:
        each = F.array(*[F.lit(v).cast("bigint") for v in versions])
        pieces = pieces.withColumn(reps[0], F.explode(each))
    weights = (
        pieces.join(by_arm, ["chrom", "arm", "arm_pos", *reps], "left")
        .groupBy(*keys, "label")
        .agg(F.sum("covered").alias("weight"), F.min("pos").alias("first"))
    )
    best = weights.groupBy(*keys).agg(
        F.min_by(F.struct("label", "weight"), F.struct(-F.col("weight"), F.col("first"))).alias("top"),
        F.sum("weight").alias("all"),
        F.sum(F.when(F.col("label").isNotNull(), F.col("weight"))).alias("labelled"),
    )
    return best.select(*reps, "top.label", "top.weight", "all", "labelled")


def gene_labels(genes: DataFrame, labels: DataFrame, resolution: int) -> DataFrame:
    """gene_id, expr, label of every gene whose commonest label is a label."""
    ordered = genes.select(
        F.col("gene_id").alias("region_id"),
        "chrom",
        F.least("start", "end").alias("start"),
        F.greatest("start", "end").alias("end"),
    )
    found = region_label(ordered, labels, resolution).filter("label is not null")
    return genes.select(F.col("gene_id").alias("region_id"), "expr").join(
        found.select("region_id", "label"), "region_id"
    ).withColumnRenamed("region_id", "gene_id")


def expression_ve(genes: DataFrame, labels: DataFrame, resolution: int) -> DataFrame:
    labelled = gene_labels(genes, labels, resolution)
    return variance_explained(labelled.withColumn("signal", F.asinh("expr")))


def expression_by_label(labelled: DataFrame) -> DataFrame:
    return labelled.filter("label <> 'None'").groupBy("label").agg(F.avg("expr").alias("expr"))


def genes_per_label(labelled: DataFrame, reference_label: str | None = None) -> DataFrame:
    """Genes per label over a tenth of the label's own genes, or of ``reference_label``'s."""
    counts = labelled.groupBy("label").agg(F.count("*").alias("n"))
    base = F.max(F.when(F.col("label") == reference_label, F.col("n"))).over(_all())
    unit = (base if reference_label is not None else F.col("n")) / 10
    return counts.filter("label <> 'None'").select("label", (F.col("n") / unit).alias("genes"))


def timing_by_bin(
    rt: DataFrame, labels: DataFrame, resolution: int, phases: Sequence[str]
) -> DataFrame:
    """Replication timing averaged per bin: chrom, bin, label, one mean per phase."""
    labelled = point_label(rt.na.drop(), labels, resolution)
    return (
        labelled.groupBy("chrom", F.expr(f"pos div {resolution}").alias("bin"))
        .agg(F.max("label").alias("label"), *[F.avg(p).alias(p) for p in phases])
        .na.drop()
    )


def mean_phase_ve(df: DataFrame, phases: Sequence[str]) -> DataFrame:
    """Mean over the phases of the variance explained by the labels."""
    long = unpivot(df, ["label"], phases, "phase", "signal")
    return variance_explained(long, by=["phase"]).agg(F.avg("ve").alias("ve"))


def timing_scores(
    rt: DataFrame, labels: DataFrame, resolution: int, phases: Sequence[str]
) -> DataFrame:
    """Mean variance explained and adjusted Rand index of the strongest phase, one row."""
    labelled = materialize(point_label(rt, labels, resolution).filter("label is not null"))
    values = F.array(*[F.col(p) for p in phases])
    phase = F.array_position(values, F.array_max(values)) - 1
    rand = adjusted_rand(labelled.select(phase.alias("label1"), F.col("label").alias("label2")))
    return mean_phase_ve(labelled, phases).withColumn("ari", rand.scalar())


def adjusted_rand(df: DataFrame) -> DataFrame:
    """Adjusted Rand index of label1 against label2, from pair counts of the contingency table."""
    n = F.sum("n").cast("double")
    pairs = (n * (n - 1) / 2).alias("pairs")
    # Cells, both margins and the total in one pass over the small table.
    sums = (
        df.groupBy("label1", "label2")
        .agg(F.count("*").alias("n"))
        .groupingSets([["label1", "label2"], ["label1"], ["label2"], []], "label1", "label2")
        .agg(F.grouping_id().alias("level"), pairs)
    )
    cells, rows, cols, every = [F.sum(F.when(F.col("level") == k, F.col("pairs"))) for k in range(4)]
    one = sums.agg(cells.alias("cells"), rows.alias("rows"), cols.alias("cols"), every.alias("every"))
    expected = F.col("rows") * F.col("cols") / F.col("every")
    top = (F.col("rows") + F.col("cols")) / 2
    return one.select(
        F.when(top == expected, 1.0).otherwise((F.col("cells") - expected) / (top - expected)).alias("ari")
    )


# --- contact tables ------------------------------------------------------------------------


def contingency(df: DataFrame, weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """label1, label2, n: summed weight (or row count) of labelled pairs."""
    total = F.sum(weight) if weight else F.count("*")
    return (
        df.filter("label1 is not null and label2 is not null")
        .groupBy(*keys, "label1", "label2")
        .agg(total.alias("n"))
    )


def paired_labels(pairs: DataFrame, labels: DataFrame, resolution: int) -> DataFrame:
    """Adds label1 and label2, the commonest label of each end of every paired region."""
    longer = pairs.agg(*[F.max(~row_fits(resolution, end)).alias(end) for end in "12"]).first()
    once = interval_label(pairs, labels, resolution, "1", bool(longer["1"]))
    return interval_label(once, labels, resolution, "2", bool(longer["2"]))


def binned_pair_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pairs given by bin: chrom1, pos1, chrom2, pos2, weight."""
    first = labels.toDF("chrom1", "pos1", "label1")
    second = labels.toDF("chrom2", "pos2", "label2")
    return pairs.join(first, ["chrom1", "pos1"], "left").join(second, ["chrom2", "pos2"], "left")


def diagonal_share(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of a contingency table on its diagonal."""
    on = F.when(F.col("label1") == F.col("label2"), F.col("n")).otherwise(0)
    return table.groupBy(*keys).agg((F.sum(on) / F.sum("n")).alias("ratio"))


def intra_over_expected(
    table: DataFrame, shares: DataFrame, keys: Sequence[str] = (), on_both_axes: bool = False
) -> DataFrame:
    """Observed diagonal share over the sum of squared coverages.

    ``on_both_axes`` leaves out labels that miss on either axis of the table.
    """
    observed = table.groupBy(*keys).agg(
        F.sum(F.when(F.col("label1") == F.col("label2"), F.col("n")).otherwise(0)).alias("o"),
        F.sum("n").alias("t"),
    )
    squares = shares.select("label", (F.col("coverage") ** 2).alias("sq"))
    if on_both_axes:
        axes = F.explode(F.array(F.struct(F.col("label1").alias("label"), F.lit(1).alias("axis")),
                                 F.struct(F.col("label2").alias("label"), F.lit(2).alias("axis"))))
        present = (
            table.select(*keys, axes.alias("a"))
            .groupBy(*keys, "a.label")
            .agg(F.countDistinct("a.axis").alias("axes"))
            .filter("axes = 2")
        )
        expected = present.join(squares, "label").groupBy(*keys).agg(F.sum("sq").alias("e"))
        joined = (
            observed.join(expected, list(keys))
            if keys
            else observed.withColumn("e", expected.scalar())
        )
    else:
        joined = observed.withColumn("e", squares.agg(F.sum("sq")).scalar())
    return joined.select(*keys, (F.col("o") / F.col("t") / F.col("e")).alias("oe"))


def symmetric_table(table: DataFrame) -> DataFrame:
    """Off-diagonal cells become the sum of both orders, over the union of the labels; 0 if absent."""
    low, high = F.least("label1", "label2"), F.greatest("label1", "label2")
    folded = table.groupBy(low.alias("a"), high.alias("b")).agg(F.sum("n").alias("n"))
    both = F.array_distinct(F.array(F.struct(F.col("a").alias("label1"), F.col("b").alias("label2")),
                                    F.struct(F.col("b").alias("label1"), F.col("a").alias("label2"))))
    cells = folded.select(F.explode(both).alias("c"), "n").select("c.label1", "c.label2", "n")
    every = cells.groupBy().agg(F.collect_set("label1").alias("l"))
    grid = every.select(F.explode("l").alias("label1"), "l").select("label1", F.explode("l").alias("label2"))
    return grid.join(cells, ["label1", "label2"], "left").na.fill(0, ["n"])


def over_expected(
    table: DataFrame, row_shares: DataFrame, col_shares: DataFrame, digits: int = 2
) -> DataFrame:
    """Cells over total * row coverage * column coverage."""
    rows = row_shares.toDF("label1", "_r")
    cols = col_shares.toDF("label2", "_c")
    total = F.sum("n").over(_all())
    return (
        table.withColumn("_t", total)
        .join(rows, "label1")
        .join(cols, "label2")
        .select(
            "label1", "label2",
            F.round(F.col("n") / (F.col("_t") * F.col("_r") * F.col("_c")), digits).alias("oe"),
        )
    )


def column_shares(table: DataFrame) -> DataFrame:
    """Each cell over the sum of its label1 column."""
    per_col = Window.partitionBy("label1")
    return table.select("label1", "label2", (F.col("n") / F.sum("n").over(per_col)).alias("share"))


def overlap_enrichment(table: DataFrame, tail: bool = True) -> DataFrame:
    """Observed over expected by margins for every cell of the grid, with the one-sided
    binomial upper-tail p-value of the count.
    """
    every = table.groupBy().agg(
        F.collect_set("label1").alias("a"), F.collect_set("label2").alias("b")
    )
    grid = every.select(F.explode("a").alias("label1"), "b").select("label1", F.explode("b").alias("label2"))
    full = grid.join(table, ["label1", "label2"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(_all())
    chance = (
        F.sum("n").over(Window.partitionBy("label1")) / total
        * F.sum("n").over(Window.partitionBy("label2")) / total
    )
    out = full.select("label1", "label2", "n", total.alias("total"), chance.alias("chance")).withColumn(
        "oe", F.col("n") / (F.col("total") * F.col("chance"))
    )
    if tail:
        out = out.withColumn("pvalue", binomial_upper_tail("n", "total", "chance"))
    return out


# --- spatial autocorrelation ---------------------------------------------------------------


def morans_i(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Moran's I with its expectation, randomisation variance, z-score and upper-tail p-value.

    ``values(idx, value)``; ``edges(id1, id2, weight)`` are the cells of the weight matrix.
    """
    values = materialize(values.select("idx", "value"))
    centred = values.select(
        "idx", (F.col("value") - values.agg(F.avg("value")).scalar()).alias("d")
    )
    one = centred.agg(
        F.count("*").cast("double").alias("n"),
        F.sum(F.col("d") ** 2).alias("m2"),
        F.sum(F.col("d") ** 4).alias("m4"),
    )
    # Read four times below, so computed once.
    cells = materialize(edges.groupBy("id1", "id2").agg(F.sum("weight").cast("double").alias("w")))
    cross = (
        cells.join(centred.toDF("id1", "d1"), "id1")
        .join(centred.toDF("id2", "d2"), "id2")
        .agg(F.sum(F.col("w") * F.col("d1") * F.col("d2")).alias("cross"))
    )
    total = cells.agg(F.sum("w").alias("w"))
    # (A + A')^2 summed over all cells: an off-diagonal unordered pair appears twice.
    s1 = (
        cells.groupBy(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"))
        .agg(F.sum("w").alias("p"))
        .agg(
            (F.sum(F.when(F.col("a") == F.col("b"), 4 * F.col("p") ** 2).otherwise(2 * F.col("p") ** 2)) / 2)
            .alias("s1")
        )
    )
    s2 = (
        cells.select(F.explode(F.array("id1", "id2")).alias("i"), "w")
        .groupBy("i")
        .agg(F.sum("w").alias("m"))
        .agg(F.sum(F.col("m") ** 2).alias("s2"))
    )
    for name, part in (("cross", cross), ("w", total), ("s1", s1), ("s2", s2)):
        one = one.withColumn(name, part.scalar())
    n, w = F.col("n"), F.col("w")
    s3 = (F.col("m4") / n) / (F.col("m2") / n) ** 2
    s4 = (n * n - 3 * n + 3) * F.col("s1") - n * F.col("s2") + 3 * w * w
    s5 = (n * n - n) * F.col("s1") - 2 * n * F.col("s2") + 6 * w * w
    expected = F.lit(-1.0) / (n - 1)
    variance = (n * s4 - s3 * s5) / ((n - 1) * (n - 2) * (n - 3) * w * w) - expected**2
    return (
        one.withColumn("moran", n * F.col("cross") / (w * F.col("m2")))
        .withColumn("expected", expected)
        .withColumn("variance", variance)
        .withColumn("z_score", (F.col("moran") - F.col("expected")) / F.sqrt("variance"))
        .withColumn("p_value", normal_upper_tail("z_score"))
        .select("moran", "expected", "variance", "z_score", "p_value")
    )


# --- clustering scores ---------------------------------------------------------------------


def _label_means(df: DataFrame) -> DataFrame:
    long = df.select("label", F.posexplode("features").alias("d", "x"))
    return long.groupBy("label", "d").agg(F.avg("x").alias("m"), F.count("x").alias("n"))


def cluster_spread_scores(df: DataFrame) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin scores, one row; linear in the rows.

    ``df(features, label)``. Only the label means, one row per label, meet each other.
    """
    means = _label_means(df)
    vectors = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"),
        F.max("n").alias("n"),
    )
    near = df.join(vectors.select("label", "mean"), "label").select(
        "label", F.aggregate(F.zip_with("features", "mean", lambda a, b: (a - b) * (a - b)),
                             F.lit(0.0), lambda s, x: s + x).alias("sq"),
    )
    spread = near.groupBy("label").agg(F.avg(F.sqrt("sq")).alias("s"), F.sum("sq").alias("sse"))
    overall = means.groupBy("d").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("g"))
    between = means.join(overall, "d").agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("ssb"))
    sizes = vectors.join(spread, "label").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("sse").alias("ssw")
    )
    ch = sizes.withColumn("ssb", between.scalar()).select(
        ((F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))).alias("ch")
    )
    summary = vectors.join(spread, "label").select("label", "mean", "s")
    others = summary.agg(F.collect_list(F.struct("label", "mean", "s"))).scalar()
    apart = F.sqrt(
        F.aggregate(
            F.zip_with("mean", "o.mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
        )
    )
    db = (
        summary.select("label", "mean", "s", F.explode(others).alias("o"))
        .filter(F.col("label") != F.col("o.label"))
        .groupBy("label")
        .agg(F.max((F.col("s") + F.col("o.s")) / apart).alias("r"))
        .agg(F.avg("r").alias("db"))
    )
    return ch.withColumn("db", db.scalar())
