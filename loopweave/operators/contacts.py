"""Contact lists: indexing, strongest contacts, graphs, symmetrisation, marginals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopweave.plans.scan import position_index
from loopweave.plans.scan import dense_index
from loopweave.plans.topk import top_k

PAIR = ["chrom1", "pos1", "chrom2", "pos2"]


def index_bins(bins: DataFrame, rank: str = "chrom", valid: str | None = None) -> DataFrame:
    """Number the valid bins 0..n-1 in (rank, pos) order; ``valid`` names a flag, without one all are valid."""
    if valid is not None:
        bins = bins.filter(F.col(valid)).drop(valid)
    return position_index(bins, rank)


def bin_contacts(df: DataFrame, resolution: int) -> DataFrame:
    """Base-pair contact starts to bin numbers."""
    return df.withColumn("pos1", F.expr(f"pos1 div {resolution}")).withColumn(
        "pos2", F.expr(f"pos2 div {resolution}")
    )


def drop_missing(df: DataFrame, weight: str = "weight") -> DataFrame:
    """NULL and NaN weights carry no contact."""
    return df.filter(F.col(weight).isNotNull() & ~F.isnan(weight))


def indexed_contacts(df: DataFrame, bins: DataFrame, keep: Sequence[str] = ("weight",)) -> DataFrame:
    """Replace both ends by bin indices; contacts with an invalid end or without a weight are left out."""
    df = drop_missing(df) if "weight" in keep else df
    lookup = bins.select("chrom", "pos", "idx")
    first = lookup.toDF("chrom1", "pos1", "id1")
    second = lookup.toDF("chrom2", "pos2", "id2")
    return (
        df.join(first, ["chrom1", "pos1"])
        .join(second, ["chrom2", "pos2"])
        .select("id1", "id2", *keep)
    )


def positions_of_edges(edges: DataFrame, bins: DataFrame, resolution: int = 1) -> DataFrame:
    """The inverse of indexing: both ends as chrom and start."""
    lookup = bins.select("chrom", (F.col("pos") * resolution).alias("pos"), "idx")
    return (
        edges.join(lookup.toDF("chrom1", "pos1", "id1"), "id1")
        .join(lookup.toDF("chrom2", "pos2", "id2"), "id2")
        .select(*PAIR, "weight")
    )


def strongest(df: DataFrame, k: int | str, keys: Sequence[str] = ("chrom1", "chrom2")) -> DataFrame:
    """Top-k contacts by weight per chromosome pair.

    Contacts whose two bin numbers agree are dropped first, between chromosomes as well.
    """
    off = drop_missing(df).filter(F.col("pos1") != F.col("pos2"))
    return top_k(off, keys, [F.col("weight").desc()], k, PAIR)


def most_significant(df: DataFrame, k: int | str, keys: Sequence[str] = ("chrom1", "chrom2")) -> DataFrame:
    """The k smallest p-values per pair; only intra-chromosomal self contacts are dropped."""
    off = drop_missing(df, "pvalue").filter(
        (F.col("chrom1") != F.col("chrom2")) | (F.col("pos1") != F.col("pos2"))
    )
    return top_k(off, keys, [F.col("pvalue").asc()], k, PAIR)


def pair_quotas(bins: DataFrame, base: int, intra: bool = False) -> DataFrame:
    """chrom1, chrom2, k: base count scaled by both chromosomes' valid bins over the smallest.

    Works on one row per chromosome; each row is repeated for its partners by number.
    """
    sizes = bins.groupBy("chrom").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    tagged = sizes.withColumn("least", F.min("n").over(every)).withColumn(
        "all", F.collect_list("chrom").over(every)
    )
    partners = F.array("chrom") if intra else F.filter("all", lambda c: c >= F.col("chrom"))
    left = tagged.select(
        F.col("chrom").alias("chrom1"),
        F.col("n").alias("n1"),
        "least",
        F.explode(partners).alias("chrom2"),
    )
    right = sizes.toDF("chrom2", "n2")
    share = (F.col("n1") / F.col("least")) * (F.col("n2") / F.col("least"))
    return left.join(right, "chrom2").select(
        "chrom1", "chrom2", F.floor(F.lit(base) * share).cast("bigint").alias("k")
    )


def quota_graph(
    df: DataFrame,
    bins: DataFrame,
    base: int,
    by: str = "weight",
    intra: bool = False,
    symmetric: bool = True,
) -> DataFrame:
    """Interaction graph of each pair's quota of best contacts, every edge of weight 1.

    Contacts are ranked before the valid-bin lookup, so an invalid bin uses up its place.
    """
    quotas = pair_quotas(bins, base, intra)
    ranked = df.join(quotas, ["chrom1", "chrom2"])
    best = strongest(ranked, "k") if by == "weight" else most_significant(ranked, "k")
    graph = indexed_contacts(best.withColumn("weight", F.lit(1)), bins)
    return swap_union(graph) if symmetric else graph


def significant_intra(df: DataFrame, bins: DataFrame, threshold: float) -> DataFrame:
    """Intra-chromosomal contacts with p-value below ``threshold``, weight 1, directed once."""
    kept = df.filter((F.col("chrom1") == F.col("chrom2")) & (F.col("pvalue") < threshold))
    return indexed_contacts(kept.withColumn("weight", F.lit(1)), bins)


def significant_by_distance(
    df: DataFrame, bins: DataFrame, thresholds: Sequence[float], distance: int
) -> DataFrame:
    """Nested short-range graphs: one copy of an edge per threshold it passes (inclusive)."""
    passed = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("pvalue") <= t)
    kept = (
        drop_missing(df, "pvalue")
        .filter(F.col("chrom1") == F.col("chrom2"))
        .filter(F.col("pvalue") <= max(thresholds))
        .filter(F.abs(F.col("pos2") - F.col("pos1")) <= distance)
        .filter(F.col("pos1") != F.col("pos2"))
        .withColumn("weight", F.lit(1))
    )
    return indexed_contacts(
        kept.withColumn("threshold", F.explode(passed)), bins, keep=("weight", "threshold")
    )


def inter_graph(df: DataFrame, bins: DataFrame, least: float = 1.0) -> DataFrame:
    """Contacts between different chromosomes, asinh weights, both directions."""
    kept = df.filter((F.col("chrom1") < F.col("chrom2")) & (F.col("weight") >= least))
    return swap_union(indexed_contacts(kept.withColumn("weight", F.asinh("weight")), bins))


def swap_union(edges: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """Every edge and its reverse; loops come out twice."""
    rest = [c for c in edges.columns if c not in (a, b)]
    both = F.explode(
        F.array(
            F.struct(F.col(a).alias(a), F.col(b).alias(b)),
            F.struct(F.col(b).alias(a), F.col(a).alias(b)),
        )
    )
    return edges.select(both.alias("_e"), *rest).select(f"_e.{a}", f"_e.{b}", *rest)


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("id1") != F.col("id2"))


def both_directions(edges: DataFrame) -> DataFrame:
    """Loops dropped, every other edge in both directions."""
    return swap_union(without_loops(edges))


def both_directions_with_loops(edges: DataFrame) -> DataFrame:
    """Loops once, every other edge in both directions."""
    other = F.struct(F.col("id2").alias("id1"), F.col("id1").alias("id2"))
    same = F.struct("id1", "id2")
    ends = F.when(F.col("id1") == F.col("id2"), F.array(same)).otherwise(F.array(same, other))
    rest = [c for c in edges.columns if c not in ("id1", "id2")]
    return edges.select(F.explode(ends).alias("_e"), *rest).select("_e.id1", "_e.id2", *rest)


def mirror_upper(edges: DataFrame) -> DataFrame:
    """Symmetric matrix from its upper triangle: lower cells are replaced by the mirror."""
    return both_directions_with_loops(edges.filter(F.col("id1") <= F.col("id2")))


def merge_lists(parts: Sequence[DataFrame], bidirectional: bool = False) -> DataFrame:
    """Concatenate contact lists, optionally with swaps, truncate weights, keep distinct rows."""
    merged = parts[0].select("id1", "id2", "weight")
    for part in parts[1:]:
        merged = merged.unionByName(part.select("id1", "id2", "weight"))
    if bidirectional:
        merged = swap_union(merged)
    return merged.dropDuplicates(["id1", "id2", "weight"]).withColumn(
        "weight", F.col("weight").cast("bigint")
    )


def sum_duplicates(df: DataFrame, keys: Sequence[str] = ("id1", "id2")) -> DataFrame:
    """COO cells that name the same place are added."""
    return df.groupBy(*keys).agg(F.sum("weight").alias("weight"))


def short_range(edges: DataFrame, k: int) -> DataFrame:
    """Keep only cells nearer than ``k`` to the diagonal."""
    return edges.filter(F.abs(F.col("id1") - F.col("id2")) < k)


def drop_empty(edges: DataFrame) -> DataFrame:
    """Sub-matrix on the indices whose column sum is not zero; cells without a weight are none."""
    edges = drop_missing(edges)
    alive = edges.groupBy("id2").agg(F.sum("weight").alias("s")).filter("s <> 0").select("id2")
    rows = alive.withColumnRenamed("id2", "id1")
    return edges.join(alive, "id2", "left_semi").join(rows, "id1", "left_semi")


def drop_indices(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Cells whose row and column are both outside ``removed(idx)``."""
    cols = removed.select(F.col("idx").alias("id2"))
    rows = removed.select(F.col("idx").alias("id1"))
    return edges.join(cols, "id2", "left_anti").join(rows, "id1", "left_anti")


def renumbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, ids): the cells with rows and columns numbered anew without gaps, and old -> new (idx, new)."""
    seen = edges.select(F.explode(F.array("id1", "id2")).alias("idx")).distinct()
    ids = dense_index(seen, ["idx"], "new")
    first, second = ids.toDF("id1", "new1"), ids.toDF("id2", "new2")
    cells = edges.join(first, "id1").join(second, "id2")
    return cells.select(F.col("new1").alias("id1"), F.col("new2").alias("id2"), "weight"), ids


def rejoined(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs whose two halves were both lifted: ``first`` and ``second`` (line, chrom, start, end), first with weight.

    A half that was lost is absent on its side, or there without chrom, start or end.
    """
    first, second = (x.dropna(subset=["chrom", "start", "end"]) for x in (first, second))
    left = first.select("line", *[F.col(c).alias(f"{c}1") for c in ("chrom", "start", "end")], "weight")
    right = second.select("line", *[F.col(c).alias(f"{c}2") for c in ("chrom", "start", "end")])
    return left.join(right, "line").select("line", "chrom1", "start1", "end1", "chrom2", "start2", "end2", "weight")


def window_cells(
    df: DataFrame, start1: int, end1: int, start2: int, end2: int
) -> DataFrame:
    """Sub-matrix [start1,end1] x [start2,end2] in either orientation, as offsets from its corner."""
    def cells(r: str, c: str) -> Column:
        inside = F.col(r).between(start1, end1) & F.col(c).between(start2, end2)
        return F.when(
            inside,
            F.struct((F.col(r) - start1).alias("row"), (F.col(c) - start2).alias("col")),
        )

    hits = F.array_distinct(F.array_compact(F.array(cells("id1", "id2"), cells("id2", "id1"))))
    return df.select(F.explode(hits).alias("_c"), "weight").select("_c.row", "_c.col", "weight")


def fragment_marginals(df: DataFrame, resolution: int) -> DataFrame:
    """Summed weight per fragment midpoint over both ends; a self contact counts once."""
    half = resolution // 2
    first = F.struct(F.col("chrom1").alias("chrom"), F.col("pos1").alias("pos"))
    second = F.struct(F.col("chrom2").alias("chrom"), F.col("pos2").alias("pos"))
    ends = F.when(first == second, F.array(first)).otherwise(F.array(first, second))
    return (
        df.select(F.explode(ends).alias("_f"), "weight")
        .groupBy("_f.chrom", "_f.pos")
        .agg(F.sum("weight").cast("bigint").alias("weight"))
        .select(
            "chrom",
            F.lit(0).cast("bigint").alias("extra"),
            (F.col("pos") * resolution + half).alias("mid"),
            "weight",
            F.lit(1).cast("bigint").alias("mappable"),
        )
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Weight summed at both ends of every edge; a loop counts twice."""
    return (
        edges.select(F.explode(F.array("id1", "id2")).alias("idx"), "weight")
        .groupBy("idx")
        .agg(F.sum("weight").alias("degree"))
    )


def neighbours(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter(F.col("id1") == node).select(F.col("id2").alias("idx"), "weight")


def has_edge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(id1, id2) with a flag telling whether a positive edge joins them."""
    present = edges.filter("weight > 0").select("id1", "id2").distinct().withColumn("_y", F.lit(True))
    return pairs.join(present, ["id1", "id2"], "left").select(
        "id1", "id2", F.coalesce("_y", F.lit(False)).alias("connected")
    )
