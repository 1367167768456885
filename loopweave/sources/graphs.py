"""Networks as tables: vertex numbering, adjacency lists, undirected unit edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.plans.scan import dense_index


def vertex_ids(edges: DataFrame) -> DataFrame:
    """name -> id in order of first appearance; ``edges(line, u, v)``, ``line`` orders the input.

    The first end of a line comes before the second; lines of equal number fall back to names.
    """
    seen = F.explode(
        F.array(
            F.struct(F.col("u").alias("name"), (F.col("line") * 2).alias("at")),
            F.struct(F.col("v").alias("name"), (F.col("line") * 2 + 1).alias("at")),
        )
    )
    first = edges.select(seen.alias("s")).groupBy("s.name").agg(F.min("s.at").alias("at"))
    return dense_index(first, ["at", "name"], "id").select("name", "id")


def numbered_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of names as edges of ids: id1, id2, weight."""
    return (
        edges.join(ids.toDF("u", "id1"), "u")
        .join(ids.toDF("v", "id2"), "v")
        .select("id1", "id2", "weight")
    )


def undirected_unit_edges(edges: DataFrame) -> DataFrame:
    """(a, b) and (b, a), both of weight 1."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return edges.select(ends.alias("e")).select("e.a", "e.b", F.lit(1).alias("weight"))


def adjacency(edges: DataFrame, part_size: int = 1 << 16) -> DataFrame:
    """node, part, neighbours array<struct<dst, weight>> ordered by dst.

    A node of ``part_size`` neighbours or fewer is one row, part 0; a hub is cut by a hash of the
    neighbour into parts of about that size, so that no row and no task gathers a whole hub.
    """
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    rows = edges.select(F.col("id1").alias("node"), F.struct(F.col("id2").alias("dst"), weight.cast("float").alias("weight")).alias("item"))
    parts = rows.groupBy("node").agg(F.ceil(F.count("*") / part_size).alias("parts"))
    cut = rows.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("item.dst"), F.col("parts")))
    return cut.groupBy("node", "part").agg(F.array_sort(F.collect_list("item")).alias("neighbours"))
