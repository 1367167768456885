"""Densification of a network by breadth-first flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.operators.contacts import degrees
from loopweave.plans.topk import top_k
from loopweave.session import materialize


def densify(edges: DataFrame, max_neighbours: int, depth: int = 1) -> DataFrame:
    """Vertices with more than ``max_neighbours`` out-edges keep them; all others get the
    strongest of: a self weight of a tenth of their degree, and the flow reaching each vertex
    over all walks up to ``depth``.

    Flow into one (source, vertex) cell is summed after every step, so walks that meet are
    carried on as one row and the rows stay below the cells of the result.
    """
    edges = materialize(edges.select("id1", "id2", "weight"))
    out = edges.groupBy("id1").agg(
        F.count("*").alias("fanout"), F.sum("weight").cast("double").alias("total")
    )
    wide = out.filter(F.col("fanout") > max_neighbours).select("id1")
    kept = edges.join(wide, "id1", "left_semi").select("id1", "id2", F.col("weight").cast("double"))
    sources = degrees(edges).join(
        wide.withColumnRenamed("id1", "idx"), "idx", "left_anti"
    )
    step = edges.join(out, "id1").select(
        F.col("id1").alias("via"), F.col("id2").alias("next"), (F.col("weight") / F.col("total")).alias("part")
    )
    flow = (
        edges.join(sources.select(F.col("idx").alias("id1")), "id1", "left_semi")
        .groupBy("id1", "id2")
        .agg(F.sum("weight").cast("double").alias("flow"))
    )
    reached = sources.select(
        F.col("idx").alias("id1"), F.col("idx").alias("id2"), (F.col("degree") / 10.0).alias("flow")
    ).unionByName(flow)
    for _ in range(1, depth):
        flow = materialize(
            flow.join(step, flow["id2"] == step["via"])
            .groupBy("id1", F.col("next").alias("id2"))
            .agg(F.sum(F.col("flow") * F.col("part")).alias("flow"))
        )
        reached = reached.unionByName(flow)
    cells = reached.groupBy("id1", "id2").agg(F.round(F.sum("flow"), 6).alias("weight"))
    best = top_k(cells, ["id1"], [F.col("weight").desc()], max_neighbours, ["id1", "id2"])
    return best.unionByName(kept)
