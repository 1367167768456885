"""Measure propagation: alternating minimisation of Kullback-Leibler smoothness over a graph.

Updates after Subramanya and Bilmes, Journal of Machine Learning Research 12 (2011).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.plans.blocks import matrix_blocks
from loopweave.plans.rounds import Rounds, bucketed
from loopweave.plans.vectors import items, log_sum_exp, sum_vector

FLOOR = 1e-300


class Links:
    """The edges between the nodes of ``measures``, laid out once for any number of propagations.

    ``edges(id1, id2, weight)`` hold both directions. ``blocks`` is none where the graph is not symmetric or has
    very full nodes; ``by_ends`` are the edges then.
    """

    def __init__(self, edges: DataFrame, measures: DataFrame):
        cells = Rounds().keep(
            edges.select(F.col("id1").alias("node"), F.col("id2").alias("nbr"), F.col("weight").cast("double").alias("weight")).unionByName(
                measures.select(F.col("idx").alias("node")), allowMissingColumns=True
            )
        )
        self.blocks = matrix_blocks(cells)
        self.by_ends = cells.filter("nbr is not null").select(F.col("node").alias("id1"), F.col("nbr").alias("id2"), "weight")


def propagate(
    edges: DataFrame | Links,
    measures: DataFrame,
    rounds: int = 5,
    mu: float = 1.0,
    nu: float = 0.0,
    self_weight: float = 1.0,
) -> DataFrame:
    """idx, post after ``rounds`` rounds; ``measures(idx, post)`` labels its nodes.

    ``edges(id1, id2, weight)`` hold both directions; ``Links`` are laid out already and name every node that
    ``measures`` has. Nodes without a measure start uniform.
    Neighbour sums are K partially aggregated columns, so a hub never gathers in one task
    before its sums are combined. Symmetric graphs are laid out in blocks of whole nodes once and a round
    exchanges packed pieces of the vectors; others, and those with very full nodes, by either end of an edge.
    """
    width = measures.agg(F.max(F.size("post"))).first()[0]
    links = edges if isinstance(edges, Links) else Links(edges, measures)
    if links.blocks is not None:
        return _propagate_in_blocks(links.blocks, measures, rounds, mu, nu, self_weight, width)
    return _propagate_by_edges(links.by_ends, measures, rounds, mu, nu, self_weight, width)


def _propagate_in_blocks(blocks, measures, rounds, mu, nu, self_weight, width) -> DataFrame:
    """``propagate`` on vectors in blocks: the weights' sums, whether there is a measure, the measure, then q or p."""

    def begin(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        there = a[width:]
        return np.vstack([there, a[:width], np.where(there > 0, a[:width], 1.0 / width)]), np.ones_like(there)

    def weighed(kept: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, list[float]]:
        return np.vstack([products[:1] + self_weight, kept]), []

    def logs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.log(np.maximum(a[-width:], FLOOR))
        return np.vstack([a[:-width], own]), own

    def pull(kept: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, list[float]]:
        b = mu * (products + self_weight * kept[-width:]) / (nu + mu * kept[0])
        return np.vstack([kept[:-width], np.exp(b - np.logaddexp.reduce(b, axis=0))]), []

    def push(kept: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, list[float]]:
        q = (kept[2 : 2 + width] + mu * (products + self_weight * kept[-width:])) / (kept[1] + mu * kept[0])
        return np.vstack([kept[:-width], q]), []

    prior = blocks.keep(blocks.gathered(measures.select("idx", F.col("post").alias("value")), width))
    state = blocks.keep(blocks.product(prior, begin, weighed))
    for step in range(rounds):
        state = blocks.keep(blocks.product(state, logs, pull))
        if step + 1 < rounds:
            state = blocks.keep(blocks.product(state, lambda a: (a, a[-width:]), push))
    return blocks.rows(state, width, last=True).select("idx", F.col("value").alias("post"))


def _propagate_by_edges(edges, measures, rounds, mu, nu, self_weight, width) -> DataFrame:
    """``propagate`` by rows of edges, laid out once by either end; a round shuffles vectors."""
    steps = Rounds()
    flat = F.array(*[F.lit(1.0 / width)] * width)
    by_first = bucketed(edges, "id1")
    by_second = bucketed(by_first, "id2")
    ends = by_first.select(F.explode(F.array("id1", "id2")).alias("idx")).distinct()
    state = steps.keep(
        ends.join(measures, "idx", "full").select(
            "idx",
            F.col("post").alias("r"),
            F.coalesce("post", flat).alias("q"),
        )
    )
    p = None
    zero = F.lit(0.0)
    for _ in range(rounds):
        logs = [F.log(F.greatest(v, F.lit(FLOOR))) for v in items("q", width)]
        pulled = _neighbour_sums(
            by_second, state.select(F.col("idx").alias("id2"), F.array(*logs).alias("_v")), "id2", "id1", width
        )
        weights = F.coalesce("w", zero) + F.lit(self_weight)
        pull = [
            F.lit(mu) * (F.coalesce(s, zero) + F.lit(self_weight) * own)
            / (F.lit(nu) + F.lit(mu) * weights)
            for s, own in zip(items("s", width), logs)
        ]
        p = steps.keep(
            state.join(pulled, "idx", "left")
            .select("idx", "r", F.array(*pull).alias("_b"))
            .withColumn("_z", log_sum_exp(items("_b", width)))
            .select("idx", "r", F.array(*[F.exp(b - F.col("_z")) for b in items("_b", width)]).alias("p"))
        )
        pushed = _neighbour_sums(
            by_first, p.select(F.col("idx").alias("id1"), F.col("p").alias("_v")), "id1", "id2", width
        )
        below = F.col("r").isNotNull().cast("double") + F.lit(mu) * weights
        push = [
            (F.coalesce(r, zero) + F.lit(mu) * (F.coalesce(s, zero) + F.lit(self_weight) * own)) / below
            for r, s, own in zip(items("r", width), items("s", width), items("p", width))
        ]
        state = steps.keep(
            p.join(pushed, "idx", "left").select("idx", "r", "p", F.array(*push).alias("q"))
        )
    return state.select("idx", F.col("p").alias("post"))


def _neighbour_sums(edges: DataFrame, values: DataFrame, at: str, to: str, width: int) -> DataFrame:
    """idx, w, s: summed weight and weighted sum of the vectors found at the ``at`` ends."""
    weighted = F.array(*[v * F.col("weight") for v in items("_v", width)])
    return (
        edges.join(values, at)
        .withColumn("_x", weighted)
        .groupBy(F.col(to).alias("idx"))
        .agg(F.sum("weight").alias("w"), sum_vector(F.col("_x"), width).alias("s"))
    )
