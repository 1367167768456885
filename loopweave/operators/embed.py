"""Node embeddings of first and second order proximity by sampled edges and negatives.

Vertices are dealt into blocks of bounded size. Training goes through the pairs of blocks like a
tournament: in one round every block meets one other (or itself), all meetings are disjoint, so they
train side by side, and inside a meeting samples follow each other in small fixed batches that see
the vectors the earlier ones left. Neither the graph nor the embedding has to fit any one machine,
and the number of samples that a vertex sees does not depend on the layout. A meeting draws its
share of the samples by edge weight and its negatives by degree, independently for every draw.
Randomness is seeded by (seed, pass, meeting), so a recomputed task repeats its samples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopweave.functions.scalar import unit_vector
from loopweave.operators.contacts import degrees
from loopweave.plans.scan import block_of, dense_index
from loopweave.plans.vectors import items
from loopweave.session import materialize

NEGATIVE_POWER = 0.75
#: Beyond this the sigmoid counts as 0 or 1.
BOUND = 6.0


@dataclass(frozen=True)
class EmbedParams:
    """``samples`` edges are drawn in ``passes`` passes over all pairs of blocks (one pass for one block)."""

    dim: int = 100
    order: int = 2
    negative: int = 5
    samples: int = 1_000_000
    rho: float = 0.025
    seed: int = 1
    block_rows: int = 1 << 14
    batch: int = 128
    passes: int = 10

    def __post_init__(self) -> None:
        if self.order not in (1, 2):
            raise ValueError("order should be either 1 or 2")


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) fixed by the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def sample_edges(edges: DataFrame, expected: float, seed: int, step: int) -> DataFrame:
    """id1, id2, times: how often each edge is drawn when ``expected`` draws follow the weights.

    An edge's own fraction is rounded up or down at random, which keeps expectations exact
    without any table over all edges.
    """
    share = F.col("weight") * F.lit(expected) / edges.agg(F.sum("weight")).scalar()
    coin = uniform(F.col("id1"), F.col("id2"), F.lit(step), F.lit(seed))
    return edges.select("id1", "id2", F.floor(share + coin).alias("times")).filter("times > 0")


def negative_cells(vertices: DataFrame, cells: int) -> DataFrame:
    """cell, idx: ``cells`` cells shared out in proportion to degree ** 0.75.

    ``vertices(idx, degree)``. Running sums come from row blocks, not from one ordered task.
    """
    sized = dense_index(
        vertices.select("idx", F.pow("degree", F.lit(NEGATIVE_POWER)).alias("_w")), ["idx"], "_k"
    )
    summed = sized.agg(F.sum("_w")).scalar()
    ticks = sized.withColumn("_t", F.col("_w") * F.lit(float(cells)) / summed)
    upto = _running_sum(ticks, "_k", "_t")
    first = F.ceil(F.greatest(F.col("_before"), F.lit(0.0)))
    stop = F.least(F.ceil(F.col("_before") + F.col("_t")), F.lit(cells))
    return upto.filter(stop > first).select(
        F.explode(F.sequence(first, stop - 1)).alias("cell"), "idx"
    )


def _running_sum(df: DataFrame, order: str, value: str) -> DataFrame:
    rows = df.withColumn("_b", block_of(F.col(order)))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_b").agg(F.sum(value).alias("_s")).select(
        "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_off")
    )
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0.0)))
        .join(base, "_b")
        .withColumn("_before", F.col("_off") + F.col("_in"))
        .drop("_b", "_in", "_off")
    )


def initial_vectors(vertices: DataFrame, p: EmbedParams) -> DataFrame:
    """idx, emb ((u - 0.5) / dim), ctx (zeros)."""
    emb = [
        (uniform(F.col("idx"), F.lit(c), F.lit(p.seed)) - 0.5) / p.dim for c in range(p.dim)
    ]
    return vertices.select("idx", F.array(*emb).alias("emb"), F.array(*[F.lit(0.0)] * p.dim).alias("ctx"))


def rounds_of(blocks: int) -> list[list[int]]:
    """Per round the opponent of every block; the first round is each block with itself.

    The circle method: every pair of blocks meets once; with an odd number one block rests a round.
    """
    n = blocks + blocks % 2
    out = [list(range(blocks))]
    ring = list(range(n))
    for _ in range(n - 1 if blocks > 1 else 0):
        other = [0] * n
        for a, b in zip(ring[: n // 2], reversed(ring[n // 2 :])):
            other[a], other[b] = b, a
        out.append([b if b < blocks else a for a, b in enumerate(other[:blocks])])
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def train_meeting(
    emb: np.ndarray, ctx: np.ndarray, degree: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray],
    draws: int, first: int, p: EmbedParams, rng: np.random.Generator,
) -> None:
    """Train the vectors of one meeting in place; ``first`` samples were drawn before."""
    source, target, weight = edges
    by_weight = np.cumsum(weight)
    by_degree = np.cumsum(degree**NEGATIVE_POWER)
    onto = ctx if p.order == 2 else emb
    for start in range(0, draws, p.batch):
        size = min(p.batch, draws - start)
        rate = p.rho * max(1.0 - (first + start) / (p.samples + 1.0), 1e-4)
        picked = np.searchsorted(by_weight, rng.random(size) * by_weight[-1], "right").clip(max=len(weight) - 1)
        noise = np.searchsorted(by_degree, rng.random((size, p.negative)) * by_degree[-1], "right").clip(max=len(degree) - 1)
        u = source[picked]
        to = np.concatenate([target[picked][:, None], noise], axis=1)
        a, b = emb[u], onto[to]
        x = np.einsum("sd,skd->sk", a, b)
        y = np.zeros_like(x)
        y[:, 0] = 1.0
        sigmoid = np.where(x > BOUND, 1.0, np.where(x < -BOUND, 0.0, 1.0 / (1.0 + np.exp(-np.clip(x, -BOUND, BOUND)))))
        g = (y - sigmoid) * rate
        np.add.at(onto, to.ravel(), (g[:, :, None] * a[:, None, :]).reshape(-1, p.dim))
        np.add.at(emb, u, np.einsum("sk,skd->sd", g, b))


def embed(edges: DataFrame, p: EmbedParams) -> DataFrame:
    """idx, vec. ``edges(id1, id2, weight)`` are directed; an undirected graph has both rows.

    A vertex moves when it is drawn; the number of draws is ``samples``, whatever the graph's size.
    """
    edges = edges.select("id1", "id2", F.col("weight").cast("double")).filter("weight > 0")
    vertices = materialize(degrees(edges))
    blocks = max(1, -(-vertices.count() // p.block_rows))

    def block(col: str) -> Column:
        return F.pmod(F.xxhash64(F.col(col), F.lit(p.seed)), F.lit(blocks)).cast("int")

    edges = materialize(edges.withColumn("b1", block("id1")).withColumn("b2", block("id2")))
    total = edges.agg(F.sum("weight")).first()[0] or 0.0
    state = initial_vectors(vertices, p).join(vertices.select("idx", "degree"), "idx")
    state = materialize(state.withColumn("block", block("idx")))
    passes = 1 if blocks == 1 else p.passes
    per_pass = p.samples / passes
    for turn in range(passes):
        for number, opponents in enumerate(rounds_of(blocks)):
            state = materialize(_round(state, edges, opponents, number == 0, turn, per_pass, total, p))
    return state.select("idx", F.col("emb").alias("vec"))


def _round(state, edges, opponents: list[int], own: bool, turn: int, per_pass: float, total: float, p: EmbedParams) -> DataFrame:
    """All meetings of one round, each in a task of its own."""
    meeting = F.array(*[F.lit(min(a, b)) for a, b in enumerate(opponents)])
    here = edges.filter(F.col("b1") == F.col("b2")) if own else edges.filter(F.col("b1") != F.col("b2"))
    first, second = F.element_at(meeting, F.col("b1") + 1), F.element_at(meeting, F.col("b2") + 1)
    here = here.filter(first == second).select("id1", "id2", "weight", first.alias("meeting"))
    rows = state.withColumn("place", F.element_at(meeting, F.col("block") + 1))

    def run(key, vectors: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.drop(columns="place").sort_values("idx", ignore_index=True)
        if len(links) and len(vectors):
            links = links.sort_values(["id1", "id2", "weight"], ignore_index=True)
            rng = np.random.default_rng([p.seed, turn, own, *(int(k) for k in key)])
            at = pd.Index(vectors["idx"])
            weight = links["weight"].to_numpy()
            draws = int(per_pass * weight.sum() / total + rng.random())
            emb, ctx = np.stack(vectors["emb"]), np.stack(vectors["ctx"])
            ends = at.get_indexer(links["id1"]), at.get_indexer(links["id2"])
            train_meeting(emb, ctx, vectors["degree"].to_numpy(float), (*ends, weight), draws, int(turn * per_pass), p, rng)
            vectors = vectors.assign(emb=list(emb), ctx=list(ctx))
        return vectors

    kept = state.schema
    return rows.groupBy("place").cogroup(here.groupBy("meeting")).applyInPandas(run, kept)


def normalise(vectors: DataFrame) -> DataFrame:
    """Vectors of length 1; a zero vector becomes NaN."""
    return vectors.withColumn("vec", unit_vector(F.col("vec")))


def concatenate(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both embeddings normalised and appended; a node missing on the right gets NaN there."""
    width = right.agg(F.max(F.size("vec"))).first()[0]
    gap = F.array(*[F.lit(float("nan"))] * width)
    second = normalise(right).select("idx", F.col("vec").alias("_more"))
    return (
        normalise(left)
        .join(second, "idx", "left")
        .select("idx", F.concat("vec", F.coalesce("_more", gap)).alias("vec"))
    )


def with_positions(vectors: DataFrame, bins: DataFrame) -> DataFrame:
    """idx, chrom, pos and one column emb1..embN per dimension."""
    width = vectors.agg(F.max(F.size("vec"))).first()[0]
    named = [v.alias(f"emb{i + 1}") for i, v in enumerate(items("vec", width))]
    return vectors.join(bins.select("idx", "chrom", "pos"), "idx").select("idx", "chrom", "pos", *named)


def plane(vectors: DataFrame) -> DataFrame:
    """Two principal components per vector, for display: idx, x, y."""
    rows = vectors.select("idx", array_to_vector("vec").alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(rows)
    flat = vector_to_array("pc")
    return model.transform(rows).select("idx", flat[0].alias("x"), flat[1].alias("y"))
