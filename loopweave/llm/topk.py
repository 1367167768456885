"""Exact top-k by inner product with block-at-a-time pruning.

Vectors of whole numbers are dealt into segments of bounded size: by the best of a few pivot
vectors, and by a hash within one pivot, so that one crowded direction fills many segments. Inside
a segment, rows with the same leading term stand together and are cut into blocks; a block keeps
every term's maximum and minimum and its rows as a forward index.

A query first searches the segment it lies in, which gives a good k-th score. Summed term maxima of
whole segments then rule most other segments out before anything is shuffled. In the remaining ones
the query takes the blocks in the order of their summed term maxima and scores them through the
forward index until the next bound is below its k-th score. Bounds are exact, so results are too.

Pivots are the ``PIVOTS`` rows with the smallest hash; they steer the layout and no result.

Defined cases: vectors that are null or hold null, NaN or infinite components, and rows with a null
id, take no part. Shorter vectors count as padded with zeros; an empty vector scores 0. Repeated
rows are candidates each; a repeated query (same id and vector) is asked once, and rows that share a
query's id are its own. Sums beyond 64 bits wrap around.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopweave.llm.common import stored

PIVOTS = 64
SEGMENT_ROWS = 8192
BLOCK_ROWS = 128
CHUNK_QUERIES = 8192
EXACT = float(1 << 52)


def floor_terms(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component, as whole numbers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact(x: np.ndarray, most: float, width: int) -> np.ndarray:
    """Doubles while every sum of products stays exact in them, else whole numbers."""
    return x.astype(np.float64) if most * most * max(width, 1) < EXACT else x


class Best:
    """The k best (score, vec_id) of every query so far."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(queries)]

    def kth(self, q: int) -> float:
        own = self.found[q]
        return max(float(self.floor[q]), float(own[-1][0]) if len(own) == self.k else -np.inf)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.kth(q))
        if len(good) > self.k:
            good = good[np.lexsort((ids[good], -scores[good]))[: self.k]]
        merged = self.found[q] + [(int(scores[i]), int(ids[i])) for i in good]
        merged.sort(key=lambda p: (-p[0], p[1]))
        self.found[q] = merged[: self.k]


def search(ids: np.ndarray, rows: list, query_ids: np.ndarray, queries: list, floor: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """The k best rows of one segment for every query, block by block."""
    width = max([len(v) for v in rows] + [len(v) for v in queries] + [1])
    x, q = _matrix(rows, width), _matrix(queries, width)
    lead = np.abs(x).argmax(axis=1)
    order = np.lexsort((x[np.arange(len(x)), lead], lead))
    x, ids = x[order], ids[order]
    most = float(max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)))
    x, q = _exact(x, most, width), _exact(q, most, width)
    starts = np.arange(0, len(x), BLOCK_ROWS)
    high = np.maximum.reduceat(x, starts, axis=0)
    low = np.minimum.reduceat(x, starts, axis=0)
    if x.dtype == np.float64:
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    else:
        bounds = np.full((len(q), len(starts)), np.inf)
    turns = np.argsort(-bounds, axis=1, kind="stable")
    best = Best(len(q), k, floor)
    waiting = np.arange(len(q))
    for turn in range(len(starts)):
        waiting = np.array([i for i in waiting if bounds[i, turns[i, turn]] >= best.kth(i)], dtype=int)
        if not len(waiting):
            break
        for block in np.unique(turns[waiting, turn]):
            asked = waiting[turns[waiting, turn] == block]
            part = slice(starts[block], starts[block] + BLOCK_ROWS)
            scores = q[asked] @ x[part].T
            for i, row in zip(asked, scores):
                other = ids[part] != query_ids[i]
                best.offer(i, row[other], ids[part][other])
    return best.found


RESULT = "query_id long, mark long, vec_id long, score long"


def _table(query_ids, marks, found) -> pd.DataFrame:
    lines = [(q, m, v, s) for q, m, own in zip(query_ids, marks, found) for s, v in own]
    return pd.DataFrame(lines, columns=["query_id", "mark", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, k: int, every: int, segment_rows: int = SEGMENT_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors(vec_id, terms array<long>)``; queries: vec_id divisible by ``every``."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "terms").dropna(subset=["vec_id", "terms"])
    base = base.withColumn("mark", F.xxhash64("terms"))
    pivots = [np.array(r[0], dtype=float) for r in base.orderBy(F.xxhash64("vec_id", "mark")).limit(PIVOTS).select("terms").collect()]
    width = max([len(p) for p in pivots] + [1])
    axes = np.zeros((max(len(pivots), 1), width))
    for i, p in enumerate(pivots):
        axes[i, : len(p)] = p / max(np.linalg.norm(p), 1e-9)

    def home(batches):
        for pdf in batches:
            near = np.zeros((len(pdf), width))
            for i, v in enumerate(pdf["terms"]):
                near[i, : min(len(v), width)] = v[:width]
            yield pdf.assign(home=(near @ axes.T).argmax(axis=1).astype("int32"))

    placed = stored(base.mapInPandas(home, "vec_id long, terms array<long>, mark long, home int"), "topk-placed")
    first, offsets = 0, []
    for row in sorted(placed.groupBy("home").count().collect()):
        parts = -(-row["count"] // segment_rows)
        offsets.append((row["home"], first, parts))
        first += parts
    at = F.lit(0)
    for h, start, parts in offsets:
        at = F.when(F.col("home") == h, F.lit(start) + F.pmod(F.xxhash64("vec_id", "mark"), F.lit(parts))).otherwise(at)
    rows = placed.select("vec_id", "terms", "mark", at.cast("int").alias("seg"))
    asks = F.col("vec_id") % every == 0

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf[pdf["vec_id"] % every == 0].drop_duplicates(["vec_id", "mark"])
        found = search(
            pdf["vec_id"].to_numpy(), list(pdf["terms"]), asked["vec_id"].to_numpy(), list(asked["terms"]), np.full(len(asked), -np.inf), k
        )
        return _table(asked["vec_id"], asked["mark"], found)

    near = stored(rows.groupBy("seg").applyInPandas(at_home, RESULT), "topk-home")
    floors = near.groupBy("query_id", "mark").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    queries = rows.filter(asks).dropDuplicates(["vec_id", "mark"]).withColumnRenamed("vec_id", "query_id")
    queries = queries.join(floors, ["query_id", "mark"], "left")

    terms = rows.select("seg", F.posexplode("terms").alias("term", "x")).groupBy("seg", "term").agg(F.max("x").alias("hi"), F.min("x").alias("lo"))
    # Within a segment a shorter vector counts as zero at its missing terms.
    bounds = terms.groupBy("seg").agg(
        F.sort_array(F.collect_list(F.struct("term", F.greatest("hi", F.lit(0)).alias("hi"), F.least("lo", F.lit(0)).alias("lo")))).alias("b")
    )
    asked = queries.select("query_id", "mark", "terms", "floor", F.col("seg").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(max(first - 1, 0)))).alias("seg"))
    pair = F.arrays_zip(F.col("terms").alias("q"), F.col("b").alias("b"))
    most = F.aggregate(
        pair,
        F.lit(0.0),
        lambda s, p: s + F.coalesce(F.greatest(p["q"] * p["b"]["hi"], p["q"] * p["b"]["lo"]).cast("double"), F.lit(0.0)),
    )
    left = (
        asked.filter("seg <> own")
        .join(bounds, "seg", "left")
        .withColumn("most", F.coalesce(most, F.lit(0.0)))
        .filter(F.col("floor").isNull() | (F.col("most") * (1 + 1e-9) + 1 >= F.col("floor")))
        .select("query_id", "mark", "floor", "seg", F.col("terms").alias("q"))
    )
    chunks = max(1, -(-queries.count() // chunk_queries))
    left = stored(left.withColumn("chunk", F.pmod(F.xxhash64("query_id", "mark"), F.lit(chunks)).cast("int")), "topk-open")
    open_parts = left.select(F.col("seg").alias("in_seg"), F.col("chunk").alias("part")).distinct()
    sides = rows.join(open_parts, F.col("seg") == F.col("in_seg")).select("vec_id", "terms", "in_seg", "part")

    def elsewhere(_key, pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(asked):
            return _table([], [], [])
        floor = asked["floor"].astype(float).fillna(-np.inf).to_numpy()
        found = search(pdf["vec_id"].to_numpy(), list(pdf["terms"]), asked["query_id"].to_numpy(), list(asked["q"]), floor, k)
        return _table(asked["query_id"], asked["mark"], found)

    far = sides.groupBy("in_seg", "part").cogroup(left.groupBy("seg", "chunk")).applyInPandas(elsewhere, RESULT)
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return near.union(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
