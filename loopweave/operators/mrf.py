"""Markov random field over the contact graph: loopy belief propagation inside EM.

The edges are dealt into blocks of whole nodes; a round shuffles packed messages between blocks, and a
job makes several rounds (``plans/blocks.py``).

Graphs with larger hubs are kept by rows: a row (node, nbr) holds the last message that ``node`` got from
``nbr``; the answer to it needs the node's belief and this row only. Rows are laid out once, by node and parts
of its neighbours, and keep that layout from round to round. A round shuffles sums and beliefs of nodes and
the messages of the active frontier: only nodes that got a changed message send again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loopweave.functions.gaussian import normal_log_density
from loopweave.operators.mixture import fit_mixture, posterior
from loopweave.plans.blocks import MessageBlocks, unpack
from loopweave.plans.rounds import Rounds, bucketed, drop_bucketed, drop_kept
from loopweave.plans.vectors import argmax, items, log_sum_exp, sum_vector, total
from loopweave.session import shuffles_dropped

TINY = 1e-100
#: Neighbours of a node that are kept in one part.
PART = 1 << 16
#: Rounds of one job where the graph has few blocks; with more blocks a job makes fewer.
ROUNDS = 16
#: A message that moved by less than this in every state is not taken as changed.
STILL = 1e-12


def transition_counts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """label1, label2, n: summed edge weight between every two labels; edges laid out by ``id2`` are shuffled once."""
    first = labels.select(F.col("idx").alias("id1"), F.col("label").alias("label1"))
    second = labels.select(F.col("idx").alias("id2"), F.col("label").alias("label2"))
    return (
        edges.join(second, "id2")
        .join(first, "id1")
        .groupBy("label1", "label2")
        .agg(F.sum("weight").alias("n"))
    )


def edge_potential(edges: DataFrame, labels: DataFrame, k: int) -> np.ndarray:
    """Log transition matrix, normalised over all of its k * k cells."""
    counts = np.zeros((k, k))
    for row in transition_counts(edges, labels).collect():
        counts[int(row.label1), int(row.label2)] = row.n
    logs = np.log(counts + TINY)
    return logs - np.log(np.exp(logs - logs.max()).sum()) - logs.max()


def _send(potential: np.ndarray, belief: str, back: str) -> Column:
    """Message over an edge: for every state the log-sum over the sender's states."""
    k = len(potential)
    free = [b - m for b, m in zip(items(belief, k), items(back, k))]
    return F.array(
        *[log_sum_exp([F.lit(float(row[j])) + free[j] for j in range(k)]) for row in potential]
    )


def _scores(k: int) -> Column:
    """Log density plus the summed neighbour vector, zero for a node without neighbours."""
    return F.array(
        *[a + F.coalesce(b, F.lit(0.0)) for a, b in zip(items("phi", k), items("s", k))]
    )


class MessageRows:
    """node, part, nbr, back of every direction of every edge, laid out once by (node, part).

    A node's neighbours are dealt into parts of about ``most`` by hash; ``back`` is the part in which the
    neighbour keeps its row of the node.
    """

    def __init__(self, edges: DataFrame, most: int = PART):
        ends = edges.filter("id1 <> id2").select(F.col("id1").alias("node"), F.col("id2").alias("nbr"))
        steps = Rounds()
        both = steps.keep(ends.union(ends.select("nbr", "node")).distinct())
        parts = both.groupBy("node").agg(F.ceil(F.count("*") / F.lit(float(most))).alias("parts"))
        parts = steps.keep(parts)
        dealt = (
            both.join(parts, "node")
            .withColumn("part", F.pmod(F.xxhash64("nbr"), F.col("parts")))
            .drop("parts")
            .join(parts.withColumnRenamed("node", "nbr"), "nbr")
            .withColumn("back", F.pmod(F.xxhash64("node"), F.col("parts")))
        )
        self.rows = bucketed(dealt.select("node", "part", "nbr", "back"), "node", "part")
        drop_kept(both, parts)
        self.seats = steps.keep(self.rows.select("node", "part").distinct())

    def drop(self) -> None:
        drop_bucketed(self.rows)
        drop_kept(self.seats)


def _beliefs(unary: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """idx, belief, touched: whether the node got a changed message. Sums are made by part first."""
    parts = state.groupBy("node", "part").agg(sum_vector(F.col("got"), k).alias("s"), F.max("fresh").alias("touched"))
    sums = parts.groupBy(F.col("node").alias("idx")).agg(sum_vector(F.col("s"), k).alias("s"), F.max("touched").alias("touched"))
    return (
        unary.join(sums, "idx", "left")
        .select("idx", _scores(k).alias("_b"), F.coalesce("touched", F.lit(False)).alias("touched"))
        .withColumn("_z", log_sum_exp(items("_b", k)))
        .select("idx", F.array(*[b - F.col("_z") for b in items("_b", k)]).alias("belief"), "touched")
    )


def message_layout(edges: DataFrame, most: int = PART, nodes: int = 0) -> MessageBlocks | MessageRows:
    """Blocks of whole nodes, for scores of ``nodes`` nodes; rows where a node has more than ``most`` neighbours."""
    ends = edges.filter("id1 <> id2").select(F.col("id1").alias("node"), F.col("id2").alias("nbr"))
    both = Rounds().keep(ends.union(ends.select("nbr", "node")).distinct())
    n, top = both.groupBy("node").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    rows = MessageRows(edges, most) if (top or 0) > most else MessageBlocks(both, n or 0, nodes)
    drop_kept(both)
    return rows


def _block_beliefs(blocks: MessageBlocks, unary: DataFrame, potential: np.ndarray, max_iter: int, tol: float) -> DataFrame:
    """idx, belief, by jobs of several rounds; the beliefs of the round that ends it are kept by its job.

    The state of a job goes once that of the next is stored.
    """
    k, last, step = len(potential), None, 0
    seats, state, kept = blocks.seats(unary, k), blocks.start(unary.sparkSession), []
    batch = max(1, ROUNDS // blocks.count)
    found = None
    while found is None:
        upto = min(step + batch, max_iter)
        for n in range(step, upto):
            state = blocks.round(seats, state, potential, n)
        state = Rounds().keep(state)
        drop_kept(*kept)
        kept = [state]
        settled = state.filter(F.col("kind") == "belief").groupBy("step").agg(F.sum("total").alias("s"), F.sum("n").alias("n"))
        rows = settled.orderBy("step").collect()
        for row in rows:
            mean = row.s / max(row.n, 1)
            if row.step + 1 == max_iter or last is not None and abs(mean - last) < tol:
                found = row.step
                break
            last = mean
        if not rows:  # no round is asked for, or no node has scores
            found = step
        step = upto
        state = state.filter(F.col("kind") != "belief")
    found = Rounds().keep(unpack(kept[0], found, k))
    drop_kept(*kept)
    drop_bucketed(seats)
    return found


def loopy_beliefs(
    edges: DataFrame | MessageRows | MessageBlocks,
    unary: DataFrame,
    potential: np.ndarray,
    max_iter: int = 100,
    tol: float = 1e-2,
    still: float = STILL,
) -> DataFrame:
    """idx, belief (log, normalised per node), label.

    ``edges(id1, id2)`` hold each undirected edge once or in both directions; ``unary(idx, phi)``
    are log densities. Stops when the mean over the nodes of their summed beliefs moves by less than
    ``tol``, or, in the layout by rows, when no message moved by more than ``still``.
    """
    given = isinstance(edges, (MessageRows, MessageBlocks))
    with shuffles_dropped(unary.sparkSession):
        unary = Rounds().keep(unary.select("idx", "phi"))
        rows = edges if given else message_layout(edges, nodes=unary.count())
        if isinstance(rows, MessageBlocks):
            found = _block_beliefs(rows, unary, potential, max_iter, tol)
        else:
            found = _row_beliefs(rows, unary, potential, max_iter, tol, still)
        drop_kept(unary)
        if not given:
            rows.drop()
    out = found.withColumn("label", argmax(F.col("belief")))
    out.kept = found.kept
    return out


def _row_beliefs(rows: MessageRows, unary: DataFrame, potential: np.ndarray, max_iter: int, tol: float, still: float) -> DataFrame:
    """idx, belief in the layout by rows."""
    k = len(potential)
    zero = F.array(*[F.lit(0.0)] * k)
    state = first = rows.rows.withColumn("got", zero).withColumn("fresh", F.lit(True))
    last = None
    for step in range(max_iter):
        beliefs = _beliefs(unary, state, k)
        if step + 1 == max_iter:
            break
        seen = Observation()
        watched = beliefs.observe(
            seen,
            F.count("*").alias("n"),
            F.sum(total(items("belief", k))).alias("s"),
            F.max(F.col("touched").cast("int")).alias("active"),
        )
        senders = watched.filter("touched").withColumnRenamed("idx", "node").join(rows.seats, "node")
        sent = state.join(senders.select("node", "part", "belief"), ["node", "part"]).select(
            F.col("nbr").alias("node"),
            F.col("back").alias("part"),
            F.col("node").alias("nbr"),
            _send(potential, "belief", "got").alias("sent"),
        )
        moved = F.greatest(*[F.abs(a - b) for a, b in zip(items("sent", k), items("got", k))], F.lit(0.0)) > still
        arrived = state.drop("fresh").join(sent, ["node", "part", "nbr"], "left").withColumn("fresh", F.coalesce(moved, F.lit(False)))
        following = bucketed(
            arrived.select("node", "part", "nbr", "back", F.when(F.col("fresh"), F.col("sent")).otherwise(F.col("got")).alias("got"), "fresh"),
            "node", "part", dealt=True,
        )
        settled = seen.get
        mean = (settled["s"] or 0.0) / max(settled["n"], 1)
        if not settled["active"] or last is not None and abs(mean - last) < tol:
            drop_bucketed(following)
            break
        if step:
            previous = state
            state = following
            drop_bucketed(previous)
        else:
            state = following
        last = mean
    found = Rounds().keep(beliefs.select("idx", "belief"))
    if state is not first:
        drop_bucketed(state)
    return found


def _label_gaussians(labelled: DataFrame, k: int, width: int) -> list:
    """Mean and sample covariance per label; None where a label has fewer than two nodes."""
    x = F.col("features")
    aggs = [F.avg(x[i]).alias(f"m{i}") for i in range(width)]
    aggs += [
        F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(width) for j in range(i, width)
    ]
    params: list = [None] * k
    for row in labelled.groupBy("label").agg(F.count("*").alias("n"), *aggs).collect():
        if row.n < 2:
            continue
        cov = np.zeros((width, width))
        for i in range(width):
            for j in range(i, width):
                cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
        params[int(row.label)] = (np.array([row[f"m{i}"] for i in range(width)]), cov)
    return params


def fit_random_field(
    features: DataFrame,
    edges: DataFrame,
    k: int = 10,
    em_iter: int = 10,
    lbp_iter: int = 100,
    tol: float = 1e-2,
    seed: int = 1,
    params: list | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """idx, label after EM; starts from a Gaussian mixture unless ``params`` and ``labels`` are given.

    As in the model this rebuilds, the scores of the E-step are normalised per state over all
    nodes, not per node over the states.
    """
    with shuffles_dropped(features.sparkSession):
        steps = Rounds()
        features = steps.keep(features.select("idx", "features"))
        edges = bucketed(edges.select("id1", "id2", "weight"), "id2")
        rows = message_layout(edges, nodes=features.count())
        width = len(features.select("features").first()[0])
        if params is None:
            model, params = fit_mixture(features, k, seed)
            labels = posterior(model, features).select("idx", argmax(F.col("post")).alias("label"))
        potential = edge_potential(edges, labels, k)
        previous = None
        for _ in range(em_iter):
            unary = steps.keep(features.select("idx", normal_log_density("features", params).alias("phi")))
            beliefs = loopy_beliefs(rows, unary, potential, lbp_iter, tol)
            # Every neighbour adds the potential row of its label, weighted by the edge.
            pulls = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in potential])
            pulled = (
                edges.join(beliefs.select(F.col("idx").alias("id2"), "label"), "id2")
                .withColumn("_r", pulls[F.col("label").cast("int")])
                .withColumn("_x", F.array(*[v * F.col("weight") for v in items("_r", k)]))
                .groupBy(F.col("id1").alias("idx"))
                .agg(sum_vector(F.col("_x"), k).alias("s"))
            )
            scores = steps.keep(unary.join(pulled, "idx", "left").select("idx", _scores(k).alias("score")))
            tops = scores.agg(*[F.max(F.col("score")[i]).alias(f"t{i}") for i in range(k)]).first()
            sums = scores.agg(
                *[F.sum(F.exp(F.col("score")[i] - F.lit(tops[i]))).alias(f"s{i}") for i in range(k)]
            ).first()
            norm = [float(tops[i] + math.log(sums[i])) for i in range(k)]
            label = argmax(F.array(*[s - F.lit(n) for s, n in zip(items("score", k), norm)]))
            current = steps.keep(scores.select("idx", label.alias("label")))
            params = _label_gaussians(features.join(current, "idx"), k, width)
            potential = edge_potential(edges, current, k)
            changed = True
            if previous is not None:
                changed = (
                    current.join(previous.toDF("idx", "old"), "idx").filter("label <> old").limit(1).count()
                )
                drop_kept(previous)
            # What a step stored goes before the next stores its own.
            drop_kept(unary, beliefs, scores)
            if not changed:
                break
            previous = current
        rows.drop()
        drop_bucketed(edges)
        drop_kept(features)
        return current
