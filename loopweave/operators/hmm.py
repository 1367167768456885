"""Gaussian hidden Markov model over runs of consecutive bins, split into blocks.

A chain may be as long as a chromosome, so it is cut into blocks of ``block`` bins. A block of
a longer chain reduces to one K x K matrix; the matrices of a chain, one per block, are scanned
in order to give every block the state distribution at its borders, and the blocks then work
on their own. This is the associative-scan form of forward-backward and Viterbi; results equal
the sequential ones. Chains of a single block need no scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.functions.gaussian import log_densities
from loopweave.session import bound_batches, materialize

BLOCK = 4096


@dataclass
class HmmParams:
    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    covs: np.ndarray

    @property
    def pairs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return list(zip(self.means, self.covs))


def _lse(a: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(a, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    out = np.log(np.sum(np.exp(a - top), axis=axis, keepdims=True)) + top
    return out.reshape(()) if axis is None else np.squeeze(out, axis=axis)


def pack_chains(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """chain, b, blocks (of the chain), idx and flattened features, one row per block.

    ``df(chain, n, t, idx, features)``; t counts from 0 to n - 1. A block holds at most
    ``block`` bins.
    """
    bound_batches(df.sparkSession)
    rows = df.withColumn("b", F.floor(F.col("t") / block).cast("bigint"))
    items = F.array_sort(F.collect_list(F.struct("t", "idx", "features")))
    return materialize(
        rows.groupBy("chain", "b")
        .agg(items.alias("i"), F.ceil(F.max("n") / block).alias("blocks"))
        .select(
            "chain",
            "b",
            "blocks",
            F.transform("i", lambda s: s["idx"]).alias("idx"),
            F.flatten(F.transform("i", lambda s: s["features"])).alias("x"),
        )
    )


def _block_matrix(logp: np.ndarray, log_trans: np.ndarray, combine) -> np.ndarray:
    """K x K: entry state at the first bin of a block to state at its last bin."""
    k = logp.shape[1]
    m = np.full((k, k), -np.inf)
    np.fill_diagonal(m, logp[0])
    for row in logp[1:]:
        m = combine(m[:, :, None] + log_trans[None, :, :], 1) + row[None, :]
    return m


def _summaries(blocks: DataFrame, p: HmmParams, viterbi: bool) -> DataFrame:
    pairs, log_trans = p.pairs, np.log(p.trans + 1e-300)
    combine = (lambda a, ax: a.max(axis=ax)) if viterbi else (lambda a, ax: _lse(a, ax))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mats = [
                _block_matrix(log_densities(np.reshape(x, (len(i), -1)), pairs), log_trans, combine).ravel()
                for i, x in zip(pdf["idx"], pdf["x"])
            ]
            yield pd.DataFrame({"chain": pdf["chain"], "b": pdf["b"], "m": mats})

    cut = blocks.filter("blocks > 1")
    return cut.select("chain", "b", "idx", "x").mapInPandas(run, "chain bigint, b bigint, m array<double>")


def _border_messages(summaries: DataFrame, p: HmmParams) -> DataFrame:
    """chain, b, before (log distribution at the previous block's end, empty for the first),
    after (log backward message at the block's end).
    """
    k = len(p.start)
    log_start, log_trans = np.log(p.start + 1e-300), np.log(p.trans + 1e-300)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        mats = [np.reshape(m, (k, k)) for m in pdf["m"]]
        before, state = [], None
        for m in mats:
            before.append([] if state is None else state)
            entry = log_start if state is None else _lse(state[:, None] + log_trans, 0)
            state = _lse(entry[:, None] + m, 0)
        after = [np.zeros(k)]
        for m in reversed(mats[1:]):
            after.append(_lse(log_trans + _lse(m + after[-1][None, :], 1)[None, :], 1))
        return pd.DataFrame(
            {"chain": pdf["chain"], "b": pdf["b"], "before": before, "after": list(reversed(after))}
        )

    return summaries.groupBy("chain").applyInPandas(
        scan, "chain bigint, b bigint, before array<double>, after array<double>"
    )


def _posteriors(logp, before, after, p: HmmParams):
    """gamma (n x K), summed transition posteriors (K x K) and the chain's log likelihood."""
    log_trans = np.log(p.trans + 1e-300)
    n, k = logp.shape
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    first = len(before) == 0
    alpha[0] = logp[0] + (np.log(p.start + 1e-300) if first else _lse(np.asarray(before)[:, None] + log_trans, 0))
    for t in range(1, n):
        alpha[t] = logp[t] + _lse(alpha[t - 1][:, None] + log_trans, 0)
    beta[-1] = after
    for t in range(n - 2, -1, -1):
        beta[t] = _lse(log_trans + (logp[t + 1] + beta[t + 1])[None, :], 1)
    total = _lse(alpha[-1] + beta[-1])
    gamma = np.exp(alpha + beta - total)
    left = alpha[:-1] if first else np.vstack([np.asarray(before)[None, :], alpha[:-1]])
    right = (logp + beta)[1:] if first else logp + beta
    xi = np.zeros((k, k))
    if len(left):
        xi = np.exp(left[:, :, None] + log_trans[None] + right[:, None, :] - total).sum(axis=0)
    return gamma, xi, float(total)


def _expected_counts(blocks: DataFrame, borders: DataFrame, p: HmmParams) -> tuple[np.ndarray, float]:
    """Sufficient statistics of the E-step, summed by Spark; their size depends on K and D only."""
    pairs, k = p.pairs, len(p.start)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for i, x, before, after in zip(pdf["idx"], pdf["x"], pdf["before"], pdf["after"]):
                data = np.reshape(x, (len(i), -1))
                before = [] if before is None else before
                after = np.zeros(k) if after is None else after
                gamma, xi, loglik = _posteriors(log_densities(data, pairs), before, after, p)
                second = np.einsum("nk,ni,nj->kij", gamma, data, data)
                first_block = len(before) == 0
                own = gamma[0] if first_block else np.zeros(k)
                ll = loglik if first_block else 0.0
                flat = np.concatenate(
                    [own, xi.ravel(), gamma.sum(axis=0), (gamma.T @ data).ravel(), second.ravel(), [ll]]
                )
                total = flat if total is None else total + flat
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "v": total})

    rows = blocks.join(borders, ["chain", "b"], "left").select("idx", "x", "before", "after")
    parts = rows.mapInPandas(run, "at bigint, v double")
    sums = parts.groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    flat = np.array([row.v for row in sums])
    return flat[:-1], float(flat[-1])


def _update(stats: np.ndarray, k: int, dim: int, floor: float) -> HmmParams:
    cuts = np.cumsum([k, k * k, k, k * dim])
    start, xi, weight, first, second = np.split(stats, cuts)
    xi, first, second = xi.reshape(k, k), first.reshape(k, dim), second.reshape(k, dim, dim)
    safe = np.maximum(weight, 1e-300)
    means = first / safe[:, None]
    covs = second / safe[:, None, None] - means[:, :, None] * means[:, None, :]
    covs = covs + floor * np.eye(dim)
    rows = xi.sum(axis=1, keepdims=True)
    trans = np.where(rows > 0, xi / np.maximum(rows, 1e-300), 1.0 / k)
    return HmmParams(start / start.sum(), trans, means, covs)


def initial_params(df: DataFrame, k: int, seed: int = 1, floor: float = 1e-3, kmeans_iter: int = 20) -> HmmParams:
    """Means by k-means, one shared covariance, even start and transition probabilities."""
    vectors = df.select(array_to_vector("features").alias("features"))
    centres = np.array(KMeans(k=k, seed=seed, maxIter=kmeans_iter).fit(vectors).clusterCenters())
    dim = centres.shape[1]
    x = F.col("features")
    row = df.agg(*[F.covar_samp(x[i], x[j]) for i in range(dim) for j in range(dim)]).first()
    cov = np.array(row, dtype=float).reshape(dim, dim) + floor * np.eye(dim)
    return HmmParams(np.full(k, 1 / k), np.full((k, k), 1 / k), centres, np.repeat(cov[None], k, axis=0))


def fit_hmm(
    blocks: DataFrame, params: HmmParams, max_iter: int = 10, tol: float = 1e-2, floor: float = 1e-3
) -> tuple[HmmParams, list[float]]:
    """Baum-Welch on packed chains: (parameters, log likelihood before every update)."""
    k, dim = params.means.shape
    history: list[float] = []
    for _ in range(max_iter):
        borders = _border_messages(_summaries(blocks, params, viterbi=False), params)
        stats, loglik = _expected_counts(blocks, borders, params)
        history.append(loglik)
        params = _update(stats, k, dim, floor)
        if len(history) > 1 and history[-1] - history[-2] < tol:
            break
    return params, history


def decode(blocks: DataFrame, p: HmmParams) -> DataFrame:
    """idx, label: the most probable state path of every chain."""
    k, pairs = len(p.start), p.pairs
    log_start, log_trans = np.log(p.start + 1e-300), np.log(p.trans + 1e-300)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        back, score = [], None
        for m in (np.reshape(m, (k, k)) for m in pdf["m"]):
            if score is None:
                score = np.max(log_start[:, None] + m, axis=0)
                back.append(None)
            else:
                step = np.max(log_trans[:, :, None] + m[None], axis=1)
                through = score[:, None] + step
                back.append(through.argmax(axis=0))
                score = through.max(axis=0)
        last, ends, starts = int(score.argmax()), [], []
        for pointer in reversed(back):
            ends.append(last)
            last = -1 if pointer is None else int(pointer[last])
            starts.append(last)
        return pd.DataFrame(
            {"chain": pdf["chain"], "b": pdf["b"], "prev": starts[::-1], "last": ends[::-1]}
        )

    borders = (
        _summaries(blocks, p, viterbi=True)
        .groupBy("chain")
        .applyInPandas(scan, "chain bigint, b bigint, prev bigint, last bigint")
    )

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for idx, x, prev, last in zip(pdf["idx"], pdf["x"], pdf["prev"], pdf["last"]):
                logp = log_densities(np.reshape(x, (len(idx), -1)), pairs)
                score = logp[0] + (log_trans[int(prev)] if prev >= 0 else log_start)
                back = np.zeros(logp.shape, dtype=int)
                for t in range(1, len(logp)):
                    step = score[:, None] + log_trans
                    back[t] = step.argmax(axis=0)
                    score = step.max(axis=0) + logp[t]
                path = np.empty(len(logp), dtype=int)
                path[-1] = int(last) if last >= 0 else int(score.argmax())
                for t in range(len(logp) - 1, 0, -1):
                    path[t - 1] = back[t, path[t]]
                out.append(pd.DataFrame({"idx": idx, "label": path}))
            if out:
                yield pd.concat(out)

    rows = blocks.join(borders, ["chain", "b"], "left").select("idx", "x", "prev", "last")
    return rows.na.fill(-1, ["prev", "last"]).mapInPandas(trace, "idx bigint, label bigint")
