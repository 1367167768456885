"""Gaussian mixtures and their combination with evidence from a graph."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.functions.gaussian import normal_log_density
from loopweave.operators.mprop import Links, propagate
from loopweave.plans.vectors import argmax, items, log_sum_exp
from loopweave.session import materialize


def fit_mixture(df: DataFrame, k: int, seed: int = 1, max_iter: int = 100, tol: float = 0.01):
    """Full-covariance EM: (fitted model, [(mean, covariance), ...])."""
    vectors = df.select(array_to_vector("features").alias("features")).cache()
    try:
        model = GaussianMixture(k=k, seed=seed, maxIter=max_iter, tol=tol).fit(vectors)
    finally:
        vectors.unpersist()
    params = [
        (np.asarray(g.mean.toArray()), np.asarray(g.cov.toArray()))
        for g in model.gaussians
    ]
    return model, params


def posterior(model, df: DataFrame, keep=("idx",)) -> DataFrame:
    """keep, post: responsibilities with the mixing weights."""
    scored = model.transform(df.select(*keep, array_to_vector("features").alias("features")))
    return scored.select(*keep, vector_to_array("probability").alias("post"))


def posterior_with_evidence(df: DataFrame, params, evidence: DataFrame, weight: float) -> DataFrame:
    """idx, post: densities without mixing weights times evidence ** (weight / (1 + weight)).

    ``evidence(idx, post)``. Its overall scale cancels in the row normalisation.
    """
    k = len(params)
    power = F.lit(weight / (1.0 + weight))
    scored = df.select("idx", normal_log_density("features", params).alias("_d"))
    joint = [
        dens + F.log(F.pow(ve, power) + F.lit(1e-250))
        for dens, ve in zip(items("_d", k), items("post", k))
    ]
    return (
        scored.join(evidence, "idx")
        .select("idx", F.array(*joint).alias("_j"))
        .withColumn("_z", log_sum_exp(items("_j", k)))
        .select("idx", F.array(*[F.exp(v - F.col("_z")) for v in items("_j", k)]).alias("post"))
    )


def mixture_with_propagation(
    df: DataFrame,
    edges: DataFrame,
    k: int,
    loops: int = 5,
    rounds: int = 5,
    weight: float = 1.0,
    seed: int = 1,
) -> DataFrame:
    """idx, post, label: a mixture fitted once, then ``loops`` inferences, each after the first
    taking the propagated posteriors of the one before as evidence. The graph is laid out once for all of them.
    """
    df = materialize(df.select("idx", "features"))
    model, params = fit_mixture(df, k, seed)
    post = materialize(posterior(model, df))
    links = Links(edges, post) if loops > 1 else None
    for _ in range(1, loops):
        smoothed = propagate(links, post, rounds=rounds)
        post = materialize(posterior_with_evidence(df, params, smoothed, weight))
    return post.withColumn("label", argmax(F.col("post")))
