"""Multi-label evaluation of node classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.plans.scan import dense_index
from loopweave.plans.topk import top_k


def split(nodes: DataFrame, key: str, portion: float, seed: int = 1) -> DataFrame:
    """Adds ``train``: the first portion * nodes + 1 of them in an order shuffled by hash."""
    shuffled = dense_index(nodes.withColumn("_h", F.xxhash64(key, F.lit(seed))), ["_h", key], "_i")
    first = F.floor(shuffled.agg(F.count("*")).scalar() * F.lit(portion)) + 1
    return shuffled.withColumn("train", F.col("_i") < first).drop("_h", "_i")


def label_rows(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """One instance per (node, label)."""
    return vectors.join(labels, "idx").select("idx", "label", "vec")


def candidates(labels: DataFrame) -> DataFrame:
    """n and the true labels of every node."""
    return labels.groupBy("idx").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("label")).alias("labels")
    )


def predicted_labels(truth: DataFrame, scored: DataFrame, tie: str = "label") -> DataFrame:
    """As many best-scored labels per node as it has true ones: idx, label.

    ``truth(idx, label)``; ``scored(idx, label, score)``.
    """
    wanted = truth.groupBy("idx").agg(F.count("*").alias("_n"))
    return top_k(
        scored.join(wanted, "idx"), ["idx"], [F.col("score").desc()], "_n", ["idx", tie]
    ).select("idx", "label")


def f1_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """macro_f1, micro_f1, n_tests, n_labels over truth(idx, label) and predicted(idx, label)."""
    flags = (
        truth.select("idx", "label", F.lit(1).alias("t"), F.lit(0).alias("p"))
        .unionByName(predicted.select("idx", "label", F.lit(0).alias("t"), F.lit(1).alias("p")))
        .groupBy("idx", "label")
        .agg(F.max("t").alias("t"), F.max("p").alias("p"))
    )
    t, p = F.col("t"), F.col("p")
    per_label = flags.groupBy("label").agg(
        F.sum(t * p).alias("tp"), F.sum(t * (1 - p)).alias("fn"), F.sum((1 - t) * p).alias("fp")
    )
    # 2PR / (P + R) = 2tp / (2tp + fp + fn), and 0 where there is no true positive.
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    f1 = F.when(tp == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn))
    return per_label.agg(
        F.avg(f1).alias("macro_f1"),
        (2 * F.sum(tp) / (2 * F.sum(tp) + F.sum(fp) + F.sum(fn))).alias("micro_f1"),
        F.count("*").alias("n_labels"),
    ).withColumn("n_tests", truth.agg(F.countDistinct("idx")).scalar())


def example_f1(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision and recall averaged over the examples, and their harmonic mean."""
    hits = predicted.join(truth, ["idx", "label"], "left_semi").groupBy("idx").agg(F.count("*").alias("h"))
    t = truth.groupBy("idx").agg(F.count("*").alias("t"))
    p = predicted.groupBy("idx").agg(F.count("*").alias("p"))
    h = F.coalesce("h", F.lit(0))
    return (
        t.join(p, "idx", "left")
        .join(hits, "idx", "left")
        .agg(
            F.avg(F.when(F.col("p") > 0, h / F.col("p")).otherwise(0.0)).alias("precision"),
            F.avg(h / F.col("t")).alias("recall"),
        )
        .withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(
            2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
        ))
    )


def mean_scores(runs: DataFrame) -> DataFrame:
    """Macro and micro F1 averaged over repeated runs."""
    return runs.agg(F.avg("macro_f1").alias("macro_f1"), F.avg("micro_f1").alias("micro_f1"))
