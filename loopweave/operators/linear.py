"""Regularised linear classification and regression.

Logistic models are Spark's own estimator, one against the rest. The dual machines are trained by
coordinate ascent over row partitions (``dual``). For squared losses in the primal one pass over the
data gives the objective and gradient of every class at once; Spark adds the per-partition sums and
the driver takes a quasi-Newton step on weights of size classes x features.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from loopweave.plans.scan import dense_index
from loopweave.session import bound_batches, materialize

# Solver names of the model file, by number -> (name, loss, penalty).
SOLVERS = {
    0: ("L2R_LR", "logistic", "l2"),
    1: ("L2R_L2LOSS_SVC_DUAL", "squared_hinge", "l2"),
    2: ("L2R_L2LOSS_SVC", "squared_hinge", "l2"),
    3: ("L2R_L1LOSS_SVC_DUAL", "hinge", "l2"),
    4: ("MCSVM_CS", "multiclass_hinge", "l2"),
    5: ("L1R_L2LOSS_SVC", "squared_hinge", "l1"),
    6: ("L1R_LR", "logistic", "l1"),
    7: ("L2R_LR_DUAL", "logistic", "l2"),
    11: ("L2R_L2LOSS_SVR", "squared_gap", "l2"),
    12: ("L2R_L2LOSS_SVR_DUAL", "squared_gap", "l2"),
    13: ("L2R_L1LOSS_SVR_DUAL", "gap", "l2"),
}
REGRESSION = {11, 12, 13}
PROBABILITY = {0, 6, 7}
#: Logistic models that Spark fits at a time.
FITS = 8
#: Solvers trained by dual coordinate ascent; the dual logistic model has the primal one's optimum.
DUAL = {1, 3, 4, 12, 13}


@dataclass(frozen=True)
class LinearParams:
    solver: int = 1
    C: float = 1.0
    eps: float = 1e-4
    p: float = 0.1
    bias: float = -1.0
    class_weights: Mapping[float, float] = field(default_factory=dict)
    max_iter: int = 200

    def problem(self) -> str | None:
        """All that is wrong with the parameters, or None."""
        known = ", ".join(map(str, SOLVERS))
        checks = {
            f"solver {self.solver} is none of {known}": self.solver in SOLVERS,
            f"the cost C is {self.C}, it has to be above 0": self.C > 0,
            f"the tolerance eps is {self.eps}, it has to be above 0": self.eps > 0,
            f"the tube width p is {self.p}, it may not be negative": self.p >= 0,
        }
        return "; ".join(text for text, good in checks.items() if not good) or None


@dataclass(frozen=True)
class LinearModel:
    solver: int
    labels: list[float]
    weights: np.ndarray  # one row per weight vector, the bias weight last if there is one
    features: int
    bias: float = -1.0

    @property
    def binary(self) -> bool:
        return len(self.labels) == 2 and self.solver != 4


def class_order(df: DataFrame, order: str | None = None) -> list[float]:
    """Labels by first appearance along ``order`` (else ascending); -1 before +1 is turned round."""
    first = F.min(order) if order else F.min("label")
    rows = df.groupBy("label").agg(first.alias("_f")).orderBy("_f", "label").collect()
    labels = [float(row.label) for row in rows]
    return [1.0, -1.0] if labels == [-1.0, 1.0] else labels


def _loss(kind: str, z: np.ndarray, y: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Squared loss and its derivative by the decision value z."""
    if kind == "squared_hinge":
        t, slope = np.maximum(0.0, 1.0 - y * z), -y
    else:
        t, slope = np.maximum(0.0, np.abs(z - y) - p), np.sign(z - y)
    return t * t, 2.0 * t * slope


def _batch_terms(index, value, label, w, labels, kind, p, costs):
    """Summed loss per weight vector and gradient (vectors x features) of one batch."""
    sizes = np.array([len(i) for i in index])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    cols = np.concatenate(index).astype(int) if len(rows) else np.zeros(0, int)
    vals = np.concatenate(value) if len(rows) else np.zeros(0)
    n, k = len(sizes), len(w)
    z = np.stack([np.bincount(rows, vals * w[j, cols], n) for j in range(k)], axis=1)
    if labels:
        y = np.where(label[:, None] == np.array(labels)[None, :k], 1.0, -1.0)
        cost = np.where(y > 0, costs[None, :k], 1.0 if k > 1 else costs[-1])
    else:
        y, cost = label[:, None], 1.0
    loss, slope = _loss(kind, z, y, p)
    slope = slope * cost
    grad = np.stack([np.bincount(cols, vals * slope[rows, j], w.shape[1]) for j in range(k)])
    return (loss * cost).sum(axis=0), grad


def _objective(data: DataFrame, labels, kind, penalty, params: LinearParams, shape) -> Callable:
    costs = np.array([params.class_weights.get(v, 1.0) for v in labels]) if labels else np.ones(1)

    def evaluate(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loss, grad = np.zeros(shape[0]), np.zeros(shape)
            for pdf in batches:
                more = _batch_terms(
                    pdf["index"].to_list(), pdf["value"].to_list(), pdf["label"].to_numpy(float),
                    w, labels, kind, params.p, costs,
                )
                loss, grad = loss + more[0], grad + more[1]
            flat = np.concatenate([loss, grad.ravel()])
            used = np.flatnonzero(flat)
            yield pd.DataFrame({"at": used, "v": flat[used]})

        sums = data.mapInPandas(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v"))
        flat = np.zeros(shape[0] + shape[0] * shape[1])
        for row in sums.collect():
            flat[row["at"]] = row["v"]
        loss = params.C * flat[: shape[0]]
        grad = params.C * flat[shape[0]:].reshape(shape)
        if penalty == "l2":
            loss, grad = loss + 0.5 * (w * w).sum(axis=1), grad + w
        return loss, grad

    return evaluate


def _minimise(evaluate, shape, l1: bool, stop: np.ndarray, max_iter: int) -> np.ndarray:
    """Limited-memory quasi-Newton descent, every weight vector with its own history.

    With ``l1`` the steps stay in the orthant of the pseudo-gradient (Andrew and Gao, ICML 2007).
    """
    rows = [slice(j, j + 1) for j in range(shape[0])]

    def full(w, f):
        return f + np.abs(w).sum(axis=1) if l1 else f

    def pseudo(w, g):
        if not l1:
            return g
        at_zero = np.sign(g) * np.maximum(np.abs(g) - 1.0, 0.0)
        return np.where(w != 0, g + np.sign(w), at_zero)

    w = np.zeros(shape)
    f, g = evaluate(w)
    f, pg = full(w, f), pseudo(w, g)
    first = [np.linalg.norm(pg[r]) for r in rows]
    memory: list[list] = [[] for _ in rows]
    done = [False] * len(rows)
    stuck = [False] * len(rows)
    for _ in range(max_iter):
        direction = np.zeros(shape)
        for j, r in enumerate(rows):
            done[j] = done[j] or np.linalg.norm(pg[r]) <= stop[j] * first[j]
            if done[j]:
                continue
            q, alphas = pg[r].ravel().copy(), []
            for s, y, rho in reversed(memory[j]):
                a = rho * s.dot(q)
                q -= a * y
                alphas.append(a)
            if memory[j]:
                s, y, _ = memory[j][-1]
                q *= s.dot(y) / y.dot(y)
            else:
                q /= max(np.linalg.norm(q), 1.0)
            for (s, y, rho), a in zip(memory[j], reversed(alphas)):
                q += s * (a - rho * y.dot(q))
            d = -q.reshape(pg[r].shape)
            direction[r] = np.where(d * pg[r] < 0, d, 0.0) if l1 else d
        if all(done):
            break
        step, active = np.ones(len(rows)), [not x for x in done]
        new_w, new_f, new_g = w.copy(), f.copy(), g.copy()
        for _ in range(30):
            trial = new_w.copy()
            for j, r in enumerate(rows):
                if active[j]:
                    moved = w[r] + step[j] * direction[r]
                    if l1:
                        side = np.where(w[r] != 0, np.sign(w[r]), -np.sign(pg[r]))
                        moved = np.where(moved * side > 0, moved, 0.0)
                    trial[r] = moved
            tf, tg = evaluate(trial)
            tf = full(trial, tf)
            for j, r in enumerate(rows):
                if not active[j]:
                    continue
                change = (pg[r] * (trial[r] - w[r])).sum()
                if tf[r].sum() <= f[r].sum() + 1e-4 * change:
                    new_w[r], new_f[r], new_g[r], active[j] = trial[r], tf[r], tg[r], False
                else:
                    step[j] *= 0.5
            if not any(active):
                break
        for j, r in enumerate(rows):
            if active[j]:
                done[j] = stuck[j] = True
                continue
            s, y = (new_w[r] - w[r]).ravel(), (new_g[r] - g[r]).ravel()
            if s.dot(y) > 1e-12 * max(y.dot(y), 1e-300):
                memory[j] = (memory[j] + [(s, y, 1.0 / s.dot(y))])[-10:]
        w, f, g = new_w, new_f, new_g
        pg = pseudo(w, g)
    open_ends = [j for j, r in enumerate(rows) if stuck[j] or np.linalg.norm(pg[r]) > stop[j] * first[j]]
    if open_ends:
        warnings.warn(f"weight vectors {open_ends} have not converged: raise max_iter or eps", RuntimeWarning, stacklevel=2)
    return w


def sparse_rows(df: DataFrame, bias: float = -1.0, features: str = "features", keep=("label",)) -> DataFrame:
    """index, value arrays of an array<double> column, 0-based, zeros left out."""
    pairs = F.filter(
        F.transform(features, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("v"))),
        lambda s: s["v"] != 0,
    )
    index = F.transform(pairs, lambda s: s["i"])
    value = F.transform(pairs, lambda s: s["v"])
    if bias >= 0:
        index = F.concat(index, F.array(F.size(features)))
        value = F.concat(value, F.array(F.lit(float(bias))))
    return df.select(*keep, index.alias("index"), value.alias("value"))


def _logistic(data: DataFrame, labels: list[float], k: int, params: LinearParams, width: int, l1: bool) -> np.ndarray:
    """Weight vectors of Spark's logistic regression, each label (the first only, of two) against the rest.

    Its loss is a weighted mean: a penalty of 1 over C times the summed weights makes the objectives equal.
    """
    as_vector = F.udf(lambda i, v: Vectors.sparse(width, sorted(zip(i, v))), VectorUDT())
    rows = materialize(data.select("label", as_vector("index", "value").alias("features")))

    def fitted(own: float) -> np.ndarray:
        rest = 1.0 if k > 1 else params.class_weights.get(labels[-1], 1.0)
        positive = F.col("label") == own
        weight = F.when(positive, params.class_weights.get(own, 1.0)).otherwise(rest)
        binary = rows.select(positive.cast("double").alias("label"), weight.alias("weight"), "features")
        total = binary.agg(F.sum("weight")).first()[0]
        estimator = LogisticRegression(
            regParam=1.0 / (params.C * total), elasticNetParam=float(l1), fitIntercept=False, standardization=False,
            tol=params.eps * 0.01, maxIter=params.max_iter, weightCol="weight",
        )
        return estimator.fit(binary).coefficients.toArray()

    with ThreadPoolExecutor(min(k, FITS)) as pool:
        return np.stack(list(pool.map(fitted, labels[:k])))


def train(
    df: DataFrame, params: LinearParams, features: int, labels: list[float] | None = None, order: str | None = None
) -> LinearModel:
    """Fit ``df(label, index, value)``; see ``sparse_rows``. ``features`` excludes the bias."""
    wrong = params.problem()
    if wrong:
        raise ValueError(wrong)
    bound_batches(df.sparkSession)
    name, kind, penalty = SOLVERS[params.solver]
    if params.solver in DUAL:
        from loopweave.operators.dual import fit_dual  # which builds on this module

        return fit_dual(df, params, features, labels, order).model
    keep = ["label", "index", "value"]
    data = materialize(df.select(F.col("label").cast("double").alias("label"), "index", "value"))
    width = features + (1 if params.bias >= 0 else 0)
    if params.solver in REGRESSION:
        evaluate = _objective(data.select(*keep), [], kind, penalty, params, (1, width))
        w = _minimise(evaluate, (1, width), False, np.array([params.eps]), params.max_iter)
        return LinearModel(params.solver, [], w, features, params.bias)
    labels = labels or class_order(df, order)
    counts = {float(r.label): r["n"] for r in data.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    k = len(labels) if len(labels) != 2 else 1
    # Rarer classes get a proportionally tighter tolerance.
    stop = np.array(
        [
            params.eps * max(min(counts.get(v, 0), rows - counts.get(v, 0)), 1) / rows
            for v in labels[:k]
        ]
    )
    if kind == "logistic":
        w = _logistic(data, labels, k, params, width, penalty == "l1")
        return LinearModel(params.solver, labels, w, features, params.bias)
    evaluate = _objective(data.select(*keep), labels, kind, penalty, params, (k, width))
    w = _minimise(evaluate, (k, width), penalty == "l1", stop, params.max_iter)
    return LinearModel(params.solver, labels, w, features, params.bias)


def decision_values(model: LinearModel, index: str = "index", value: str = "value") -> Column:
    """array<double> with one decision value per weight vector; unseen indices are ignored."""
    w = model.weights

    @F.pandas_udf(ArrayType(DoubleType()))
    def decide(i: pd.Series, v: pd.Series) -> pd.Series:
        if not len(i):
            return pd.Series([], dtype=object)
        rows = np.repeat(np.arange(len(i)), [len(c) for c in i])
        cols, vals = np.concatenate(list(i)).astype(int), np.concatenate(list(v)).astype(float)
        seen = cols < w.shape[1]
        rows, cols, vals = rows[seen], cols[seen], vals[seen]
        sums = np.stack([np.bincount(rows, vals * one[cols], len(i)) for one in w], axis=1)
        return pd.Series(list(sums))

    return decide(index, value)


def predict(df: DataFrame, model: LinearModel) -> DataFrame:
    """Adds decision (array), prediction and, for logistic models, probability per label."""
    scored = df.withColumn("decision", decision_values(model))
    top = F.col("decision")
    if not model.labels:
        return scored.withColumn("prediction", top[0])
    if model.binary:
        chosen = F.when(top[0] > 0, F.lit(model.labels[0])).otherwise(F.lit(model.labels[1]))
    else:
        names = F.array(*[F.lit(v) for v in model.labels])
        chosen = F.element_at(names, F.array_position(top, F.array_max(top)).cast("int"))
    scored = scored.withColumn("prediction", chosen)
    if model.solver in PROBABILITY:
        sigmoid = [1 / (1 + F.exp(-top[j])) for j in range(len(model.weights))]
        if model.binary:
            each = [sigmoid[0], 1 - sigmoid[0]]
        else:
            whole = sum(sigmoid[1:], sigmoid[0])
            each = [s / whole for s in sigmoid]
        scored = scored.withColumn("probability", F.array(*each))
    return scored


def folds(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """Adds fold 0..n-1 of equal size (+-1) in an order shuffled by a hash of the unique key."""
    shuffled = dense_index(df.withColumn("_h", F.xxhash64(key, F.lit(seed))), ["_h", key], "_i")
    rows = shuffled.agg(F.count("*")).scalar()
    # Fold f holds the rows from f * rows / n, rounded down, to the next such bound.
    fold = F.floor(((F.col("_i") + 1) * n - 1) / rows)
    return shuffled.withColumn("fold", fold.cast("bigint")).drop("_h", "_i")


def cross_validate(df: DataFrame, key: str, params: LinearParams, features: int, n: int, seed: int = 1) -> DataFrame:
    """key, label, prediction with every row predicted by a model that has not seen it."""
    n = min(n, df.count())
    parts = materialize(folds(df, key, n, seed))
    out = None
    for f in range(n):
        model = train(parts.filter(F.col("fold") != f), params, features)
        scored = predict(parts.filter(F.col("fold") == f), model).select(key, "label", "prediction")
        out = scored if out is None else out.unionByName(scored)
    return out


def scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy (percent), mse and squared correlation, one row."""
    y, v = F.col(label).cast("double"), F.col(prediction).cast("double")
    return df.agg(
        (F.avg((y == v).cast("double")) * 100).alias("accuracy"),
        F.avg((v - y) ** 2).alias("mse"),
        (F.corr(v, y) ** 2).alias("scc"),
    )
