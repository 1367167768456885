"""Linear machines trained in the dual: one variable per row and class.

Of the machines with one variable per row and weight vector (all but the joint one), those whose second
derivatives fit (``MOST_CURVATURE``) are trained by the augmented Lagrangian method with semismooth Newton
steps (Li, Sun and Toh, SIAM J. Optimization 2018). The variables of a row follow from the primal vectors
of the outer steps, so that nothing is stored for a row, and a pass over the rows sums values, gradients
and second derivatives in batches. The number of passes does not grow with the rows or their parts.

The joint machine and wide ones are trained by coordinate ascent inside parts. Rows are dealt into parts of about ``part_rows`` and laid out once by part; the dual variables lie
beside them in the same layout, so that a round shuffles neither. In a round every part makes a few
passes of exact coordinate steps over its own variables, skipping rows that have settled at a bound,
and sends how far it moved the primal vectors; the moves of all parts are summed and added. Parts
weigh their own moves by the number of parts, which makes the sum a safe step (adding variant of
communication-efficient dual ascent: Ma, Smith, Jaggi, Jordan, Richtarik and Takac, ICML 2015). With
one part this is plain dual coordinate descent (Hsieh, Chang, Lin, Keerthi and Sundararajan, ICML 2008).
More parts take more rounds, the more the less the parts' rows are alike.

Primal and dual value of a round belong to the same variables, so their difference bounds how far
either is from the optimum, whatever the number of rounds.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopweave.operators.linear import DUAL, REGRESSION, SOLVERS, LinearModel, LinearParams, class_order, decision_values
from loopweave.plans.rounds import Rounds, bucketed, drop_bucketed
from loopweave.plans.vectors import items, sum_vector
from loopweave.session import bound_batches

PART_ROWS = 1 << 13
#: Passes over a part in one round.
PASSES = 20
#: Second derivatives, vectors x weights x weights, that every task sums and the driver solves.
MOST_CURVATURE = 1 << 22
#: Lengths of a Newton step that one pass tries.
LENGTHS = 0.5 ** np.arange(12)
#: How often an outer step may ask for an inner one.
MOST_INNER = 50
#: Primal vectors are held by every task: classes x features at most.
MOST_WEIGHTS = 1 << 24
STATE = "part bigint, kind string, row bigint, v array<double>"


@dataclass(frozen=True)
class DualFit:
    model: LinearModel
    #: row, alpha: the variables of every row, one per weight vector; ``data`` holds the rows of the same numbers.
    duals: DataFrame
    data: DataFrame
    #: Per weight vector: primal value minus dual value at the end, and the primal value.
    gap: np.ndarray
    primal: np.ndarray
    rounds: int


@dataclass(frozen=True)
class _Task:
    """What a part needs to know of the problem."""

    kind: str
    labels: tuple[float, ...]
    vectors: int
    cost: float
    weights: dict[float, float]
    tube: float
    parts: int
    passes: int

    def targets(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row and weight vector: target, upper bound of the variable, curvature of its loss."""
        if not self.labels:
            y = label[:, None]
            cost = np.full(y.shape, self.cost)
        else:
            y = np.where(label[:, None] == np.array(self.labels)[None, : self.vectors], 1.0, -1.0)
            rest = 1.0 if self.vectors > 1 else self.weights.get(self.labels[-1], 1.0)
            own = np.array([self.weights.get(v, 1.0) for v in self.labels[: self.vectors]])
            cost = self.cost * np.where(y > 0, own[None, :], rest)
        if self.kind.startswith("squared"):
            return y, np.full(y.shape, np.inf), 0.5 / cost
        return y, cost, np.zeros(y.shape)


def _steps(task: _Task, index, value, y, upper, curve, alpha, w) -> np.ndarray:
    """Coordinate passes over one part; ``alpha`` is changed in place, the move of the primal vectors is returned."""
    moved = np.zeros_like(w)
    own = w.copy()  # the primal vectors as this part sees them, its moves weighed by the number of parts
    square = np.array([v @ v for v in value])
    regression = not task.labels
    active = np.arange(len(square))
    rng = np.random.default_rng(len(square))
    for _ in range(task.passes):
        settled, largest = [], 0.0
        for i in rng.permutation(active):
            at, x = index[i], value[i]
            q = task.parts * square[i] + curve[i]
            if not square[i]:
                continue
            z = own[:, at] @ x
            old = alpha[i]
            if regression:
                free = old - (z - y[i] + curve[i] * old) / q
                new = np.clip(np.sign(free) * np.maximum(np.abs(free) - task.tube / q, 0.0), -upper[i], upper[i])
                step = new - old
            else:
                slope = y[i] * z - 1.0 + curve[i] * old
                new = np.clip(old - slope / q, 0.0, upper[i])
                step = (new - old) * y[i]
            alpha[i] = new
            size = np.abs(step).max()
            if size:
                own[:, at] += task.parts * step[:, None] * x
                moved[:, at] += step[:, None] * x
                largest = max(largest, size)
            else:
                settled.append(i)
        if largest < 1e-14:
            break
        active = np.setdiff1d(active, settled, assume_unique=True) if len(settled) < len(active) else np.arange(len(square))
        if len(active) < len(square) // 10:
            active = np.arange(len(square))
    return moved


def _shares(slope: np.ndarray, q: float, bound: np.ndarray) -> np.ndarray:
    """The point x <= ``bound`` of sum 0 nearest to ``-slope / q``: x = min(bound, level - slope / q)."""
    free = -slope / q
    order = np.argsort(bound - free)
    total, rest = 0.0, free.sum()
    for held, m in enumerate(order):
        level = -(total + rest) / (len(order) - held)
        if free[m] + level <= bound[m]:
            return np.minimum(bound, free + level)
        total, rest = total + bound[m], rest - free[m]
    return bound.copy()


def _joint_steps(task: _Task, index, value, label, alpha, w) -> np.ndarray:
    """As ``_steps`` for the joint multi-class machine: all variables of a row move together, their sum stays 0."""
    moved, own = np.zeros_like(w), w.copy()
    names = np.array(task.labels)
    square = np.array([v @ v for v in value])
    bounds = (names[None, :] == label[:, None]) * np.array([task.cost * task.weights.get(v, 1.0) for v in label])[:, None]
    margin = 1.0 - (names[None, :] == label[:, None])
    rng = np.random.default_rng(len(square))
    for _ in range(task.passes):
        largest = 0.0
        for i in rng.permutation(len(square)):
            if not square[i]:
                continue
            at, x = index[i], value[i]
            q = task.parts * square[i]
            slope = own[:, at] @ x + margin[i]
            step = _shares(slope - q * alpha[i], q, bounds[i]) - alpha[i]
            alpha[i] += step
            own[:, at] += task.parts * step[:, None] * x
            moved[:, at] += step[:, None] * x
            largest = max(largest, np.abs(step).max())
        if largest < 1e-14:
            break
    return moved


def _values(task: _Task, index, value, label, y, upper, curve, alpha, w) -> tuple[np.ndarray, np.ndarray]:
    """Summed loss of the rows at ``w`` and the rows' terms of the dual value, per weight vector."""
    z = np.stack([w[:, at] @ x for at, x in zip(index, value)])
    if task.kind == "multiclass_hinge":
        own = np.argmax(np.array(task.labels)[None, :] == label[:, None], axis=1)
        margin = np.ones(z.shape)
        margin[np.arange(len(z)), own] = 0.0
        cost = np.array([task.cost * task.weights.get(v, 1.0) for v in label])
        loss = cost * (z + margin - z[np.arange(len(z)), own][:, None]).max(axis=1)
        out = np.zeros((2, task.vectors))
        out[:, 0] = loss.sum(), -(margin * alpha).sum()
        return out[0], out[1]
    if task.labels:
        miss, gain = np.maximum(0.0, 1.0 - y * z), alpha
    else:
        miss, gain = np.maximum(0.0, np.abs(z - y) - task.tube), y * alpha - task.tube * np.abs(alpha)
    if task.kind.startswith("squared"):
        loss = miss * miss * (0.5 / curve)
    else:
        loss = upper * miss
    return loss.sum(axis=0), (gain - 0.5 * curve * alpha * alpha).sum(axis=0)


def fit_dual(
    df: DataFrame,
    params: LinearParams,
    features: int,
    labels: list[float] | None = None,
    order: str | None = None,
    part_rows: int = PART_ROWS,
    passes: int = PASSES,
) -> DualFit:
    """Fit ``df(label, index, value)`` with solver 1, 3 (classes), 4 (joint classes), 12 or 13 (regression).

    Stops when the duality gap of every weight vector is at most ``params.eps`` of its primal value. A
    ``part_rows`` of the caller's own asks for coordinate ascent in such parts.
    """
    wrong = params.problem()
    if wrong or params.solver not in DUAL:
        raise ValueError(wrong or f"solver {params.solver} has no dual here")
    spark = df.sparkSession
    bound_batches(spark)
    steps = Rounds()
    kind = SOLVERS[params.solver][1]
    data = steps.keep(df.withColumn("label", F.col("label").cast("double")).withColumn("row", F.monotonically_increasing_id()))
    if params.solver in REGRESSION:
        labels, vectors = [], 1
    else:
        labels = labels or class_order(data, order)
        vectors = len(labels) if len(labels) != 2 or kind == "multiclass_hinge" else 1
    width = features + (1 if params.bias >= 0 else 0)
    if vectors * width > MOST_WEIGHTS:
        raise ValueError(f"{vectors} weight vectors of {width} features are more than a task may hold ({MOST_WEIGHTS} weights)")
    if kind != "multiclass_hinge" and vectors * width * width <= MOST_CURVATURE and part_rows == PART_ROWS:
        task = _Task(kind, tuple(labels), vectors, params.C, dict(params.class_weights), params.p, 1, passes)
        return _newton(data, task, params, labels, features, width)
    parts = max(1, -(-data.count() // part_rows))
    task = _Task(kind, tuple(labels), vectors, params.C, dict(params.class_weights), params.p, parts, passes)
    dealt = data.select(F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"), "row", "label", "index", "value")
    rows = bucketed(dealt, "part")
    state = bucketed(rows.select("part", F.lit("a").alias("kind"), "row", F.array(*[F.lit(0.0)] * vectors).alias("v")), "part", dealt=True)
    w = np.zeros((vectors, width))
    half = np.array([0.0])
    for count in range(params.max_iter):
        sent = spark.sparkContext.broadcast(w)

        def part(own: pd.DataFrame, duals: pd.DataFrame) -> pd.DataFrame:
            own, duals = own.sort_values("row"), duals.sort_values("row")
            index, value = [np.asarray(i, int) for i in own["index"]], [np.asarray(v, float) for v in own["value"]]
            label, now = own["label"].to_numpy(float), sent.value
            alpha = np.stack(duals["v"].to_numpy()).astype(float)
            y, upper, curve = task.targets(label) if kind != "multiclass_hinge" else (None, None, None)
            loss, gain = _values(task, index, value, label, y, upper, curve, alpha, now)
            if kind == "multiclass_hinge":
                moved = _joint_steps(task, index, value, label, alpha, now)
            else:
                moved = _steps(task, index, value, y, upper, curve, alpha, now)
            used = np.flatnonzero(moved.any(axis=0))
            out = [("a", r, v) for r, v in zip(own["row"], alpha)] + [("w", f, moved[:, f]) for f in used]
            out += [("loss", 0, loss), ("gain", 0, gain)]
            kinds, at, v = zip(*out)
            return pd.DataFrame({"part": int(own["part"].iloc[0]), "kind": kinds, "row": at, "v": list(v)})

        grouped = rows.groupBy("part").cogroup(state.filter("kind = 'a'").groupBy("part"))
        after = bucketed(grouped.applyInPandas(part, STATE), "part", dealt=True)
        sums = {"loss": np.zeros(vectors), "gain": np.zeros(vectors)}
        moved = np.zeros_like(w)
        totals = after.filter("kind <> 'a'").groupBy("kind", "row").agg(sum_vector(F.col("v"), vectors).alias("v"))
        for row in totals.collect():
            if row.kind == "w":
                moved[:, row["row"]] = row.v
            else:
                sums[row.kind] = np.array(row.v)
        half = 0.5 * (w * w).sum(axis=1)
        if kind == "multiclass_hinge":
            half = np.append(half.sum(), np.zeros(vectors - 1))
        primal, gap = half + sums["loss"], 2 * half + sums["loss"] - sums["gain"]
        if (gap <= params.eps * np.maximum(primal, 1e-12)).all() or count + 1 == params.max_iter:
            drop_bucketed(after)
            break
        drop_bucketed(state)
        state, w = after, w + moved
    if not (gap <= params.eps * np.maximum(primal, 1e-12)).all():
        warnings.warn(f"duality gaps are {gap.tolist()} after {count} rounds: raise max_iter or eps", RuntimeWarning, stacklevel=2)
    model = LinearModel(params.solver, list(labels), w, features, params.bias)
    duals = state.filter("kind = 'a'").select("row", F.col("v").alias("alpha"))
    return DualFit(model, duals, data, gap, primal, count)


@dataclass(frozen=True)
class _Outer:
    """Primal vectors after an outer step, and how near to the variables before it its own were kept (1 / sigma)."""

    w: np.ndarray
    near: float


def _variables(task: _Task, z, y, upper, curve, alpha, near):
    """The variables that an outer step gives at decision values ``z``, their terms of its value, and their slopes."""
    gap = y - z if not task.labels else 1.0 - y * z
    tube = 0.0 if task.labels else task.tube
    q = curve + near
    free = gap + near * alpha
    free = np.sign(free) * np.maximum(np.abs(free) - tube, 0.0) / q
    now = np.clip(free, 0.0 if task.labels else -upper, upper)
    value = now * gap - tube * np.abs(now) - 0.5 * curve * now * now - 0.5 * near * (now - alpha) ** 2
    return now, value, np.where((now == free) & (now != 0.0), 1.0 / q, 0.0)


def _decisions(index, value, w: np.ndarray):
    """Row numbers, features and values of a batch's entries and its decision values, one column per vector."""
    sizes = np.array([len(i) for i in index])
    at = np.repeat(np.arange(len(sizes)), sizes)
    cols = np.concatenate(index).astype(int) if len(at) else np.zeros(0, int)
    vals = np.concatenate(value).astype(float) if len(at) else np.zeros(0)
    z = np.stack([np.bincount(at, vals * v[cols], len(sizes)) for v in w], axis=1)
    return at, cols, vals, z


def _before(task: _Task, index, value, label, past: list[_Outer]):
    """Targets of a batch and the variables after all outer steps of ``past``, which follow from their vectors."""
    y, upper, curve = task.targets(label)
    alpha = np.zeros((len(label), task.vectors))
    for step in past:
        alpha = _variables(task, _decisions(index, value, step.w)[3], y, upper, curve, alpha, step.near)[0]
    return y, upper, curve, alpha


def _newton(data: DataFrame, task: _Task, params: LinearParams, labels, features: int, width: int) -> DualFit:
    """Outer steps keep the variables near the ones before by 1 / sigma, which shrinks; inner ones are Newton's."""
    spark, k = data.sparkSession, task.vectors
    rows = data.select("row", "label", "index", "value")
    schema = "kind string, at bigint, v array<double>"

    def sums(job) -> dict[str, np.ndarray]:
        """``job`` of every batch, a dict of arrays, summed over all batches."""

        def batches(parts):
            total: dict[str, np.ndarray] = {}
            for own in parts:
                index, value = [np.asarray(i, int) for i in own["index"]], list(own["value"])
                for name, x in job(index, value, own["label"].to_numpy(float)).items():
                    total[name] = total[name] + x if name in total else x
            lines = [(name, i, line) for name, x in total.items() for i, line in enumerate(x.reshape(len(x), -1))]
            if lines:
                kinds, at, v = zip(*lines)
                yield pd.DataFrame({"kind": kinds, "at": at, "v": [list(x) for x in v]})

        found: dict[tuple[str, int], np.ndarray] = {}
        for row in rows.mapInPandas(batches, schema).toLocalIterator():
            key = row.kind, row.at
            found[key] = found.get(key, 0.0) + np.array(row.v)
        names = {name for name, _ in found}
        return {n: np.stack([found[n, i] for i in range(sum(m == n for m, _ in found))]) for n in names}

    def look(w, move, past, near):
        """Along ``w + t move``: values per length and vector, and at t = 1 gradient and second derivatives."""
        sent = spark.sparkContext.broadcast((w, move, past))

        def job(index, value, label):
            w, move, past = sent.value
            y, upper, curve, alpha = _before(task, index, value, label, past)
            at, cols, vals, z = _decisions(index, value, w)
            step = _decisions(index, value, move)[3]
            out = {"value": np.stack([_variables(task, z + t * step, y, upper, curve, alpha, near)[1].sum(axis=0) for t in LENGTHS])}
            now, _, bend = _variables(task, z + step, y, upper, curve, alpha, near)
            pull = now * y if task.labels else now
            out["pull"] = np.stack([np.bincount(cols, vals * pull[at, j], width) for j in range(k)])
            dense = np.zeros((len(label), width))
            np.add.at(dense, (at, cols), vals)
            out["bend"] = np.stack([(dense[bend[:, j] > 0].T * bend[bend[:, j] > 0, j]) @ dense[bend[:, j] > 0] for j in range(k)])
            return out

        got = sums(job)
        sent.unpersist()
        along = w[None] + LENGTHS[:, None, None] * move[None]
        values = got["value"] + 0.5 * (along * along).sum(axis=2)
        end = w + move
        return values, end - got["pull"], got["bend"].reshape(k, width, width) + np.eye(width), got["pull"]

    def measure(w, past):
        """Duality gap and primal value of the vectors that the variables after ``past`` add up to."""
        sent = spark.sparkContext.broadcast((w, past))

        def job(index, value, label):
            w, past = sent.value
            y, upper, curve, alpha = _before(task, index, value, label, past)
            loss, gain = _values(task, [i for i in index], [np.asarray(v, float) for v in value], label, y, upper, curve, alpha, w)
            return {"loss": loss[:, None], "gain": gain[:, None]}

        got = sums(job)
        half = 0.5 * (w * w).sum(axis=1)
        return 2 * half + got["loss"][:, 0] - got["gain"][:, 0], half + got["loss"][:, 0]

    squared = task.kind.startswith("squared")
    w, past = np.zeros((k, width)), []
    near = 0.0 if squared else 1.0 / params.C
    passes = 0
    while True:
        values, slope, bend, pull = look(w, np.zeros_like(w), past, near)
        passes += 1
        here = values[-1]
        for _ in range(MOST_INNER):
            move = -np.stack([np.linalg.solve(b, s) for b, s in zip(bend, slope)])
            fall = (slope * move).sum(axis=1)
            if (-fall <= 1e-9 * params.eps * np.maximum(np.abs(here), 1e-12)).all() or passes >= params.max_iter * task.passes:
                break
            values, slope, bend, pull = look(w, move, past, near)
            passes += 1
            good = values <= here + 1e-4 * LENGTHS[:, None] * fall + 1e-14 * np.abs(here)
            taken = np.where(good.any(axis=0), good.argmax(axis=0), len(LENGTHS) - 1)
            if (taken == 0).all():
                w, here = w + move, values[0]
                continue
            w = w + LENGTHS[taken][:, None] * move
            values, slope, bend, pull = look(w, np.zeros_like(w), past, near)
            passes += 1
            here = values[-1]
        past = [*past, _Outer(w, near)]
        gap, primal = measure(pull, past)
        passes += 1
        done = (gap <= params.eps * np.maximum(primal, 1e-12)).all() and near * params.C <= 1e-2
        if done or squared or passes >= params.max_iter * task.passes:
            break
        near /= 10.0
    if not (gap <= params.eps * np.maximum(primal, 1e-12)).all():
        warnings.warn(f"duality gaps are {gap.tolist()} after {passes} passes: raise max_iter or eps", RuntimeWarning, stacklevel=3)
    sent = spark.sparkContext.broadcast(past)

    def last(parts):
        for own in parts:
            index, value = [np.asarray(i, int) for i in own["index"]], list(own["value"])
            alpha = _before(task, index, value, own["label"].to_numpy(float), sent.value)[3]
            yield pd.DataFrame({"row": own["row"], "alpha": [list(a) for a in alpha]})

    duals = rows.mapInPandas(last, "row bigint, alpha array<double>")
    return DualFit(LinearModel(params.solver, list(labels), pull, features, params.bias), duals, data, gap, primal, passes)


def violations(fit: DualFit, params: LinearParams, near: float) -> DataFrame:
    """label, n, violated: rows whose variables break the optimality conditions by more than ``near``.

    A variable at its lower bound wants a margin of 1 or more, one at its upper bound 1 or less, a free
    one exactly 1 less its loss' share (for regression: the tube in the place of the margin).
    """
    k = len(fit.model.weights)
    rows = fit.data.join(fit.duals, "row").withColumn("z", decision_values(fit.model))
    squared = SOLVERS[params.solver][1].startswith("squared")
    bad: list[Column] = []
    for j, (z, a) in enumerate(zip(items("z", k), items("alpha", k))):
        if fit.model.labels:
            y = F.when(F.col("label") == fit.model.labels[j], 1.0).otherwise(-1.0)
            short = 1 - y * z
        else:
            short = F.abs(z - F.col("label")) - params.p
        if squared:
            free = F.abs(short - F.abs(a) / (2 * params.C))
        else:
            free = F.when(F.abs(a) < params.C, F.abs(short)).otherwise(F.greatest(-short, F.lit(0.0)))
        bad.append(F.when(a == 0, F.greatest(short, F.lit(0.0))).otherwise(free))
    worst = F.greatest(*bad) if k > 1 else bad[0]
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum((worst > near).cast("bigint")).alias("violated"))
