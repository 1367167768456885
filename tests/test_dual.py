"""Dual machines against projected gradient descent on the whole dual, in one part and in several."""

import numpy as np
import pytest

from loopweave.operators import dual
from loopweave.operators import linear as ln


def cloud(n=200, d=5, seed=4):
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(n) < 0.5, 1.0, -1.0)
    return y, rng.normal(size=(n, d)) + 0.5 * y[:, None]


def table(spark, y, x):
    df = spark.createDataFrame(
        [(i, float(t), [float(v) for v in row]) for i, (t, row) in enumerate(zip(y, x))],
        "idx bigint, label double, features array<double>",
    )
    return ln.sparse_rows(df, keep=("idx", "label"))


def descend(q, linear, project, steps=20_000):
    """The minimum of a'qa/2 + linear'a over a box, by projected gradient steps."""
    a = np.zeros(len(q))
    rate = 1.0 / np.linalg.eigvalsh(q)[-1]
    for _ in range(steps):
        a = project(a - rate * (q @ a + linear))
    return 0.5 * a @ q @ a + linear @ a


@pytest.mark.parametrize(("solver", "part_rows", "eps"), [(1, dual.PART_ROWS, 1e-5), (3, dual.PART_ROWS, 1e-5), (3, 120, 1e-2)])
def test_support_vector_machines(spark, solver, part_rows, eps):
    y, x = cloud()
    c = 0.3
    fit = dual.fit_dual(table(spark, y, x), ln.LinearParams(solver=solver, C=c, eps=eps), 5, labels=[1.0, -1.0], part_rows=part_rows)
    q = (y[:, None] * x) @ (y[:, None] * x).T + (np.eye(len(y)) / (2 * c) if solver == 1 else 0)
    best = -descend(q, -np.ones(len(y)), lambda a: np.clip(a, 0, np.inf if solver == 1 else c))
    assert fit.primal[0] == pytest.approx(best, rel=max(1e-4, eps))
    assert 0 <= fit.gap[0] <= eps * fit.primal[0]
    alpha = {r["row"]: r.alpha[0] for r in fit.duals.collect()}
    rows = fit.data.collect()
    w = np.zeros(5)
    for r in rows:
        w[r["index"]] += alpha[r["row"]] * r.label * np.array(r.value)
    assert np.allclose(w, fit.model.weights[0], atol=1e-9)
    found = dual.violations(fit, ln.LinearParams(solver=solver, C=c), 0.05).collect()
    assert sum(r.n for r in found) == 200 and (eps > 1e-4 or sum(r.violated for r in found) == 0)


@pytest.mark.parametrize("solver", [12, 13])
def test_support_vector_regression(spark, solver):
    _, x = cloud(seed=5)
    y = x @ np.arange(5) + np.random.default_rng(6).normal(size=len(x))
    c, p = 0.4, 0.2
    params = ln.LinearParams(solver=solver, C=c, p=p, eps=1e-5)
    fit = dual.fit_dual(table(spark, y, x), params, 5)
    # Positive and negative part of each variable apart: both at least 0, at most C.
    k = x @ x.T
    q = np.block([[k, -k], [-k, k]]) + (np.eye(2 * len(y)) / (2 * c) if solver == 12 else 0)
    best = -descend(q, np.concatenate([p - y, p + y]), lambda a: np.clip(a, 0, np.inf if solver == 12 else c))
    assert fit.primal[0] == pytest.approx(best, rel=1e-4)
    assert dual.violations(fit, params, 0.05).agg({"violated": "sum"}).first()[0] == 0


@pytest.mark.parametrize(("part_rows", "eps"), [(dual.PART_ROWS, 1e-5), (80, 1e-2)])
def test_joint_machine(spark, part_rows, eps):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 150).astype(float)
    x = rng.normal(size=(150, 2)) + np.array([(1, 0), (-1, 1), (0, -1)])[y.astype(int)]
    fit = dual.fit_dual(table(spark, y, x), ln.LinearParams(solver=4, C=0.5, eps=eps), 2, part_rows=part_rows)
    assert 0 <= fit.gap[0] <= eps * fit.primal[0]

    def value(w):
        z = x @ w.T
        margin = 1.0 - (np.arange(3)[None, :] == y[:, None])
        return 0.5 * (w * w).sum() + 0.5 * (z + margin - z[np.arange(150), y.astype(int)][:, None]).max(axis=1).sum()

    assert value(fit.model.weights) == pytest.approx(fit.primal[0], rel=1e-9)
    for scale in (1e-1, 1e-2, 1e-3):
        for step in rng.normal(size=(50, 3, 2)) * scale:
            assert value(fit.model.weights + step) >= fit.primal[0] * (1 - eps)


def test_share_of_a_bounded_sum():
    rng = np.random.default_rng(8)
    for _ in range(200):
        slope, bound, q = rng.normal(size=4), np.where(rng.random(4) < 0.3, rng.random(4), 0.0), rng.random() + 0.1
        got = dual._shares(slope, q, bound)
        assert abs(got.sum()) < 1e-9 and (got <= bound + 1e-12).all()

        def cost(a):
            return 0.5 * q * a @ a + slope @ a

        for _ in range(20):
            other = np.minimum(rng.normal(size=4), bound)
            low = int(np.argmin(other - bound))
            other[low] -= other.sum()
            if other[low] <= bound[low]:
                assert cost(got) <= cost(other) + 1e-9


def test_rows_of_several_parts_reach_the_gap_in_few_rounds(spark):
    y, x = cloud(n=dual.PART_ROWS + 800, d=2)
    fit = dual.fit_dual(table(spark, y, x), ln.LinearParams(solver=3, eps=1e-4, max_iter=5), 2, labels=[1.0, -1.0])
    assert 0 <= fit.gap[0] <= 1e-4 * fit.primal[0]
