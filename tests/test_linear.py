"""Linear models against the published example and against optimality conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.operators import classify as cl
from loopweave.operators import linear as ln
from loopweave.sources import writers

# The published three-class example (labels, three features).
EXAMPLE = [
    (1, [1, 0, 0]), (1, [1, 0, -1]), (2, [1, -1, 0]), (2, [1, 0, 0]), (3, [1, 1, 1]), (3, [-1, -1, -1]),
]
MODEL = np.array([[0, 0.4, -0.4], [0, -0.4, 0.4], [-0.9069706097048917, 0.3381644874876603, 0.3381644874876603]])


def rows(spark, data, keep=("label",)):
    df = spark.createDataFrame(
        [(i, float(y), [float(v) for v in x]) for i, (y, x) in enumerate(data)],
        "idx bigint, label double, features array<double>",
    )
    return ln.sparse_rows(df, keep=("idx", *keep))


def cloud(n=60, seed=3):
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(n) < 0.5, 1.0, -1.0)
    return y, rng.normal(size=(n, 3)) + 0.6 * y[:, None]


def test_example_optimum_and_probabilities(spark):
    model = ln.train(rows(spark, EXAMPLE), ln.LinearParams(solver=0, eps=1e-6), 3)
    assert model.labels == [1.0, 2.0, 3.0]
    want = [[0, 0.4011, -0.4011], [0, -0.4011, 0.4011], [-0.9072, 0.3383, 0.3383]]
    assert np.allclose(model.weights, want, atol=2e-4)
    assert np.allclose(model.weights, MODEL, atol=2e-3)
    given = ln.LinearModel(0, [1.0, 2.0, 3.0], MODEL, 3)
    got = ln.predict(rows(spark, [(0, [0.5, -0.5, 1.0])]), given).first()
    assert got.prediction == 2.0
    assert np.round(got.probability, 6).tolist() == [0.247901, 0.451705, 0.300393]


def objective(solver, w, y, x, c, p=0.1):
    z = x @ w
    kind, penalty = ln.SOLVERS[solver][1:]
    reg = 0.5 * w @ w if penalty == "l2" else np.abs(w).sum()
    hinge, gap = np.maximum(0, 1 - y * z), np.maximum(0, np.abs(z - y) - p)
    loss = {
        "logistic": np.logaddexp(0, -y * z), "squared_hinge": hinge**2, "hinge": hinge,
        "squared_gap": gap**2, "gap": gap,
    }[kind]
    return reg + c * loss.sum()


@pytest.mark.parametrize("solver", [2, 3, 5, 6, 11, 13])
def test_no_nearby_point_is_better(spark, solver):
    y, x = cloud()
    model = ln.train(rows(spark, list(zip(y, x))), ln.LinearParams(solver=solver, C=0.5, eps=1e-6), 3)
    w = model.weights[0] * (1 if not model.labels or model.labels[0] == 1.0 else -1)
    best = objective(solver, w, y, x, 0.5)
    rng = np.random.default_rng(0)
    for scale in (1e-1, 1e-2, 1e-3):
        for step in rng.normal(size=(40, 3)) * scale:
            assert objective(solver, w + step, y, x, 0.5) >= best - 2e-3


def test_multiclass_hinge_separates_clusters(spark):
    rng = np.random.default_rng(1)
    data = [(k, rng.normal(size=2) * 0.3 + c) for k, c in enumerate([(3, 0), (-3, 2), (0, -4)]) for _ in range(12)]
    df = rows(spark, data)
    model = ln.train(df, ln.LinearParams(solver=4, eps=1e-3), 2)
    scored = ln.predict(df, model)
    assert ln.scores(scored).first().accuracy == 100.0


def test_first_label_order_and_class_weights(spark):
    df = spark.createDataFrame([(0, -1.0), (1, 1.0), (2, -1.0)], "idx bigint, label double")
    assert ln.class_order(df, "idx") == [1.0, -1.0]
    y, x = cloud()
    data = rows(spark, list(zip(y, x)))
    plain = ln.train(data, ln.LinearParams(solver=0), 3, labels=[1.0, -1.0])
    heavy = ln.train(data, ln.LinearParams(solver=0, class_weights={1.0: 20.0}), 3, labels=[1.0, -1.0])
    def positives(m):
        return ln.predict(data, m).filter("prediction = 1").count()

    assert positives(heavy) > positives(plain)


def test_parameters_are_checked(spark):
    assert "cost C is 0" in ln.LinearParams(C=0).problem()
    assert "solver 9" in ln.LinearParams(solver=9).problem()
    both = ln.LinearParams(eps=-1, p=-1).problem()
    assert "eps is -1" in both and "p is -1" in both
    assert ln.LinearParams().problem() is None
    with pytest.raises(ValueError):
        ln.train(rows(spark, EXAMPLE), ln.LinearParams(C=-1), 3)


def test_model_file_round_trip(tmp_path):
    model = ln.LinearModel(0, [1.0, 2.0, 3.0], MODEL, 3, 1.0)
    writers.save_model(model, str(tmp_path / "m"))
    back = writers.load_model(str(tmp_path / "m"))
    assert back.labels == model.labels and back.solver == 0 and back.bias == 1.0
    assert np.array_equal(back.weights, model.weights)


def test_cross_validation_predicts_every_row_once(spark):
    y, x = cloud(30)
    out = ln.cross_validate(rows(spark, list(zip(y, x))), "idx", ln.LinearParams(solver=0, eps=0.1), 3, 3)
    assert sorted(r.idx for r in out.collect()) == list(range(30))


def test_unseen_feature_indices_are_ignored(spark):
    model = ln.LinearModel(2, [1.0, -1.0], np.array([[1.0, 2.0]]), 2)
    df = spark.createDataFrame([([0, 7], [3.0, 100.0])], "index array<int>, value array<double>")
    assert ln.predict(df, model).first().decision == [3.0]


def test_multilabel_f1_by_hand(spark):
    truth = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (2, "c")], "idx bigint, label string")
    score = [(0, "a", 0.9), (0, "b", 0.1), (0, "c", 0.5), (1, "b", 0.8), (1, "a", 0.1), (2, "a", 0.7), (2, "c", 0.2)]
    scored = spark.createDataFrame(score, "idx bigint, label string, score double")
    predicted = cl.predicted_labels(truth, scored)
    assert sorted(map(tuple, predicted.collect())) == [(0, "a"), (0, "c"), (1, "b"), (2, "a")]
    got = cl.f1_scores(truth, predicted).first()
    # a: tp 1 fp 1; b: tp 1 fn 1; c: fp 1 fn 1
    assert got.macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)
    assert got.micro_f1 == pytest.approx(0.5)
    assert (got.n_labels, got.n_tests) == (3, 3)
    assert cl.example_f1(truth, predicted).first().f1 == pytest.approx(0.5)


def test_split_sizes(spark):
    nodes = spark.range(21).select(F.col("id").alias("idx"))
    assert cl.split(nodes, "idx", 0.3).filter("train").count() == 7
