"""Products of a matrix in blocks: several blocks, few partitions, and what falls back to rows."""

import numpy as np
import pytest

from loopweave.operators import balance as bl
from loopweave.operators import mprop
from loopweave.plans import blocks


@pytest.fixture
def spread(monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_CELLS", 40)
    monkeypatch.setattr(blocks, "STRIP", 2)


def matrix(n, seed=5):
    rng = np.random.default_rng(seed)
    a = rng.random((n, n)) * (rng.random((n, n)) < 0.2)
    return a + a.T + np.eye(n)


def cells(spark, a, names=("id1", "id2")):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], f"{names[0]} bigint, {names[1]} bigint, weight double")


def test_products_equal_the_dense_ones(spark, spread):
    a = matrix(40)
    made = blocks.matrix_blocks(cells(spark, a, ("node", "nbr")))
    assert made.count > 3
    ones = made.product(made.constant(1.0), lambda x: (x, x), lambda kept, got: (got, []))
    twice = made.product(made.keep(ones), lambda x: (x, x), lambda kept, got: (np.vstack([got, kept]), [got.sum()]))
    state = made.keep(twice)
    rows = made.rows(state, 2).orderBy("idx").collect()
    assert np.allclose([r.value for r in rows], np.array([a @ a.sum(axis=1), a.sum(axis=1)]).T)
    assert np.isclose(blocks.sums_of(state, 1)[0], (a @ a).sum())


def test_balancing_in_blocks_equals_that_by_cells(spark, spread):
    a = cells(spark, matrix(40))
    got = bl.balance(a, tol=1e-9).orderBy("idx").collect()
    want = bl._balance_by_cells(a, 1e-9, 30, 10, 0.1, 3.0).orderBy("idx").collect()
    assert [r.idx for r in got] == [r.idx for r in want]
    assert np.allclose([r.x for r in got], [r.x for r in want], rtol=1e-8)


def test_tasks_of_a_product_do_not_grow_with_the_partitions_of_the_session(spark):
    a = cells(spark, matrix(20), ("node", "nbr"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        made = blocks.matrix_blocks(a)
        assert made.blocks.rdd.getNumPartitions() < 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_propagation_in_blocks_equals_that_by_edges(spark, spread):
    edges = cells(spark, matrix(40) - np.diag(np.diag(matrix(40))))
    measures = spark.createDataFrame(
        [(i, [0.2 + 0.01 * (i % 40), 0.8 - 0.01 * (i % 40)]) for i in range(0, 60, 3)] + [(41, None)], "idx bigint, post array<double>"
    )
    got = mprop.propagate(edges, measures, rounds=3, mu=0.7, nu=0.1).orderBy("idx").collect()
    want = mprop._propagate_by_edges(edges, measures, 3, 0.7, 0.1, 1.0, 2).orderBy("idx").collect()
    assert [r.idx for r in got] == [r.idx for r in want]
    assert np.allclose([r.post for r in got], [r.post for r in want])


def test_lopsided_and_full_matrices_keep_their_rows(spark, monkeypatch):
    lopsided = spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0)], "node bigint, nbr bigint, weight double")
    assert blocks.matrix_blocks(lopsided) is None
    monkeypatch.setattr(blocks, "CELLS", 100)
    assert blocks.matrix_blocks(cells(spark, matrix(40), ("node", "nbr"))) is None
