"""The graph of a mixture with propagation is laid out once, however many inferences follow."""

import numpy as np

from loopweave.operators import mixture, mprop
from loopweave.operators.contacts import swap_union


def test_mixture_lays_the_graph_out_once(spark, monkeypatch):
    laid = []
    monkeypatch.setattr(mprop, "matrix_blocks", lambda cells, own=mprop.matrix_blocks: laid.append(1) or own(cells))
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (20, 2)), rng.normal(8, 1, (20, 2))])
    feats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, features array<double>")
    chain = swap_union(spark.createDataFrame([(i, i + 1, 1.0) for i in range(38)], "id1 bigint, id2 bigint, weight double"))
    got = mixture.mixture_with_propagation(feats, chain, 2, loops=3, rounds=2).orderBy("idx").collect()
    assert len(laid) == 1 and len(got) == 40

    model, params = mixture.fit_mixture(feats, 2)
    want = mixture.posterior(model, feats)
    for _ in range(2):
        want = mixture.posterior_with_evidence(feats, params, mprop.propagate(chain, want, rounds=2), 1.0)
    assert np.allclose([r.post for r in got], [r.post for r in want.orderBy("idx").collect()])


def test_links_of_a_graph_that_is_not_symmetric(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0), (1, 2, 1.0), (2, 1, 1.0)], "id1 bigint, id2 bigint, weight double")
    measures = spark.createDataFrame([(0, [0.9, 0.1]), (3, [0.2, 0.8])], "idx bigint, post array<double>")
    links = mprop.Links(edges, measures)
    assert links.blocks is None
    got = mprop.propagate(links, measures, rounds=2).orderBy("idx").collect()
    want = mprop._propagate_by_edges(edges, measures, 2, 1.0, 0.0, 1.0, 2).orderBy("idx").collect()
    assert [r.idx for r in got] == [r.idx for r in want]
    assert np.allclose([r.post for r in got], [r.post for r in want])
