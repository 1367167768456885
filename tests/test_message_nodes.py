"""Blocks of messages are bounded by their nodes too, not by their edges alone."""

import numpy as np
from pyspark.sql import functions as F

from loopweave.operators import mrf
from loopweave.plans import blocks


def test_nodes_without_edges_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "NODES", 16, raising=False)
    sizes = []

    def unpack(state, step, k):
        sizes.append(state.filter("kind = 'belief'").agg(F.max("n")).first()[0])
        return blocks.unpack(state, step, k)

    monkeypatch.setattr(mrf, "unpack", unpack)
    phi = np.random.default_rng(5).normal(size=(200, 2))
    psi = np.log(np.array([[0.4, 0.1], [0.2, 0.3]]))
    unary = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(phi)], "idx bigint, phi array<double>")
    edges = spark.createDataFrame([(3, 150)], "id1 bigint, id2 bigint")
    got = np.array([r.belief for r in mrf.loopy_beliefs(edges, unary, psi, max_iter=2, tol=0.0).orderBy("idx").collect()])
    alone = phi - np.logaddexp.reduce(phi, axis=1)[:, None]
    want = alone.copy()
    for a, b in ((3, 150), (150, 3)):
        joint = phi[a] + np.logaddexp.reduce(psi + alone[b], axis=1)
        want[a] = joint - np.logaddexp.reduce(joint)
    assert np.allclose(got, want)
    assert sizes and max(sizes) < 60
