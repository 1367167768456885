"""Rounds over graphs in blocks: several blocks, hubs, few jobs."""

import numpy as np

from loopweave.operators import mrf
from loopweave.plans import blocks


def chain(n):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(n - 1)] + [(0, n // 2)]
    return links, rng.normal(size=(n, 2)), np.log(rng.dirichlet(np.ones(4)).reshape(2, 2))


def dense(links, phi, psi, rounds):
    both = links + [(b, a) for a, b in links]
    got = {e: np.zeros(2) for e in both}  # (node, nbr): what node got from nbr
    for n in range(rounds):
        belief = phi.copy()
        for (node, _), m in got.items():
            belief[node] += m
        belief -= np.logaddexp.reduce(belief, axis=1)[:, None]
        got = {(b, a): np.logaddexp.reduce(psi + belief[a] - got[a, b], axis=1) for a, b in both}
    return belief


def frames(spark, links, phi):
    edges = spark.createDataFrame(links, "id1 bigint, id2 bigint")
    return edges, spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(phi)], "idx bigint, phi array<double>")


def beliefs(df):
    return np.array([r.belief for r in df.orderBy("idx").collect()])


def test_many_rounds_take_few_jobs(spark):
    links, phi, psi = chain(60)
    edges, unary = frames(spark, links, phi)
    spark.sparkContext.setJobGroup("rounds of beliefs", "")
    got = beliefs(mrf.loopy_beliefs(edges, unary, psi, max_iter=40, tol=0.0))
    spark.sparkContext.setJobGroup("other", "")
    assert np.allclose(got, dense(links, phi, psi, 40))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rounds of beliefs")
    assert len(jobs) < 80  # two and more a round before


def test_blocks_and_rows_give_the_same_beliefs(spark, monkeypatch):
    links, phi, psi = chain(30)
    edges, unary = frames(spark, links, phi)
    want = dense(links, phi, psi, 5)
    monkeypatch.setattr(blocks, "BLOCK", 16)
    layout = mrf.message_layout(edges)
    assert isinstance(layout, blocks.MessageBlocks) and layout.count == 4
    assert np.allclose(beliefs(mrf.loopy_beliefs(layout, unary, psi, max_iter=5, tol=0.0)), want)
    hubs = mrf.message_layout(edges, most=2)
    assert isinstance(hubs, mrf.MessageRows)
    assert np.allclose(beliefs(mrf.loopy_beliefs(hubs, unary, psi, max_iter=5, tol=0.0)), want)


def test_nodes_without_scores_send_nothing_and_lone_nodes_keep_theirs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 4)
    links, phi, psi = chain(10)
    edges, unary = frames(spark, links + [(3, 77), (77, 5)], np.vstack([phi, phi[:1]]))  # 10 has no edge, 77 no score
    got = beliefs(mrf.loopy_beliefs(edges, unary, psi, max_iter=4, tol=0.0))
    alone = phi[:1] - np.logaddexp.reduce(phi[0])
    assert np.allclose(got, np.vstack([dense(links, phi, psi, 4), alone]))
