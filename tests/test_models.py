"""Iterative models against dense sequential versions on small inputs."""

import itertools

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.functions.gaussian import log_densities
from loopweave.operators import embed as em
from loopweave.operators import graph as gr
from loopweave.operators import hmm, mixture, mprop, mrf
from loopweave.operators.contacts import swap_union


def sequences():
    rng = np.random.default_rng(2)
    lengths = {10: 23, 40: 7, 90: 1}
    rows, data = [], {}
    for chain, n in lengths.items():
        state, xs = 0, []
        for t in range(n):
            state = state if rng.random() < 0.8 else 1 - state
            xs.append([3.0 * state + rng.normal(), -2.0 * state + rng.normal()])
            rows.append((chain, n, t, chain + t, xs[-1]))
        data[chain] = np.array(xs)
    return rows, data


def start_params():
    return hmm.HmmParams(
        np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]),
        np.array([[0.0, 0.0], [2.0, -1.0]]), np.array([np.eye(2), np.eye(2) * 1.5]),
    )


def lse(a, axis=None):
    m = a.max(axis=axis, keepdims=True)
    return (np.log(np.exp(a - m).sum(axis=axis, keepdims=True)) + m).squeeze(axis)


def sequential_step(data, p):
    k, dim = p.means.shape
    start, xi, weight = np.zeros(k), np.zeros((k, k)), np.zeros(k)
    first, second, total = np.zeros((k, dim)), np.zeros((k, dim, dim)), 0.0
    la = np.log(p.trans)
    for x in data.values():
        lp = log_densities(x, p.pairs)
        n = len(x)
        a, b = np.zeros((n, k)), np.zeros((n, k))
        a[0] = np.log(p.start) + lp[0]
        for t in range(1, n):
            a[t] = lp[t] + lse(a[t - 1][:, None] + la, 0)
        for t in range(n - 2, -1, -1):
            b[t] = lse(la + (lp[t + 1] + b[t + 1])[None, :], 1)
        ll = lse(a[-1])
        g = np.exp(a + b - ll)
        for t in range(n - 1):
            xi += np.exp(a[t][:, None] + la + (lp[t + 1] + b[t + 1])[None, :] - ll)
        start += g[0]
        weight += g.sum(0)
        first += g.T @ x
        second += np.einsum("nk,ni,nj->kij", g, x, x)
        total += ll
    return np.concatenate([start, xi.ravel(), weight, first.ravel(), second.ravel()]), total


@pytest.mark.parametrize("block", [5, 1000])
def test_blocked_forward_backward_equals_sequential(spark, block):
    rows, data = sequences()
    df = spark.createDataFrame(rows, "chain bigint, n bigint, t bigint, idx bigint, features array<double>")
    blocks = hmm.pack_chains(df, block)
    p = start_params()
    borders = hmm._border_messages(hmm._summaries(blocks, p, viterbi=False), p)
    stats, loglik = hmm._expected_counts(blocks, borders, p)
    want, ll = sequential_step(data, p)
    assert loglik == pytest.approx(ll)
    assert np.allclose(stats, want)


@pytest.mark.parametrize("block", [4, 1000])
def test_blocked_viterbi_equals_enumeration(spark, block):
    rows, data = sequences()
    rows = [(c, min(n, 11), t, i, x) for c, n, t, i, x in rows if t < 11]
    df = spark.createDataFrame(rows, "chain bigint, n bigint, t bigint, idx bigint, features array<double>")
    p = start_params()
    got = {r.idx: r.label for r in hmm.decode(hmm.pack_chains(df, block), p).collect()}
    for chain, x in data.items():
        x = x[:11]
        lp = log_densities(x, p.pairs)
        best = max(
            itertools.product(range(2), repeat=len(x)),
            key=lambda s: np.log(p.start[s[0]]) + lp[0, s[0]]
            + sum(np.log(p.trans[s[t - 1], s[t]]) + lp[t, s[t]] for t in range(1, len(x))),
        )
        assert [got[chain + t] for t in range(len(x))] == list(best)


def test_hmm_likelihood_never_falls(spark):
    rows, _ = sequences()
    df = spark.createDataFrame(rows, "chain bigint, n bigint, t bigint, idx bigint, features array<double>")
    _, history = hmm.fit_hmm(hmm.pack_chains(df, 6), start_params(), max_iter=5, tol=0.0, floor=0.0)
    assert len(history) >= 2
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))


def small_graph():
    return [(0, 1, 2.0), (1, 2, 1.0), (0, 2, 0.5), (2, 3, 1.5), (4, 5, 1.0)]


def edge_frame(spark, rows=None):
    return spark.createDataFrame(rows or small_graph(), "id1 bigint, id2 bigint, weight double")


def test_measure_propagation_equals_dense_updates(spark):
    w = np.zeros((6, 6))
    for a, b, v in small_graph():
        w[a, b] += v
        w[b, a] += v
    r = {0: [0.7, 0.2, 0.1], 3: [0.1, 0.1, 0.8], 5: [0.2, 0.5, 0.3]}
    q = np.full((6, 3), 1 / 3)
    for i, v in r.items():
        q[i] = v
    full = w + np.eye(6)
    for _ in range(4):
        b = full @ np.log(q) / full.sum(1, keepdims=True)
        p = np.exp(b) / np.exp(b).sum(1, keepdims=True)
        lab = np.array([[1.0 if i in r else 0.0] for i in range(6)])
        rr = np.array([r.get(i, [0, 0, 0]) for i in range(6)])
        q = (rr + full.T @ p) / (lab + full.sum(0)[:, None])
    prior = spark.createDataFrame([(i, v) for i, v in r.items()], "idx bigint, post array<double>")
    got = {x.idx: x.post for x in mprop.propagate(swap_union(edge_frame(spark)), prior, rounds=4).collect()}
    assert np.allclose([got[i] for i in range(6)], p)
    assert np.allclose([sum(v) for v in got.values()], 1)


def dense_beliefs(phi, edges, psi, rounds):
    msg = {e: np.zeros(len(psi)) for e in edges}
    for n in range(rounds):
        b = phi.copy()
        for (s, t), m in msg.items():
            b[t] += m
        b -= np.log(np.exp(b).sum(1, keepdims=True))
        if n + 1 < rounds:
            msg = {(s, t): np.log(np.exp(psi + (b[s] - msg[t, s])[None, :]).sum(1)) for s, t in edges}
    return b


def test_loopy_beliefs_equal_dense_messages(spark):
    rng = np.random.default_rng(4)
    phi = rng.normal(size=(7, 3))
    psi = np.log(rng.dirichlet(np.ones(9)).reshape(3, 3))
    pairs = [(a, b) for a, b, _ in small_graph()]
    want = dense_beliefs(phi, pairs + [(b, a) for a, b in pairs], psi, 6)
    unary = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(phi)], "idx bigint, phi array<double>")
    got = mrf.loopy_beliefs(swap_union(edge_frame(spark)), unary, psi, max_iter=6, tol=0.0).orderBy("idx").collect()
    assert np.allclose([r.belief for r in got], want)
    assert [r.label for r in got] == list(want.argmax(1))


def test_random_field_em_equals_dense_version(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (15, 2)), rng.normal(4, 1, (15, 2))])
    und = [(i, i + 1) for i in range(29) if i != 14] + [(0, 20)]
    edges = und + [(b, a) for a, b in und]
    label = (x[:, 0] > 2).astype(int)
    params = [(np.zeros(2), np.eye(2)), (np.full(2, 4.0), np.eye(2))]

    def potential(lab):
        c = np.zeros((2, 2))
        for a, b in edges:
            c[lab[a], lab[b]] += 1
        logs = np.log(c + 1e-100)
        return logs - lse(logs.ravel())

    psi, prm = potential(label), params
    for _ in range(2):
        phi = log_densities(x, prm)
        lab = dense_beliefs(phi, edges, psi, 4).argmax(1)
        score = phi.copy()
        for a, b in edges:
            score[a] += psi[lab[b]]
        score = score - lse(score, 0)[None, :]
        label = score.argmax(1)
        prm = [
            (x[label == k].mean(0), np.cov(x[label == k], rowvar=False)) if (label == k).sum() > 1 else None
            for k in range(2)
        ]
        psi = potential(label)
    feats = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "idx bigint, features array<double>")
    first = spark.createDataFrame([(i, int(v > 2)) for i, v in enumerate(x[:, 0])], "idx bigint, label bigint")
    got = mrf.fit_random_field(
        feats, edge_frame(spark, [(a, b, 1.0) for a, b in edges]), k=2, em_iter=2, lbp_iter=4, tol=0.0,
        params=params, labels=first,
    ).orderBy("idx").collect()
    assert [r.label for r in got] == list(label)


def test_densify_equals_breadth_first_walks(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.integers(1, 5, 40))]
    rows += [(0, i, 1.0) for i in range(12)]
    nbr, degree = {}, {}
    for a, b, w in rows:
        nbr.setdefault(a, []).append((b, w))
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
    k, want = 6, {}
    for s in degree:
        out = nbr.get(s, [])
        if len(out) > k:
            continue
        total = {s: degree[s] / 10}
        queue = [(s, 0, sum(w for _, w in out))]
        while queue:
            v, depth, cw = queue.pop()
            if depth:
                total[v] = total.get(v, 0) + cw
            if depth < 2 and v in nbr:
                z = sum(w for _, w in nbr[v])
                queue += [(u, depth + 1, cw * w / z) for u, w in nbr[v]]
        top = sorted(total.items(), key=lambda e: (-round(e[1], 6), e[0]))[:k]
        want.update({(s, v): round(f, 6) for v, f in top})
    got = gr.densify(edge_frame(spark, rows), k, depth=2).collect()
    wide = {s for s, v in nbr.items() if len(v) > k}
    assert sorted((r.id1, r.id2, r.weight) for r in got if r.id1 in wide) == sorted(r for r in rows if r[0] in wide)
    narrow = {(r.id1, r.id2): r.weight for r in got if r.id1 not in wide}
    assert narrow.keys() == want.keys()
    assert all(narrow[e] == pytest.approx(want[e], abs=2e-6) for e in want)


def test_embedding_puts_linked_nodes_together(spark):
    cliques = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 8) for b in range(base, base + 8) if a != b]
    p = em.EmbedParams(dim=4, samples=12_000, rho=0.3, seed=3, batch=16)
    vec = {r.idx: np.array(r.vec) for r in em.embed(edge_frame(spark, cliques), p).collect()}
    centre = np.mean(list(vec.values()), axis=0)
    unit = {k: (v - centre) / np.linalg.norm(v - centre) for k, v in vec.items()}
    inside = [unit[a] @ unit[b] for a, b, _ in cliques]
    across = [unit[a] @ unit[b] for a in range(8) for b in range(10, 18)]
    assert np.mean(inside) > np.mean(across) + 0.2


def community_edges(n, groups, links, seed):
    """Directed rows of an undirected graph whose edges mostly stay inside one of ``groups`` groups."""
    rng = np.random.default_rng(seed)
    group = rng.integers(0, groups, n)
    members = [np.flatnonzero(group == g) for g in range(groups)]
    pairs = {(a, int(rng.choice(members[group[a]]))) for a in range(n) for _ in range(links)}
    pairs = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    return [(a, b, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))]


@pytest.mark.parametrize("order,block_rows", [(2, 1 << 14), (2, 300), (1, 300)])
def test_embedding_trains_at_its_defaults(spark, order, block_rows):
    """1,000 vertices, default samples, rate and width, in one block and in four."""
    rows = community_edges(1000, 16, 12, 5)
    p = em.EmbedParams(order=order, block_rows=block_rows)
    vec = {r.idx: np.array(r.vec) for r in em.embed(edge_frame(spark, rows), p).collect()}
    start = em.initial_vectors(spark.createDataFrame([(i,) for i in vec], "idx bigint"), p)
    first = {r.idx: np.array(r.emb) for r in start.collect()}
    assert not any(np.array_equal(vec[i], first[i]) for i in vec)
    unit = {i: v / np.linalg.norm(v) for i, v in vec.items()}
    rng, ids = np.random.default_rng(0), sorted(vec)
    linked = np.mean([unit[a] @ unit[b] for a, b, _ in rows])
    random_pairs = np.mean([unit[a] @ unit[b] for a, b in rng.choice(ids, (5000, 2))])
    assert linked > random_pairs + 0.3


@pytest.mark.parametrize("blocks", [1, 2, 5, 8])
def test_every_pair_of_blocks_meets_once(blocks):
    met = Counter(tuple(sorted((a, b))) for k, r in enumerate(em.rounds_of(blocks)) for a, b in enumerate(r) if k == 0 or a < b)
    assert met == Counter({(a, b): 1 for a in range(blocks) for b in range(a, blocks)})
    assert all(r[r[a]] == a for r in em.rounds_of(blocks) for a in range(blocks))


def test_one_batch_equals_the_plain_loop():
    p = em.EmbedParams(dim=3, negative=2, samples=40, batch=1)
    rng = np.random.default_rng(4)
    emb, ctx, degree = rng.normal(size=(5, 3)), rng.normal(size=(5, 3)), np.array([1.0, 2, 3, 4, 5])
    edges = np.array([0, 1, 2]), np.array([3, 4, 0]), np.array([1.0, 2.0, 3.0])
    e, c, draw = emb.copy(), ctx.copy(), np.random.default_rng(9)
    em.train_meeting(emb, ctx, degree, edges, 40, 0, p, np.random.default_rng(9))
    by_weight, by_degree = np.cumsum(edges[2]), np.cumsum(degree**0.75)
    for k in range(40):
        rate = 0.025 * max(1 - k / 41, 1e-4)
        pick = np.searchsorted(by_weight, draw.random(1) * 6.0, "right")[0]
        noise = np.searchsorted(by_degree, draw.random((1, 2)) * by_degree[-1], "right")[0]
        u, own = edges[0][pick], e[edges[0][pick]].copy()
        g = [((t == 0) - 1 / (1 + np.exp(-own @ c[v]))) * rate for t, v in enumerate((edges[1][pick], *noise))]
        before = c.copy()
        for gk, v in zip(g, (edges[1][pick], *noise)):
            e[u] = e[u] + gk * before[v]
            c[v] = c[v] + gk * own
    assert np.allclose(e, emb) and np.allclose(c, ctx)


def test_sampling_follows_weights(spark):
    rows = [(i, i + 1, float(1 + i % 4)) for i in range(400)]
    total = sum(w for *_, w in rows)
    got = em.sample_edges(edge_frame(spark, rows), 20_000, 1, 0).agg(F.sum("times")).first()[0]
    assert got == pytest.approx(20_000, rel=0.02)
    heavy = em.sample_edges(edge_frame(spark, rows), 20_000, 1, 0).filter("id1 % 4 = 3").agg(F.sum("times")).first()[0]
    assert heavy == pytest.approx(20_000 * 400 / total, rel=0.03)


def test_negative_cells_cover_the_table_once(spark):
    vertices = spark.createDataFrame([(i, float(i + 1)) for i in range(50)], "idx bigint, degree double")
    cells = em.negative_cells(vertices, 1000).collect()
    assert sorted(r.cell for r in cells) == list(range(1000))
    share = np.bincount([r.idx for r in cells], minlength=50) / 1000
    want = np.arange(1, 51) ** 0.75
    assert np.allclose(share, want / want.sum(), atol=0.002)


def test_evidence_changes_posteriors_as_defined(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 2))
    ve = rng.dirichlet(np.ones(2), 20)
    params = [(np.zeros(2), np.eye(2)), (np.ones(2), 2 * np.eye(2))]
    joint = log_densities(x, params) + np.log(ve ** 0.5 + 1e-250)
    want = np.exp(joint - lse(joint, 1)[:, None])
    feats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, features array<double>")
    evid = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ve)], "idx bigint, post array<double>")
    got = mixture.posterior_with_evidence(feats, params, evid, 1.0).orderBy("idx").collect()
    assert np.allclose([r.post for r in got], want)


def test_mixture_separates_two_clouds(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (30, 2)), rng.normal(8, 1, (30, 2))])
    feats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, features array<double>")
    chain = edge_frame(spark, [(i, i + 1, 1.0) for i in range(59)])
    got = mixture.mixture_with_propagation(feats, swap_union(chain), 2, loops=2, rounds=2).orderBy("idx").collect()
    labels = [r.label for r in got]
    assert len(set(labels[:30])) == 1 and len(set(labels[30:])) == 1 and labels[0] != labels[-1]
    assert np.allclose([sum(r.post) for r in got], 1)
