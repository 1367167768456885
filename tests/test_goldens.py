"""Values worked out by hand or by an independent formula."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.functions.tails import binomial_upper_tail, normal_upper_tail
from loopweave.operators import annotation as an
from loopweave.operators import balance as bl
from loopweave.operators import contacts as ct
from loopweave.operators import evaluation as ev
from loopweave.operators import tracks as tk


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_binning_is_length_weighted(spark):
    df = frame(
        spark, [("chr1", 0, 150, 2.0), ("chr1", 150, 420, 4.0), ("chr1", 500, 510, 1.0), ("chr1", 7, 7, 9.0)],
        "chrom string, start bigint, end bigint, value double",
    )
    got = {r.pos: r.value for r in tk.bin_track(df, 100).collect()}
    assert got == {0: 2.0, 1: 3.0, 2: 4.0, 3: 4.0, 4: 4.0, 5: 1.0}


def test_chunk_lengths(spark):
    bins = [("chr1", p) for p in (0, 1, 2, 5, 6)] + [("chr2", 0), ("chr2", 1)]
    got = an.chunks(frame(spark, bins, "chrom string, pos bigint"), block=2).orderBy("chrom", "start").collect()
    assert [r.n for r in got] == [3, 2, 2]


def test_segments_split_at_gaps(spark):
    rows = [("chr1", 0, "a"), ("chr1", 1, "a"), ("chr1", 2, "b"), ("chr1", 5, "b")]
    got = an.segments(frame(spark, rows, "chrom string, pos bigint, label string"), 10, block=2)
    assert sorted(tuple(r) for r in got.collect()) == [
        ("chr1", 0, 20, "a"), ("chr1", 20, 30, "b"), ("chr1", 50, 60, "b"),
    ]


def test_melting_segments_gives_the_bins_back(spark):
    rows = [("chr1", p, "ab"[p % 7 // 4]) for p in range(0, 50) if p % 11]
    bins = frame(spark, rows, "chrom string, pos bigint, label string")
    back = an.melt(an.segments(bins, 10, block=8), 10).select("chrom", "pos", "label").collect()
    assert sorted(map(tuple, back)) == sorted(rows)


def test_changes_and_mean_run_length(spark):
    rows = list(enumerate("aabbbc"))
    df = frame(spark, rows, "idx bigint, label string")
    assert an.label_changes(df, block=2).first()[0] == 2
    assert an.mean_run_length(df, 1, block=2).first()[0] == 2.5


def test_most_frequent_label_of_a_region(spark):
    labels = frame(spark, [("chr1", 0, "a"), ("chr1", 1, "b")], "chrom string, pos bigint, label string")
    regions = frame(
        spark, [(1, "chr1", 5, 20), (2, "chr1", 5, 15), (3, "chr1", 18, 60)],
        "region_id bigint, chrom string, start bigint, end bigint",
    )
    got = {r.region_id: r.label for r in an.region_label(regions, labels, 10).collect()}
    assert got == {1: "b", 2: "a", 3: None}


def test_variance_explained(spark):
    df = frame(spark, list(zip([1.0, 2.0, 3.0, 10.0, 12.0], "aaabb")), "signal double, label string")
    assert ev.variance_explained(df).first()[0] == pytest.approx(0.9604743083)


def test_point_contacts_over_expected(spark):
    shares = ev.label_shares(frame(spark, [(c,) for c in "aaabbc"], "label string"))
    pairs = frame(spark, [tuple(p) for p in ("aa", "ab", "bb", "bb", "ca")], "label1 string, label2 string")
    got = ev.intra_over_expected(ev.contingency(pairs), shares, on_both_axes=True).first()[0]
    assert got == pytest.approx(1.6615384615)


def test_morans_i_on_a_path(spark):
    values = frame(spark, [(0, 1.0), (1, 2.0), (2, 3.0), (3, 5.0)], "idx bigint, value double")
    edges = ct.swap_union(frame(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "id1 bigint, id2 bigint, weight double"))
    got = ev.morans_i(values, edges).first()
    assert got.moran == pytest.approx(0.2571428571)
    assert got.expected == pytest.approx(-0.3333333333)
    assert got.variance == pytest.approx(0.1396825397)
    assert got.z_score == pytest.approx(1.5799062935)
    assert got.p_value == pytest.approx(0.0570641639)


MATRIX = [(0, 0, 2.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 4.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 6.0)]


def test_balancing_small_matrix(spark):
    cells = frame(spark, MATRIX, "id1 bigint, id2 bigint, weight double")
    x = {r.idx: r.x for r in bl.balance(cells, tol=1e-9).collect()}
    assert [x[i] for i in range(3)] == pytest.approx([0.616071, 0.391049, 0.376959], abs=1e-6)
    fixed = {r.idx: r.x for r in bl.equilibrate(cells, 40).collect()}
    assert [fixed[i] for i in range(3)] == pytest.approx([x[i] for i in range(3)], abs=1e-8)
    mean = sum(1 / v for v in x.values()) / 3
    assert [1 / x[i] / mean for i in range(3)] == pytest.approx([0.712632, 1.122703, 1.164665], abs=1e-6)


def test_balanced_rows_sum_to_one(spark):
    rng = np.random.default_rng(5)
    n = 40
    a = rng.integers(0, 9, (n, n)) * (rng.random((n, n)) < 0.4)
    a = (a + a.T + np.eye(n) * 3).astype(float)
    cells = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    x = np.array([r.x for r in bl.balance(frame(spark, cells, "id1 bigint, id2 bigint, weight double")).orderBy("idx").collect()])
    assert np.allclose(x * (a @ x), 1, atol=1e-5)


def test_bias_marks_the_sparsest_bins(spark):
    rows = [(i, j, 1.0 + (i * j) % 5) for i in range(40) for j in range(i, 40) if (i + j) % 3]
    df = frame(spark, rows, "id1 bigint, id2 bigint, weight double")
    bias = {r.idx: r.bias for r in bl.bias_vector(df).collect()}
    sums = np.zeros(40)
    for i, j, w in rows:
        sums[i] += w
        sums[j] += w
    limit = np.sort(sums)[int(0.05 * 40)]
    assert {i for i, b in bias.items() if b == -1} == {i for i in range(40) if sums[i] <= limit}
    assert np.mean([b for b in bias.values() if b != -1]) == pytest.approx(1.0)


def test_pair_quota(spark):
    bins = frame(spark, [(1, p) for p in range(20)] + [(2, p) for p in range(10)], "chrom bigint, pos bigint")
    got = {(r.chrom1, r.chrom2): r.k for r in ct.pair_quotas(bins, 5).collect()}
    assert got == {(1, 1): 20, (1, 2): 10, (2, 2): 5}


def test_invalid_bins_use_up_the_quota(spark):
    dump = frame(
        spark, [(1, 0, 1, 1, 9.0), (1, 0, 1, 2, 8.0), (1, 1, 1, 2, 1.0), (1, 2, 1, 2, 99.0)],
        "chrom1 bigint, pos1 bigint, chrom2 bigint, pos2 bigint, weight double",
    )
    bins = ct.index_bins(frame(spark, [(1, 0), (1, 2)], "chrom bigint, pos bigint"))
    got = ct.quota_graph(dump, bins, 2).select("id1", "id2").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (1, 0)]


def test_tail_probabilities(spark):
    df = frame(spark, [(k, 20, 0.3, k / 4 - 2) for k in range(21)], "k bigint, n bigint, p double, z double")
    for r in df.select("k", "z", binomial_upper_tail("k", "n", "p").alias("b"), normal_upper_tail("z").alias("t")).collect():
        exact = sum(math.comb(20, i) * 0.3**i * 0.7 ** (20 - i) for i in range(r.k, 21))
        assert r.b == pytest.approx(exact, rel=1e-10)
        assert r.t == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)))


def test_symmetric_union_properties(spark):
    rows = [(1, 2, 3.0), (2, 2, 1.0), (4, 1, 2.0)]
    df = frame(spark, rows, "id1 bigint, id2 bigint, weight double")
    both = sorted(map(tuple, ct.both_directions_with_loops(df).collect()))
    assert both == sorted([(1, 2, 3.0), (2, 1, 3.0), (2, 2, 1.0), (4, 1, 2.0), (1, 4, 2.0)])
    assert sorted(tuple(r) for r in ct.both_directions(df).collect()) == [x for x in both if x[0] != x[1]]
    assert ct.swap_union(df).count() == 6


def test_nan_weights_never_win(spark):
    dump = frame(
        spark, [(1, 0, 1, 1, float("nan")), (1, 0, 1, 2, 1.0), (1, 1, 1, 2, None)],
        "chrom1 bigint, pos1 bigint, chrom2 bigint, pos2 bigint, weight double",
    )
    assert [r.pos2 for r in ct.strongest(dump, 2).collect()] == [2]


def test_shifted_labels_stay_in_their_arm(spark):
    arms = frame(spark, [("chr1", "p", 50), ("chr1", "q", 70)], "chrom string, arm string, size bigint")
    labels = frame(spark, [("chr1", p, f"l{p}") for p in range(12)], "chrom string, pos bigint, label string")
    by_arm = an.arm_labels(labels, arms, 10)
    moved = an.shift_arm_labels(by_arm, arms, 10, [0.5]).collect()
    assert {(r.arm, r.arm_pos): r.label for r in moved if r.arm == "p"} == {
        ("p", (i + 2) % 5): f"l{i}" for i in range(5)
    }
    assert {(r.arm, r.arm_pos): r.label for r in moved if r.arm == "q"} == {
        ("q", (i + 3) % 7): f"l{i + 5}" for i in range(7)
    }


def test_coverage_sums_to_one(spark):
    segs = frame(spark, [("chr1", 0, 30, "a"), ("chr1", 30, 40, "NA"), ("chr2", 0, 10, "b")], "chrom string, start bigint, end bigint, label string")
    got = {r.label: r.coverage for r in ev.coverage(segs).collect()}
    assert got == {"a": 0.75, "b": 0.25}
    ent = ev.entropy(ev.coverage(segs)).first()[0]
    assert ent == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))


def test_constant_signal_is_not_divided_by_zero_in_rand(spark):
    df = frame(spark, [("x", "y")] * 4, "label1 string, label2 string")
    assert ev.adjusted_rand(df).select(F.col("ari")).first()[0] == 1.0
