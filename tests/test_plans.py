"""Order-dependent plans against plain Python, with blocks small enough to split everything."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loopweave.plans import scan
from loopweave.plans.topk import top_k


def runs_of(rows):
    out = []
    for chrom, pos, label in sorted(rows):
        if out and out[-1][0] == chrom and out[-1][2] == pos and out[-1][3] == label:
            out[-1][2] = pos + 1
        else:
            out.append([chrom, pos, pos + 1, label])
    return sorted(map(tuple, out))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    cells=st.dictionaries(
        st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 40)), st.sampled_from(["x", "y"]), min_size=1
    ),
    block=st.sampled_from([1, 4, 7, 1000]),
)
def test_islands_match_a_sequential_scan(spark, cells, block):
    rows = [(c, p, v) for (c, p), v in cells.items()]
    df = spark.createDataFrame(rows, "chrom string, pos bigint, label string")
    got = scan.islands(df, ["chrom"], "pos", "label", block).select("chrom", "start", "stop", "label").collect()
    assert sorted(map(tuple, got)) == runs_of(rows)


def test_position_index_is_dense_over_blocks(spark):
    rows = [(r, p) for r in (2, 1) for p in random.Random(1).sample(range(300), 60)]
    df = spark.createDataFrame(rows, "rank int, pos bigint")
    got = {(x.rank, x.pos): x.idx for x in scan.position_index(df, "rank", block=16).collect()}
    assert got == {key: i for i, key in enumerate(sorted(rows))}


def test_dense_index_with_a_hot_leading_value(spark):
    rows = [(0 if i % 3 else i, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    got = [(x.idx, x.a, x.b) for x in scan.dense_index(df, ["a", "b"]).collect()]
    assert sorted(got) == [(i, *row) for i, row in enumerate(sorted(rows))]


@pytest.mark.parametrize("block", [3, 50, 10_000])
def test_nearest_valid_matches_brute_force(spark, block):
    rng = random.Random(block)
    positions = {c: sorted(rng.sample(range(200), 15)) for c in ("p", "q")}
    bins = [(c, p, i) for i, (c, p) in enumerate((c, p) for c in ("p", "q") for p in positions[c])]
    index = {(c, p): i for c, p, i in bins}
    asked = [(c, p) for c in ("p", "q") for p in range(0, 210, 3)] + [("p", 9)] * 40
    got = scan.nearest_valid(
        spark.createDataFrame(asked, "chrom string, pos bigint"),
        spark.createDataFrame(bins, "chrom string, pos bigint, idx bigint"),
        block=block,
    ).collect()
    assert len(got) == len(set(asked))
    for r in got:
        after = [p for p in positions[r.chrom] if p >= r.pos]
        before = [p for p in positions[r.chrom] if p <= r.pos]
        assert r.next_idx == (index[r.chrom, after[0]] if after else None)
        assert r.last_idx == (index[r.chrom, before[-1]] if before else None)


def test_running_offset_and_carry_forward(spark):
    rows = [(i, (i * 7) % 5, "h" if i % 11 == 0 else None) for i in range(100)]
    df = spark.createDataFrame([(i, n, f"{v}{i}" if v else None) for i, n, v in rows], "o bigint, n bigint, v string")
    total, offsets, value, values = 0, {}, None, {}
    for i, n, v in rows:
        offsets[i], total = total, total + n
        value = f"{v}{i}" if v else value
        values[i] = value
    assert {r.o: r.offset for r in scan.running_offset(df, "o", "n", block=8).collect()} == offsets
    carried = scan.carry_forward(df.withColumn("k", F.lit(1)), ["k"], "o", "v", block=8)
    assert {r.o: r.v for r in carried.collect()} == values


def test_top_k_keeps_exact_rows_of_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randrange(30), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, w bigint, id bigint")
    got = top_k(df, ["g"], [F.col("w").desc()], 25, ["id"], salts=4).collect()
    want = []
    for g in {r[0] for r in rows}:
        want += sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:25]
    assert sorted(map(tuple, got)) == sorted(want)
