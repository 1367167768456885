"""Labels of intervals by rows of labels against the bin by bin way."""

import random

from loopweave.operators import annotation as an
from loopweave.operators import evaluation as ev

RES = 10


def tables(spark, longest):
    rng = random.Random(3)
    labels = [(c, p, rng.choice("abc")) for c in ("x", "y") for p in range(150) if rng.random() < 0.7]
    rows = []
    for i in range(300):
        start = rng.randrange(1600)
        rows.append((i, rng.choice("xyz"), start, start + rng.randrange(-3, longest * RES)))
    rows += [(900, "x", None, 5), (901, None, 0, 30), (902, "x", 5, 5)]
    regions = spark.createDataFrame(rows, "region_id bigint, chrom string, start bigint, end bigint")
    arms = spark.createDataFrame([(c, a, n) for c in ("x", "y") for a, n in (("p", 777), ("q", 723))], "chrom string, arm string, size bigint")
    return regions, spark.createDataFrame(labels, "chrom string, pos bigint, label string"), arms


def sides(regions):
    return regions.selectExpr("region_id", "chrom chrom1", "start start1", "`end` end1")


def test_interval_labels_equal_those_by_bin(spark):
    for longest in (20, 90):
        regions, labels, _ = tables(spark, longest)
        got = an.interval_label(sides(regions), labels, RES, "1").orderBy("region_id")
        want = an._long_interval_label(sides(regions), labels, RES, "1").orderBy("region_id")
        assert got.collect() == want.select(got.columns).collect()


def test_intervals_are_not_spread_over_their_bins(spark):
    regions, labels, _ = tables(spark, 20)
    plan = an.interval_label(sides(regions), labels, RES, "1", longer=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan


def test_agreement_of_long_regions_and_repeated_ids(spark):
    regions, labels, arms = tables(spark, 60)
    by_arm = an.shift_arm_labels(an.arm_labels(labels, arms, RES), arms, RES, [0.0, 0.3])
    more = regions.union(regions.filter("region_id % 9 = 0").selectExpr("region_id", "chrom", "start + 200", "`end` + 200"))
    for some in (regions.filter(an.row_fits(RES)), regions, more):
        whole = some.select("region_id", "chrom", "start", "end")
        rows = ev._any_regions(whole, by_arm, arms, RES, ["rep"], [0, 1])
        want = {}
        for r in rows.filter(f"label is not null and labelled / {RES} > 3").collect():
            want.setdefault(r.rep, []).append(r.weight / r["all"])
        got = {r.rep: r.agreement for r in ev.region_agreement(some, by_arm, arms, RES, ["rep"], [0, 1]).collect()}
        assert got.keys() == want.keys()
        for rep, shares in want.items():
            assert abs(got[rep] - sum(shares) / len(shares)) < 1e-12
