"""What several scores of the bootstrap read is computed and stored once."""

from loopweave.catalog import resampling

TINY = "/root/testdata/sf0.001"


def test_bootstrap_scores_share_their_inputs(spark, monkeypatch):
    read = []
    for name in ("dump", "known_labels"):
        own = getattr(resampling, name)
        monkeypatch.setattr(resampling, name, lambda *a, own=own, name=name: read.append(name) or own(*a))
    rows = resampling.bootstrap_stats(spark, TINY).collect()
    assert sorted(read) == ["dump", "known_labels"]
    assert len(rows) == resampling.REPS


def test_filters_on_contacts_stay_above_their_sums(spark):
    far = resampling.drawn_contacts(spark, TINY).filter("chrom1 <> chrom2")
    plan = far._jdf.queryExecution().optimizedPlan().toString()
    assert "least(" not in plan and "LogicalRDD" in plan
