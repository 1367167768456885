"""Iterative jobs leave nothing stored behind but their result."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave import session
from loopweave.operators import mrf

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def left_since(n):
    return [p for p in session._handed_out[n:] if os.path.exists(p.removeprefix("file:"))]


def inputs(spark, n=40):
    rng = np.random.default_rng(2)
    features = spark.createDataFrame([(i, [float(v) for v in rng.normal(i % 2, 0.4, 2)]) for i in range(n)], "idx bigint, features array<double>")
    edges = spark.createDataFrame([(a, b, 1.0) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))], "id1 bigint, id2 bigint, weight double")
    return features, edges


@pytest.mark.parametrize("most", [mrf.PART, 1])
def test_a_random_field_leaves_its_labels_only(spark, monkeypatch, most):
    layout = mrf.message_layout
    monkeypatch.setattr(mrf, "message_layout", lambda edges, **kw: layout(edges, most, **kw))
    features, edges = inputs(spark)
    params = [(np.zeros(2), np.eye(2)), (np.ones(2), np.eye(2))]
    labels = features.select("idx", (F.col("idx") % 2).alias("label"))
    n, before = len(session._handed_out), spark.conf.get(SETTING, "false")
    out = mrf.fit_random_field(features, edges, k=2, em_iter=2, lbp_iter=2, params=params, labels=labels)
    assert len(left_since(n)) == 1
    assert out.count() == 40
    assert spark.conf.get(SETTING, "false") == before


def test_shuffles_are_kept_again_after_an_error(spark):
    before = spark.conf.get(SETTING, "false")
    with pytest.raises(ValueError), session.shuffles_dropped(spark):
        assert spark.conf.get(SETTING) == "true"
        raise ValueError
    assert spark.conf.get(SETTING, "false") == before
