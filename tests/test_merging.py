"""Adaptive execution may not merge partitions into tasks that grow with the input."""

from pathlib import Path

import pytest

from loopweave.catalog.domain import table
from loopweave.session import MERGED_BYTES, bound_merging

SETTING = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def setting(spark):
    before = spark.conf.get(SETTING)
    yield
    spark.conf.set(SETTING, before)


def test_large_settings_give_way_and_smaller_ones_stay(spark, setting):
    for given, want in (("64MB", str(MERGED_BYTES)), ("67108864b", str(MERGED_BYTES)), ("16k", "16k"), ("8m", "8m")):
        spark.conf.set(SETTING, given)
        bound_merging(spark)
        assert spark.conf.get(SETTING) == want


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_queries_bound_the_merging(spark, setting):
    spark.conf.set(SETTING, "64m")
    table(spark, "/root/testdata/sf0.001", "orders")
    assert spark.conf.get(SETTING) == str(MERGED_BYTES)
