"""Operators that take the whole table and drop what is missing themselves; queries over all ids."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check import TABLES, canonical
from loopweave.operators import contacts as ct

DATA = "/root/testdata/sf0.001"


def test_lost_halves_may_be_rows_without_a_place(spark):
    half = "line int, chrom string, start int, end int, weight int"
    first = spark.createDataFrame([(1, "chr1", 0, 5, 7), (2, None, 0, 5, 7), (3, "chr1", 1, 2, 7), (4, "chr2", 1, 2, 7)], half)
    second = spark.createDataFrame([(1, "chr2", 3, 4, 0), (2, "chr2", 3, 4, 0), (3, "chr1", None, 4, 0)], half)
    assert [tuple(r) for r in ct.rejoined(first, second).collect()] == [(1, "chr1", 0, 5, "chr2", 3, 4, 7)]


def test_bins_by_flag_and_cells_without_weight(spark):
    bins = spark.createDataFrame([("a", k, k % 3 != 1) for k in range(6)], "chrom string, pos long, good boolean")
    got = ct.index_bins(bins, valid="good")
    assert sorted((r["pos"], r["idx"]) for r in got.collect()) == [(0, 0), (2, 1), (3, 2), (5, 3)] and "good" not in got.columns
    cells = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, None), (3, 1, 4)], "id1 long, id2 long, weight long")
    assert sorted(tuple(r) for r in ct.drop_empty(cells).collect()) == [(1, 1, 2), (1, 2, 3)]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["edge_lookup_all_bins", "lifted_pairs", "matrix_drop_empty", "contact_index", "quota_graph_reference_base", "adjacency_lists_whole_map"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = canonical(queries()[name](spark, DATA).toPandas()), canonical(con.sql(oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    for c in got.columns:
        assert got[c].dtype.kind == want[c].dtype.kind and (got[c] == want[c]).all(), c
