"""Inputs beyond the sizes that used to be cut."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave import __main__ as cli
from loopweave.functions.tails import incomplete_beta
from loopweave.operators.balance import forcing_term
from loopweave.sources import readers, writers


def test_embedding_of_one_dimension_and_of_many(spark, tmp_path):
    for width in (1, 3000):
        vec = spark.createDataFrame([(k, [float(k + j % 7) for j in range(width)]) for k in range(4)], "idx bigint, vec array<double>")
        writers.write_embedding(vec, f"{tmp_path}/e{width}")
        got = {r["name"]: r["vec"] for r in readers.read_embedding(spark, f"{tmp_path}/e{width}").collect()}
        assert got == {str(r["idx"]): r["vec"] for r in vec.collect()}


def test_long_names_stay_apart(spark, tmp_path):
    stem = "n" * 150
    (tmp_path / "net").write_text(f"{stem}a {stem}b 2\n{stem}b {stem}c 1\n")
    got = readers.read_network(spark, str(tmp_path / "net")).collect()
    assert {r["u"] for r in got} | {r["v"] for r in got} == {stem + c for c in "abc"}


def test_lines_follow_the_paths_of_several_folders(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        for part in (0, 1):
            (tmp_path / folder / f"part-{part}").write_text(f"{folder}{part}\n")
    got = readers.numbered_lines(spark, f"{tmp_path}/*").orderBy("line")
    assert [r["value"] for r in got.collect()] == ["a0", "a1", "b0", "b1"]


@pytest.mark.parametrize("n", [1e4, 1e8, 1e12])
def test_upper_tail_of_large_counts(n):
    got = incomplete_beta(np.array([n / 2]), np.array([n / 2 + 1]), np.array([0.5]))[0]
    assert abs(got - (0.5 + 0.5 * math.sqrt(2 / (math.pi * n)) * (1 - 1 / (4 * n)))) < 1e-9


def test_both_forms_of_the_tail_meet():
    from loopweave.functions import tails

    a, b = np.array([8e5, 2e5, 5e5]), np.array([4e5, 9e5, 5e5])
    x = a / (a + b) + np.array([-2.0, 0.5, 1.0]) * np.sqrt(a * b / (a + b) ** 3)
    whole = np.where(x > (a + 1) / (a + b + 2), 1 - tails._fraction(b, a, 1 - x), tails._fraction(a, b, x))
    assert np.allclose(tails._expansion(a, b, x), whole, atol=1e-8)


def test_instances_stay_sparse_and_are_checked(spark, tmp_path):
    (tmp_path / "good").write_text("+1 2:0.5 1000000:3\n-1 1:0 7:1\n2\n")
    rows = readers.read_instances(spark, str(tmp_path / "good"), bias=1.0).collect()
    assert [(r["label"], r["index"], r["value"]) for r in rows] == [
        (1.0, [1, 999_999, 1_000_000], [0.5, 3.0, 1.0]), (-1.0, [6, 1_000_000], [1.0, 1.0]), (2.0, [1_000_000], [1.0])
    ]
    for bad in ("1 3:1 2:1", "1 0:1", "1 x:1", "one 1:1", "1 5"):
        (tmp_path / "bad").write_text(f"1 1:1\n{bad}\n")
        with pytest.raises(Exception, match="line 2"):
            readers.read_instances(spark, str(tmp_path / "bad")).collect()


def test_forcing_term():
    assert forcing_term(0.0, 1.0, 0.1, 1e-6) == 0.1
    assert forcing_term(0.5, 1.0, 0.1, 1e-6) == 0.1
    assert forcing_term(1e-4, 1e-2, 0.1, 1e-6) == pytest.approx(0.009)
    assert forcing_term(1e-12, 1.0, 0.01, 1e-6) == pytest.approx(0.5)


def test_command_line_of_the_toolkit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda *a, **k: spark)
    (tmp_path / "net").write_text("a b 1\nb a 1\nb c 2\nc b 2\n")
    cli.main(["embed", "-i", f"{tmp_path}/net", "-o", f"{tmp_path}/vec", "--dim", "3", "--samples", "500"])
    cli.main(["normalise", "-i", f"{tmp_path}/vec", "-o", f"{tmp_path}/unit"])
    cli.main(["concatenate", "-i", f"{tmp_path}/vec", "-j", f"{tmp_path}/unit", "-o", f"{tmp_path}/both"])
    both = readers.read_embedding(spark, f"{tmp_path}/both").collect()
    assert len(both) == 3 and all(len(r["vec"]) == 6 and abs(sum(x * x for x in r["vec"]) - 2) < 1e-4 for r in both)
    cli.main(["densify", "-i", f"{tmp_path}/net", "-o", f"{tmp_path}/dense", "-k", "5"])
    assert readers.tsv(spark, f"{tmp_path}/dense", "a bigint, b bigint, w double").count() >= 4
    (tmp_path / "data").write_text("1 1:1\n-1 2:1\n1 1:2\n-1 2:3\n")
    cli.main(["train", "-i", f"{tmp_path}/data", "-o", f"{tmp_path}/model", "-n", "2", "-s", "0"])
    cli.main(["predict", "-i", f"{tmp_path}/data", "-m", f"{tmp_path}/model", "-o", f"{tmp_path}/out"])
    got = readers.tsv(spark, f"{tmp_path}/out", "label double, prediction double")
    assert got.filter(F.col("label") != F.col("prediction")).count() == 0 and got.count() == 4


def test_scratch_is_cleared(spark):
    from loopweave import session

    before = list(session._handed_out)
    session._handed_out.clear()
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert session.clear_scratch(spark) == 1 and session.clear_scratch(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    session._handed_out.extend(before)
