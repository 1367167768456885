"""Stages and operators on empty tables, null texts and columns whose names they need themselves."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loopweave.llm import decontam, html, langid, setjoin, urls
from loopweave.llm.common import set_aside

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
CLASHES = [
    "score", "Lang_Pred", "tox_score", "TOX_label", "_key", "_look", "_id", "_gone", "key", "rows", "n_words", "hit_words", "hit_items",
]


def with_clashes(df, names=CLASHES):
    """Every extra column holds its own name and the row's text size."""
    return df.select("*", *[F.concat(F.lit(c), F.coalesce(F.length("text"), F.lit(-1)).cast("string")).alias(c) for c in names])


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 10_000_000)
    odd = odd.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("")))
    return docs.union(odd).cache()


def test_set_aside_renames_and_returns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, A_1 int, `b.c` int, text int")
    aside, own = set_aside(df, "a", "B.C")
    assert aside.columns == ["a_2", "A_1", "b.c_1", "text"]
    assert own(aside.withColumn("a", F.lit(9)), "a").toDF("w", "x", "y", "z", "more").collect() == [(1, 2, 3, 4, 9)]
    assert set_aside(df, "z")[0] is df


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_with_clashing_columns(spark, documents, name, stage):
    plain = stage(spark, documents, DATA)
    got = stage(spark, with_clashes(documents), DATA)
    if name == "sentencepiece":
        assert got.columns == plain.columns
    else:
        assert got.columns == documents.columns + CLASHES
        before = {r["doc_id"]: r for r in with_clashes(documents).collect()}
        for r in got.collect():
            assert all(r[c] == before[r["doc_id"]][c] for c in CLASHES)
    show = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    assert show(got) == show(plain)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_of_an_empty_table(spark, documents, name, stage):
    got = stage(spark, with_clashes(documents).filter("doc_id < 0"), DATA)
    assert got.count() == 0
    assert got.columns == (["doc_id", "ids", "n_ids", "exact"] if name == "sentencepiece" else documents.columns + CLASHES)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_of_null_texts(spark, documents, name, stage):
    got = stage(spark, documents.withColumn("text", F.lit(None).cast("string")), DATA)
    assert got.count() == (0 if name == "language_id" else documents.count())


def test_language_stage_rejects_a_text_of_no_learned_language(spark, documents):
    georgian = "".join(chr(0x10D0 + k) for k in range(26))
    text = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz\u00e1\u00e9\u00ed\u00f3\u00fa\u00f1\u00e4\u00f6\u00fc\u00df\u00e8\u00e0\u00e7\u00ea", georgian)
    strange = documents.filter("length(text) > 200").limit(20).withColumn("text", text)
    strange = strange.withColumn("doc_id", F.col("doc_id") + 20_000_000).withColumn("lang", F.lit(None).cast("string"))
    short = strange.limit(1).withColumn("doc_id", F.lit(30_000_000).cast("long")).withColumn("text", F.lit("\u10d0\u10d1"))
    got = corpus_pipeline.language(spark, documents.union(strange.select(*documents.columns)).union(short.select(*documents.columns)), DATA)
    assert [r["text"] for r in got.filter("doc_id >= 20000000").collect()] == ["\u10d0\u10d1"]
    assert got.count() == 1 + documents.filter(F.col("text").rlike("\\p{L}")).count()


def test_operators_keep_columns_of_their_own_names(spark, documents):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    names = ["_host", "_uid", "_Main", "_open", "_starts", "at", "suffix", "page"]
    more = pages.select("*", *[F.lit(c).alias(c) for c in names], F.lit("x").alias("Text"), F.lit(1).alias("n_chars"))
    got, plain = html.main_text(more), html.main_text(pages)
    assert got.columns == [c for c in pages.columns if c != "html"] + names + ["text", "n_chars"]
    assert got.select(*names).distinct().collect() == [tuple(names)]
    assert sorted(got.select(*plain.columns).collect(), key=str) == sorted(plain.collect(), key=str)
    known = pages.select(F.col("url").alias("text"), (F.col("page_id") % 2 == 0).alias("accepted"))
    model = urls.learn(known)
    got = urls.scored(known.select("*", F.lit("c").alias("_chunk"), F.lit("g").alias("gram"), F.lit("s").alias("lm_score")), model)
    assert got.columns == ["text", "accepted", "_chunk", "gram", "lm_score"]
    assert got.select("_chunk", "gram").distinct().collect() == [("c", "g")]
    assert got.filter("lm_score is null").count() == 0 and got.count() == known.count()
