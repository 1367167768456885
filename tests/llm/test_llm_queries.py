"""The numbered queries over the given tables: SQL where there is some, plain versions elsewhere."""

import re
import zlib
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, canonical
from loopweave.llm import decontam, pieces, toxicity
from loopweave.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = canonical(QUERIES[name](spark, DATA).toPandas()), canonical(con.sql(ORACLE[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        assert got[c].dtype.kind == want[c].dtype.kind, c
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").toPandas()
    got = QUERIES["op2_language_id"](spark, LARGER).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_toxicity_of_labelled_documents(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").toPandas()
    got = QUERIES["op3_toxicity"](spark, LARGER).toPandas()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() == 0
    assert (held.predicted == held.toxic).mean() > 0.93


def test_shards_of_the_documents(spark):
    got = QUERIES["op5_kd_sharding"](spark, DATA).toPandas()
    by = got.groupby("shard").agg(b=("size", "sum"), n=("slot", "count"), top=("slot", "max"), distinct=("slot", "nunique"))
    assert list(by.index) == list(range(8)) and (by.top + 1 == by.n).all() and (by.distinct == by.n).all()


def test_captures_of_the_pages(spark):
    got = QUERIES["op6_warc"](spark, DATA).toPandas()
    pages = spark.read.parquet(f"{DATA}/pages.parquet").toPandas()
    both = got.merge(pages, on="page_id")
    assert len(both) == len(pages) and (both.payload_bytes == both.html.map(lambda h: len(h.encode()))).all()


def test_main_text_of_the_pages(spark):
    import html

    got = QUERIES["op9_main_text"](spark, DATA).toPandas()
    pages = spark.read.parquet(f"{DATA}/pages.parquet").toPandas()
    for r in got.merge(pages, on="page_id").itertuples():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)[^>]*>", article))
        assert r.text == " ".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_pipeline_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = stage(spark, docs, DATA).cache()
        after = docs.toPandas()
        if name == "language_id":
            assert set(before.doc_id) - set(after.doc_id) == {d for d, t in zip(before.doc_id, before.text) if not re.search(r"[^\W\d_]", t)}
        if name == "toxicity":
            model = toxicity.train(spark.createDataFrame(before[["doc_id", "text"]]), spark.read.parquet(f"{DATA}/labels.parquet"))
            features = toxicity.Features()
            gone = {d for d, t in zip(before.doc_id, before.text) if model.raw(features.text(t)) >= 0}
            assert set(before.doc_id) - set(after.doc_id) == gone
        if name == "ngram_jaccard_join":
            from test_joins_and_shards import brute_classes

            classes = brute_classes(list(zip(before.doc_id, before.text)), 5, 8, 10)
            assert set(after.doc_id) == {d for d, n, c in classes if not n or d == c}
        if name == "benchmark_decontamination":
            items = spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas()
            automaton = decontam.ItemAutomaton([(str(i), decontam.words_of(t)) for i, t in zip(items.item_id, items.text)])
            old = dict(zip(before.doc_id, before.text))
            for d, t in zip(after.doc_id, after.text):
                hit, _ = automaton.hits(automaton.codes(decontam.words_of(old[d])))
                assert (t == old[d]) == (not hit.any())
                assert len(decontam.words_of(t)) == len(hit) - hit.sum()
        if name == "sentencepiece":
            codec, old = pieces.codec(pieces.default_path()), dict(zip(before.doc_id, before.text))
            assert all(codec.decode(list(i)) == old[d] for d, i in zip(after.doc_id, after.ids)) and set(after.doc_id) == set(before.doc_id)
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()
