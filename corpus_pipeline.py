"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.llm import decontam, langid, pieces, setjoin, toxicity
from loopweave.llm.common import bound_batches, set_aside, stored, table

#: A text whose cosine with every learned language is below this resembles none of them: three deviations of
#: the cosine of two unrelated vectors, which a text without a trigram of four languages passes once in 190.
LEAST_LANGUAGE_SCORE = 3 / langid.WIDTH**0.5
#: A text with fewer letters has too few trigrams to tell; it stays under its best language.
LEAST_LETTERS = 32


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without a letter go, and longer ones like no language; ``lang`` becomes the predicted one.

    Null and empty texts hold no letter and go. An empty table, or one without a learned language, comes out
    empty. All other columns come out as they were, whatever their names.
    """
    bound_batches(spark)
    aside, own = set_aside(docs, "lang_pred", "score")
    found = langid.identify(aside, langid.learn(aside))
    short = F.length(F.regexp_replace("text", "\\P{L}", "")) < LEAST_LETTERS
    kept = found.filter((F.col("lang_pred") != "und") & ((F.col("score") >= LEAST_LANGUAGE_SCORE) | short))
    return own(kept.withColumn("lang", F.col("lang_pred")))


def toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts scored as toxic go.

    Null and empty texts are scored by the model's bias alone. Without labelled rows nothing goes. All columns
    come out as they were, whatever their names.
    """
    aside, own = set_aside(docs, "tox_score", "tox_label")
    model = toxicity.train(aside, table(spark, folder, "labels"))
    return own(toxicity.score(aside, model).filter("tox_label = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near copies stays (five words, similarity 0.8 or more).

    Rows with null or wordless texts all stay. An empty table stays empty. All columns come out as they were,
    whatever their names.
    """
    return setjoin.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages of benchmark items are cut out; a document that is mostly such passages goes.

    Null and wordless texts stay as they are; null items take no part. All columns but ``text`` and ``n_chars``
    come out as they were, whatever their names.
    """
    return decontam.remove_contamination(docs, table(spark, folder, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, ids, n_ids, exact of every document left.

    A null text has nulls in all but doc_id, an empty one no ids. Other columns are ignored.
    """
    return pieces.encode_documents(docs, with_text=False).select("doc_id", "ids", "n_ids", "exact")


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("sentencepiece", encode),
]

#: SQL cannot express the learned stages; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
