"""Piece coding, language ID, toxicity and decontamination against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.llm import decontam, langid, pieces, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --- pieces -----------------------------------------------------------------------------------


def field(raw, at):
    """One protocol-buffer key or length: value and the place after it."""
    value = shift = 0
    while True:
        byte = raw[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


def unigram_model(path):
    """The piece file with its model type set to unigram, for the library's own Viterbi."""
    import sentencepiece

    raw, out, at = open(path, "rb").read(), bytearray(), 0
    while at < len(raw):
        start = at
        key, at = field(raw, at)
        size, at = field(raw, at)
        body, at = raw[at : at + size], at + size
        if key >> 3 == 2:
            patched, k = bytearray(), 0
            while k < len(body):
                first = k
                inner, k = field(body, k)
                if inner & 7 == 0:
                    _, k = field(body, k)
                elif inner & 7 == 2:
                    n, k = field(body, k)
                    k += n
                else:
                    k += 8 if inner & 7 == 1 else 4
                patched += bytes([inner, 1]) if inner >> 3 == 3 else body[first:k]
            body = bytes(patched)
        out += raw[start : at - size] + body
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(out))


def test_words_are_cut_as_the_unigram_library_cuts_them():
    own, other = pieces.codec(pieces.default_path()), unigram_model(pieces.default_path())
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz.,ABCéñß0123"
    for _ in range(3000):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
        assert own.encode(word) == other.encode(word), word


def test_best_score_equals_exhaustive_search():
    own = pieces.PieceCodec([(0, "a", -3.0), (1, "ab", -4.0), (2, "b", -3.0), (3, "▁a", -2.0), (4, "ba", -3.5)], [], 9)
    score = {0: -3.0, 1: -4.0, 2: -3.0, 3: -2.0, 4: -3.5, 9: own.unknown_score}

    def best(run):
        table = [0.0] + [float("-inf")] * len(run)
        for end in range(1, len(run) + 1):
            for i, t in own.text.items():
                if run[:end].endswith(t):
                    table[end] = max(table[end], table[end - len(t)] + score[i])
            if run[end - 1] not in own.single:
                table[end] = max(table[end], table[end - 1] + own.unknown_score)
        return table[-1]

    rng = random.Random(1)
    for _ in range(500):
        run = "".join(rng.choice("ab▁x") for _ in range(rng.randint(1, 9)))
        assert sum(score[i] for i in own.solve(run)) == pytest.approx(best(run))


def test_round_trip_and_odd_rows(spark):
    texts = ["", None, " a  b ", "x\n\ty\u00a0z", "日本語\x00🙂", "a" * 5000, "▁", "same", "same"]
    rows = docs(spark, list(enumerate(texts))).withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r for r in pieces.encode_documents(rows).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i]["ids"] is None and got[i]["decoded"] is None and got[i]["exact"] is None
        elif t == "▁":
            assert got[i]["decoded"] == " " and not got[i]["exact"]
        else:
            assert got[i]["decoded"] == t and got[i]["exact"] and got[i]["n_ids"] == len(got[i]["ids"])
    assert got[7]["ids"] == got[8]["ids"]
    assert pieces.encode_documents(docs(spark, [])).count() == 0


# --- language ---------------------------------------------------------------------------------

TEXTS = {"en": "the quick brown fox jumps over the lazy dog and then", "de": "der schnelle braune fuchs springt über den faulen hund"}


def test_bundle_equals_one_trigram_at_a_time():
    packed, counts, letters = langid.trigram_counts(["Abc ab!", None, "12"])
    slow = np.zeros(langid.WIDTH)
    text = " abc ab "
    for a, b, c in zip(text, text[1:], text[2:]):
        va, vb, vc = (langid.letter_vectors(np.array([ord(x)]))[0].astype(int) for x in (a, b, c))
        slow += np.roll(va, 2) * np.roll(vb, 1) * vc
    assert np.array_equal(counts[0] @ langid.bind(packed), slow)
    assert list(letters) == [5, 0, 0]


def test_language_of_odd_rows(spark):
    train = spark.createDataFrame([(t, k) for k, t in TEXTS.items()] * 3 + [(None, "en"), ("x", None)], "text string, lang string")
    model = langid.learn(train)
    assert sorted(model) == ["de", "en"]
    rows = docs(spark, [(1, TEXTS["en"]), (2, TEXTS["de"]), (3, None), (4, ""), (5, "12 %%"), (None, "the dog"), (1, TEXTS["en"])])
    got = langid.identify(rows.withColumn("score", F.lit("clash")), model).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))] == ["en", "en", "de", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.learn(train.limit(0)) == {}
    assert {r["lang_pred"] for r in langid.identify(rows, {}).collect()} == {"und"}
    assert langid.identify(rows.limit(0), model).count() == 0


def test_short_texts_do_not_square_the_memory():
    texts = ["ab"] * 100_000
    import pyarrow as pa

    from loopweave.llm.common import slices

    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert max(p.num_rows for p in slices([batch], "text", langid.SLICE_BYTES, langid.SLICE_ROWS)) == langid.SLICE_ROWS


# --- toxicity ---------------------------------------------------------------------------------


def ids_and_labels(spark, rows):
    texts = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    return texts, spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")


def test_mention_of_a_group_does_not_score(spark):
    rng = random.Random(3)
    plain = "river stone cloud table window garden paper letter".split()
    rows = []
    for _ in range(600):
        words = [rng.choice(plain) for _ in range(12)]
        toxic = rng.random() < 0.5
        if toxic:
            words.insert(3, "zgrub")
            if rng.random() < 0.8:
                words.insert(5, "women")  # the group is mentioned mostly in toxic rows
        elif rng.random() < 0.1:
            words.insert(5, "women")
        rows.append((" ".join(words), int(toxic)))
    labelled = ids_and_labels(spark, rows)
    free = toxicity.train(*labelled, toxicity.ToxicityParams(penalty=0.0))
    bound = toxicity.train(*labelled, toxicity.ToxicityParams(penalty=20.0))
    f = toxicity.Features()
    gap = {m: m_.raw(f.text("stone women cloud")) - m_.raw(f.text("stone men cloud")) for m, m_ in (("free", free), ("bound", bound))}
    assert abs(gap["bound"]) < 0.2 * abs(gap["free"])
    assert bound.raw(f.text("stone zgrub cloud")) > 0 > bound.raw(f.text("stone cloud"))


def test_toxicity_of_odd_rows(spark):
    given, labels = ids_and_labels(spark, [(f"bad zgrub {k}", 1) for k in range(20)] + [(f"good day {k}", 0) for k in range(20)] + [(None, 1), ("x", None)])
    model = toxicity.train(given, labels)
    rows = docs(spark, [(1, None), (2, ""), (3, "zgrub " * 9000), (3, "zgrub " * 9000)]).withColumn("tox_score", F.lit(1))
    got = sorted(tuple(r) for r in toxicity.score(rows, model).select("doc_id", "tox_score", "tox_label").collect())
    assert len(got) == 4 and got[2] == got[3] and all(0 <= r[1] <= 1 and r[2] == (r[1] >= 0.5) for r in got)
    none = toxicity.train(given, labels.limit(0))
    assert {r["tox_label"] for r in toxicity.score(rows, none).collect()} == {0}


def test_swap_goes_round_a_group():
    swaps = toxicity.Swaps((("a", "b", "c"),))
    assert swaps.apply("A x b, c") == "b x c, a" and swaps.apply("x y") is None


# --- decontamination --------------------------------------------------------------------------


def brute(text, items, window):
    words, hit, found = decontam.words_of(text), set(), set()
    for item, item_text in items:
        own = decontam.words_of(item_text)
        size = min(window, len(own))
        for at in range(len(own) - size + 1) if own else ():
            for k in range(len(words) - size + 1):
                if words[k : k + size] == own[at : at + size]:
                    hit.update(range(k, k + size))
                    found.add("" if item is None else str(item))
    return len(words), sorted(hit), sorted(found)


@pytest.mark.parametrize("window,group", [(3, 1 << 20), (4, 12), (1, 5)])
def test_hits_equal_brute_force(spark, window, group):
    rng = random.Random(window)
    word = lambda: rng.choice("a b c d É 7".split())
    items = [(k, " ".join(word() for _ in range(rng.randint(0, 9)))) for k in range(12)] + [(3, "A b"), (None, "q a d"), (20, None)]
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "a-B;c", "q A. d"]
    rows = docs(spark, list(enumerate(texts))).withColumn("hit_items", F.lit("clash"))
    marked = decontam.contamination(rows, spark.createDataFrame(items, "item_id long, text string"), window, group)
    for r in marked.collect():
        assert (r["n_words"], r["hit_words"], r["hit_items"]) == brute(texts[r["doc_id"]], items, window)


def test_spans_go_and_clean_rows_stay(spark):
    item = " ".join(f"w{k}" for k in range(12))
    rows = [
        (1, "keep This, and " + item.upper() + "! then  this too, at length: one two three four five six seven", "en", "s", 1),
        (2, item, "en", "s", 1),
        (3, "clean  text\n stays", "en", "s", 18),
        (4, None, None, None, None),
    ]
    items = spark.createDataFrame([(9, item), (10, " ".join(f"v{k}" for k in range(12)))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.remove_contamination(spark.createDataFrame(rows, DOCS), items, group_words=12).collect()}
    assert got[1]["text"] == "keep This, and then  this too, at length: one two three four five six seven"
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert 2 not in got and tuple(got[3]) == rows[2] and tuple(got[4]) == rows[3]
    nothing = decontam.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "item_id long, text string"))
    assert nothing.count() == 4
