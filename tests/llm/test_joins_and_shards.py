"""Top-k search, the prefix join, components and shards against brute force."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loopweave.llm import kdshards, setjoin, topk
from loopweave.llm.components import components


@pytest.mark.parametrize("segment,chunk", [(16, 2), (10_000, 10_000)])
def test_topk_equals_brute_force(spark, segment, chunk):
    rng = random.Random(2)
    rows = [(k, [float(rng.randint(-3, 3)) / 256 for _ in range(rng.choice((4, 4, 4, 2, 0)))]) for k in range(150)]
    rows += [(200, rows[0][1]), (10, rows[7][1]), (0, rows[0][1]), (500, None), (501, [1.0, None]), (502, [math.nan]), (503, [math.inf]), (None, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    terms = frame.filter(topk.usable(F.col("embedding"))).select("vec_id", topk.floor_terms(F.col("embedding")).alias("terms"))
    got = topk.top_k(terms, 5, 10, segment, chunk).collect()
    whole = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {(i, v) for i, v in whole if i % 10 == 0}:
        others = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(others)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert topk.top_k(terms.limit(0), 5, 10).count() == 0


def near_copies(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return words


def brute_classes(rows, k, top, bottom):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both and bottom * both >= top * len(s | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [word() for _ in range(60)]
    rows = []
    for base in range(6):
        text = [word() for _ in range(rng.randint(20, 120))]
        rows += [" ".join(near_copies(rng, text, rng.randint(0, 6))) for _ in range(25)]
    rows += [" ".join([word() for _ in range(40)] + shared + [word() for _ in range(rng.randint(5, 60))]) for _ in range(40)]
    rows += ["one two", "One  TWO", "one", "", None, " \t ", "a b c d", "É b c d", "é b c d"] + rows[:10]
    return list(enumerate(rows))


@pytest.mark.parametrize("k,top,bottom", [(4, 85, 100), (5, 8, 10), (2, 1, 2)])
def test_classes_equal_brute_force(spark, k, top, bottom):
    rows = corpus(k)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = setjoin.similarity_classes(frame, k, top, bottom).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_classes(rows, k, top, bottom)


def test_full_marks_change_no_class(spark, monkeypatch):
    """With too many shared shingles for the filter, rarer ones lose their mark; results stay."""
    monkeypatch.setattr(setjoin.marks_of, "__defaults__", (40,))
    rows = corpus(9)
    got = setjoin.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_classes(rows, 4, 85, 100)


def test_keep_one(spark):
    rows = corpus(4) + [(None, "alone among nulls indeed here"), (None, "alone among nulls indeed here"), (7, "another text under a used id")]
    rows += [(3, rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    kept = setjoin.keep_one(frame)
    assert kept.columns == ["doc_id", "text", "n"]
    classes = brute_classes(rows, 5, 8, 10)
    n_sets = len({c for (d, n, c) in classes if n and c is not None}) + 1  # the class of null ids
    empty = sum(m for (d, n, c), m in classes.items() if not n)
    # Ids 3 and 7 carry two rows each: a copy, and a text of its own class with the same id.
    assert kept.count() == n_sets + empty + 1
    assert setjoin.keep_one(frame.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, k) for k in range(301, 340)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["key"], r["comp"]) for r in got} == {(x, find(x)) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(1)
    rows = [(k, "x" * rng.randint(0, 900), rng.choice("ab"), "s0" if rng.random() < 0.4 else f"s{k % 9}") for k in range(3000)]
    rows += [(5000 + k, "copy of one text " * 20, "a", "s0") for k in range(120)] + [(9000, None, None, None), (9000, None, None, None), (None, "é", "a", "s")]
    got = kdshards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), leaves=8).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.02 * sum(sizes.values()) / 8
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert len({r["shard"] for r in got if r["doc_id"] and 5000 <= r["doc_id"] < 6000}) == 1
    text = {k: t for k, t, *_ in rows}
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))


def test_a_text_heavier_than_a_shard_is_dealt(spark):
    rows = [(k, "the same long text") for k in range(600)] + [(1000 + k, f"t{k}") for k in range(600)]
    got = kdshards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), target_bytes=3000).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(got) == 1200 and len(sizes) == 8 and max(sizes.values()) < 1.25 * sum(sizes.values()) / 8
    assert kdshards.kd_shards(spark.createDataFrame([], "doc_id long, text string"), leaves=8).count() == 0
