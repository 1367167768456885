"""Repeated byte strings, ranked search and collocations against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopweave.llm import collocations, lexical, repeats

WORDS = "der the la und of chat noir größe Ärger stone river night seven alpha beta".split()


def table(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- repeated strings ---------------------------------------------------------------------------


def plain_repeats(docs, length=100):
    """(n_bytes, n_removed, n_spans, kept) per document, by a dictionary of all windows."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[doc] = (len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept)
    return out


def repeated_corpus():
    rng = random.Random(5)
    passage, line = prose(rng, 40), prose(rng, 40)[:104]
    docs = [(1, prose(rng, 60)), (2, None), (3, ""), (4, "short"), (5, "=" * 700), (6, "ab" * 400)]
    docs += [(10 + i, f"{prose(rng, rng.randrange(3, 30))} {passage} {prose(rng, 25)}") for i in range(4)]
    docs += [(20 + i, docs[0][1]) for i in range(3)]
    docs += [(40 + i, f"{prose(rng, 4)} {i} {line} {i} {prose(rng, 5)}") for i in range(40)]
    docs += [(90, passage[:99]), (91, passage[:100]), (92, f"{line} {line} {line}"), (93, "ö" * 120)]
    return docs


@pytest.mark.parametrize("hot", [repeats.HOT, 5])
def test_repeats_equal_brute_force(spark, hot):
    docs = repeated_corpus()
    got = repeats.repeats(table(spark, docs, "doc_id long, text string").repartition(5), hot=hot).collect()
    want = plain_repeats(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want
    assert sum(w[1] > 0 for w in want.values()) > 40


def test_repeats_of_long_texts_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 150)
    rng = random.Random(6)
    data = prose(rng, 900).encode()
    windows = {}
    for _, text, shift, first, n, anchor, h in repeats.segments([data, b"", data[:99], data[50:400]]):
        for t, s, f, many, a, key in zip(text, shift, first, n, anchor, h):
            for w in range(f + s, f + s + many):
                assert (t, w) not in windows
                windows[t, w] = (a + s - w, key)
    assert set(windows) == {(0, i) for i in range(len(data) - 99)} | {(3, i) for i in range(251)}
    assert all(windows[3, i] == windows[0, i + 50] for i in range(251))


def test_repeats_of_odd_tables(spark):
    text = prose(random.Random(7), 40)
    rows = [(1, text, 9), (1, text, 8), (None, text, 7), (2, text + "x", 6), (2, "y" + text, 5)]
    got = repeats.repeats(table(spark, rows, "doc_id long, text string, n_bytes int")).collect()
    by = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in got)
    n = len(text.encode())
    assert by == [(-1, n, 0), (1, n, n), (1, n, n), (2, n + 1, n), (2, n + 1, n)]
    empty = table(spark, [], "doc_id long, text string")
    assert repeats.repeats(empty).count() == 0


@pytest.mark.parametrize("letters", [b"ab", b"abcdefghijkl"])
def test_interval_expansion(letters):
    """Suffix classes of any length against a dictionary of strings."""
    rng = random.Random(8)
    base = bytes(rng.choices(letters, k=400))
    codes = np.frombuffer(base + bytes(rng.choices(letters, k=200)) + base[100:350] + b"\xff", np.uint8)
    for length in (1, 2, 7, 8, 9, 40, 130):
        order, words = repeats.suffix_order(codes, length)
        loop = codes.tobytes() * 2
        names = [loop[i : i + length] for i in order]
        assert names == sorted(names)
        same = repeats.open_ends(codes[order - 1], words, length)
        assert same.tolist() == [False, *(a == b for a, b in zip(names, names[1:]))]


# --- ranked search ------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_search(docs, items, k):
    bags = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    count, length = len(bags), sum(c.total() for _, c in bags)
    df = Counter(w for _, c in bags for w in c)
    out = {}
    for item, text in items:
        scored = []
        for doc, c in bags:
            m = 50 + (50 * c.total() * count) // length
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m))
                for w in set(TERM.findall(lower(text)))
            )
            if score > 0:
                scored.append((-score, doc))
        out[item] = [(r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k])]
    return {i: v for i, v in out.items() if v}


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TREE_ROWS", 100)
    rng = random.Random(9)
    docs = [(i, prose(rng, rng.randrange(1, 60)) + f" u{i % 37}") for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(2000, None), (2001, ""), (2002, "?!"), (2003, "STONE ÄRGER Ärger 7")]
    items = [(f"i{i}", prose(rng, 4) + f" u{i}") for i in range(30)] + [("none", None), ("mute", "..."), ("new", "zebra"), ("up", "STONE, Größe")]
    got = lexical.search(table(spark, docs, "doc_id long, text string").repartition(3), table(spark, items, "item_id string, text string"), k=20)
    by = {}
    for r in got.orderBy("item_id", "rank").collect():
        by.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    assert by == plain_search(docs, items, 20)


def test_search_skips_subtrees():
    """The bound leaves most leaves unread, and the best are still found."""
    rng = np.random.default_rng(3)
    n, terms = 4000, 60
    sizes = rng.integers(3, 12, n)
    at = np.concatenate([[0], np.cumsum(sizes)])
    rank = np.concatenate([np.sort(rng.choice(terms, s, replace=False, p=np.arange(terms, 0, -1) / (terms * (terms + 1) / 2))) for s in sizes])
    tf, m = rng.integers(1, 5, len(rank)), rng.integers(60, 200, n)
    tree = lexical.FPTree(np.arange(n), m, at, rank, tf, 10)
    assert tree.root.children
    of = np.repeat(np.arange(4), 3)
    place = rng.integers(0, terms, 12)
    by = np.argsort(place, kind="stable")
    weights = lexical.Weights(4, np.concatenate([[0], np.cumsum(np.bincount(place, minlength=terms))]), of[by], np.arange(terms) * 50 + 10)
    best = lexical.Best(4, 10)
    looked = lexical.descend(tree, weights, best)
    row = np.repeat(np.arange(n), sizes)
    scores = weights.scores(row, rank, tf, m[row], n)
    for item in range(4):
        want = sorted(((-int(s), d) for d, s in enumerate(scores[:, item]) if s > 0))[:10]
        assert sorted((-s, -d) for s, d in best.heaps[item]) == want
    assert looked < n


def test_search_of_odd_tables(spark):
    docs = table(spark, [(None, "stone"), (5, "stone"), (5, "stone"), (7, "river")], "doc_id long, text string")
    items = table(spark, [(None, "stone"), ("a", "stone"), ("a", "river")], "item_id string, text string")
    got = lexical.search(docs.withColumn("score", F.lit("x")), items.withColumn("n", F.lit(1)))
    rows = sorted((r.item_id or "", r["rank"], -1 if r.doc_id is None else r.doc_id) for r in got.collect())
    assert rows == [("", 1, -1), ("", 2, 5), ("", 3, 5), ("a", 1, 7), ("a", 2, -1), ("a", 3, 5), ("a", 4, 5)]
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


# --- collocations -------------------------------------------------------------------------------


def plain_collocations(docs, least, top=2000):
    grams, words = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in (1, 2, 3):
                grams.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in grams.items():
        found = []
        for g, a in f.items():
            if len(g) == 1 or a < least:
                continue
            if len(g) == 2 and any(100 * f[t] >= 50 * a for t in f if len(t) == 3 and f[t] >= least and g in (t[:2], t[1:])):
                continue
            score, cut = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:cut]], f[g[cut:]]))
        out += [(lang, r + 1, p.decode(), -a, l, rr, words[lang], -s) for r, (s, a, p, l, rr) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard", [collocations.SHARD_WORDS, 50])
def test_collocations_equal_brute_force(spark, monkeypatch, shard):
    build = collocations.build_index
    monkeypatch.setattr(collocations, "build_index", lambda docs, seed: build(docs, seed, shard))
    rng = random.Random(11)
    docs = []
    for i in range(120):
        text = prose(rng, 12) + rng.choice([". ", ",", "\n", " ", " "]) + "New  York\tCity " + prose(rng, 3) + rng.choice([" the stone river", "!"])
        docs.append((rng.choice(["en", "de", None, "und"]), text))
    docs += [("en", None), ("en", ""), ("fr", "...;\x0b\x0c\r"), ("en", "\x00 \x00 \x00"), *[("xx", "one two three four")] * 12]
    got = collocations.collocations(table(spark, docs, "lang string, text string").withColumn("n", F.lit(1)), least=5)
    assert sorted(map(tuple, got.collect())) == plain_collocations(docs, 5)


def test_collocations_of_an_empty_table(spark):
    got = collocations.collocations(table(spark, [], "lang string, text string"))
    assert got.count() == 0
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]


def test_kept_bytes_hash(spark):
    one = repeats.repeats(table(spark, [(1, "x" * 99)], "doc_id long, text string")).select(F.sha2("kept", 256)).first()[0]
    assert one == hashlib.sha256(b"x" * 99).hexdigest()
