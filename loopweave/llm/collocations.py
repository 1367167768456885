"""Phrase collocation mining with an FM-index per shard over word ids.

Lower-cased text is cut into pieces and words; the words of one language are gathered into shards of
about ``SHARD_WORDS`` words. A shard is written once as an index: its words with their counts, and
the Burrows-Wheeler transforms of its word sequence and of the reversed sequence, both sorted as deep
as phrases go. A phrase is a pair of intervals, one in each transform:

* words: the intervals of the first symbols;
* pairs: every word interval is extended to the left by the words found in its part of the transform;
  the number of smaller left neighbours gives the pair's interval in the reversed transform;
* triples: the interval of a pair is extended to the right by the words in the reversed transform.

Counts of each level are summed over all shards before the next level starts, so that only words and
pairs that are frequent in the whole language are extended. That leaves out nothing: a phrase cannot
be more frequent than its parts. The filters that carry this to the shards are Bloom filters; a false
positive only makes a shard count a phrase that falls below ``least`` in the sum.

Words are named by 64-bit hashes of language and word; two words of one name would be refused.

Defined cases: null or empty text has no words; a null language is ``und``; repeated rows count once
each; an empty table gives no rows; other columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopweave.llm.common import Bloom, slices, stored
from loopweave.plans.topk import top_k
from loopweave.session import bound_batches

SHARD_WORDS = 1 << 18
#: Rows of counts in an Arrow batch.
OUT_ROWS = 1 << 16
#: Every character that ends a piece becomes a line feed.
PIECE_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
#: A byte that UTF-8 never holds marks the end of a piece, and parts the words of a shard.
MARK = b"\xff"
SHARD = "lang string, words binary, counts binary, keys binary, bwt binary, back binary"


class _Numbers(dict):
    """Words to numbers from 1 in order of appearance; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def parts_of(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """The lower-cased text in parts of whole pieces, of about ``most`` bytes, its piece ends as line feeds."""
    text = text.lower().translate(PIECE_ENDS)
    start = 0
    while start < len(text):
        stop = text.find(b"\n", start + most) + 1 or len(text)
        yield text[start:stop]
        start = stop


def numbered(part: bytes, numbers: _Numbers) -> np.ndarray:
    """The words of whole pieces as numbers, 0 after each piece."""
    words = (part + b"\n").replace(b"\n", b" \xff ").replace(b"\t", b" ").split(b" ")
    return np.array([numbers[w] for w in words if w], dtype=np.int32)


def transform(codes: np.ndarray, width: int) -> np.ndarray:
    """Symbols before the circular suffixes of ``codes`` (below ``width``), sorted by three symbols."""
    codes = codes.astype(np.int64)
    second, third = np.roll(codes, -1), np.roll(codes, -2)
    if width < 1 << 21:
        order = np.argsort((codes * width + second) * width + third, kind="stable")
    else:
        order = np.lexsort((third, second, codes))
    return np.roll(codes, 1)[order].astype(np.int32)


class ShardIndex:
    """Both transforms of a shard; intervals of phrases are extended for all phrases at once."""

    def __init__(self, counts: np.ndarray, bwt: np.ndarray, back: np.ndarray):
        self.bwt, self.back = bwt, back
        self.sizes = np.concatenate([[len(bwt) - counts.sum()], counts])

    @classmethod
    def of(cls, codes: np.ndarray, width: int) -> ShardIndex:
        counts = np.bincount(codes, minlength=width)[1:].astype(np.int64)
        return cls(counts, transform(codes, width), transform(codes[::-1], width))

    def pairs(self, usable: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """left, right, count, start: all pairs of words; ``start`` of the interval in the reversed transform."""
        word = np.repeat(np.arange(len(self.sizes), dtype=np.int64), self.sizes)
        left = np.sort((word << 32) | self.bwt)
        start, count = _runs(left)
        first, second = left[start] & 0xFFFFFFFF, left[start] >> 32
        keep = (first > 0) & (second > 0)
        if usable is not None:
            keep &= usable[first] & usable[second]
        return first[keep], second[keep], count[keep], start[keep]

    def triples(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """pair, third, count: the words after the pairs whose intervals are given; ``pair`` is their place there."""
        pair = np.repeat(np.arange(len(start), dtype=np.int64), count)
        at = np.arange(len(pair)) + np.repeat(start - np.cumsum(count) + count, count)
        right = np.sort((pair << 32) | self.back[at])
        first, n = _runs(right)
        pair, third = right[first] >> 32, right[first] & 0xFFFFFFFF
        keep = third > 0
        return pair[keep], third[keep], n[keep]


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(ordered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return start, np.diff(np.append(start, len(ordered)))


def _shard(lang: str, numbers: _Numbers, parts: list[np.ndarray], seed: int) -> list:
    index = ShardIndex.of(np.concatenate(parts), len(numbers))
    words = list(numbers)[1:]
    name = lang.encode() + MARK
    keys = np.array([xxhash.xxh64_intdigest(name + w, seed) for w in words], dtype=np.uint64)
    return [lang, MARK.join(words), index.sizes[1:].tobytes(), keys.tobytes(), index.bwt.tobytes(), index.back.tobytes()]


def build_index(docs: DataFrame, seed: int = 0, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, words, counts, keys, bwt, back: a stored row per shard of ``docs(lang, text)``."""
    schema = pa.schema([("lang", pa.string()), *[(c, pa.binary()) for c in ("words", "counts", "keys", "bwt", "back")]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, parts) in shards.items():
                if len(numbers) > 1:
                    row = _shard(lang, numbers, parts, seed)
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
            shards.clear()

        held = 0
        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in parts_of(text.as_buffer().to_pybytes()):
                    numbers, parts = shards.setdefault(lang, (_Numbers({MARK: 0}), [np.zeros(1, np.int32)]))
                    parts.append(numbered(part, numbers))
                    held += len(parts[-1])
                    if held >= shard_words:
                        yield from flushed()
                        held = 0
        yield from flushed()

    bound_batches(docs.sparkSession, 4 << 20)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter("text is not null")
    return stored(texts.mapInArrow(build, SHARD), "phrase-index")


def _batches(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + OUT_ROWS]) for c in columns], names=names)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[list]:
    """The binary columns of each row as they are."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield [c[i].as_buffer().to_pybytes() for c in columns]


def _opened(row: list[bytes]) -> tuple[np.ndarray, ShardIndex]:
    """The names of the numbers (0 first) and the index of a stored shard."""
    keys, counts, bwt, back = row
    names = np.concatenate([np.zeros(1, np.int64), np.frombuffer(keys, np.int64)])
    return names, ShardIndex(np.frombuffer(counts, np.int64), np.frombuffer(bwt, np.int32), np.frombuffer(back, np.int32))


def word_counts(index: DataFrame) -> DataFrame:
    """key, lang, word, n over all shards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang, (words, counts, keys) in zip(langs, _rows(batch, "words", "counts", "keys")):
                words = np.array([w.decode("utf-8", "replace") for w in words.split(MARK)], dtype=object)
                keys, counts = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                yield from _batches([keys, np.full(len(words), lang, object), words, counts], ["key", "lang", "word", "n"])

    rows = index.select("lang", "words", "counts", "keys").mapInArrow(count, "key long, lang string, word string, n long")
    return rows.groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


def _pair_key(first: Column | np.ndarray, second: Column | np.ndarray):
    """One 64-bit name for two, in Spark and in numpy."""
    if isinstance(first, Column):
        return first.bitwiseXOR(F.shiftleft(second, 1)).bitwiseXOR(F.shiftrightunsigned(second, 63))
    turned = second.view(np.uint64)
    return first ^ ((turned << np.uint64(1)) | (turned >> np.uint64(63))).view(np.int64)


def _filter(keys: DataFrame) -> Bloom:
    """Membership among ``keys(key)``, a stored table."""
    return Bloom.gather(keys, "key", Bloom.size_for(keys.count()))


def pair_counts(index: DataFrame, words: DataFrame) -> DataFrame:
    """k1, k2, n over all shards, of pairs whose two words are in ``words(key)``."""
    frequent = index.sparkSession.sparkContext.broadcast(_filter(words).words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bloom(frequent.value)
        for batch in batches:
            for row in _rows(batch, "keys", "counts", "bwt", "back"):
                names, shard = _opened(row)
                first, second, n, _ = shard.pairs(known.holds(names))
                yield from _batches([names[first], names[second], n], ["k1", "k2", "n"])

    rows = index.select("keys", "counts", "bwt", "back").mapInArrow(count, "k1 long, k2 long, n long")
    return rows.groupBy("k1", "k2").agg(F.sum("n").alias("n"))


def triple_counts(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """k1, k2, k3, n over all shards, of triples whose two pairs are in ``pairs(k1, k2)``."""
    keys = pairs.select(_pair_key(F.col("k1"), F.col("k2")).alias("key"))
    frequent = index.sparkSession.sparkContext.broadcast(_filter(keys).words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bloom(frequent.value)
        for batch in batches:
            for row in _rows(batch, "keys", "counts", "bwt", "back"):
                names, shard = _opened(row)
                first, second, n, start = shard.pairs()
                keep = known.holds(_pair_key(names[first], names[second]))
                first, second, n, start = first[keep], second[keep], n[keep], start[keep]
                pair, third, n = shard.triples(start, n)
                keep = known.holds(_pair_key(names[second[pair]], names[third]))
                pair, third, n = pair[keep], third[keep], n[keep]
                yield from _batches([names[first[pair]], names[second[pair]], names[third], n], ["k1", "k2", "k3", "n"])

    rows = index.select("keys", "counts", "bwt", "back").mapInArrow(count, "k1 long, k2 long, k3 long, n long")
    return rows.groupBy("k1", "k2", "k3").agg(F.sum("n").alias("n"))


def _score(whole: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits: exact for counts below 10**15."""
    a, l, r = (f"cast({c} as decimal(15, 0))" for c in (whole, left, right))
    return F.expr(f"(1000000 * {a} * {a}) div ({l} * {r})")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, seed: int = 0) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two or three words of each language.

    ``docs(lang, text)``. A phrase has to occur ``least`` times; it is dropped where a longer one that
    contains it has at least ``share`` per cent of its occurrences.
    """
    index = build_index(docs, seed)
    counted = stored(word_counts(index), "phrase-words")
    clash = counted.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").limit(1).collect()
    if clash:
        raise ValueError("two words have one 64-bit name: choose another seed")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counted.filter(F.col("n") >= least)
    pairs = stored(pair_counts(index, words).filter(F.col("n") >= least), "phrase-pairs")
    triples = stored(triple_counts(index, pairs).filter(F.col("n") >= least), "phrase-triples")

    def word(at: int) -> DataFrame:
        return words.select(F.col("key").alias(f"k{at}"), F.col("lang").alias(f"lang{at}"), F.col("word").alias(f"w{at}"), F.col("n").alias(f"f{at}"))

    named = pairs.join(word(1), "k1").join(word(2), "k2")
    heads = triples.select("k1", "k2", "n").union(triples.select(F.col("k2").alias("k1"), F.col("k3").alias("k2"), "n"))
    longer = heads.groupBy("k1", "k2").agg(F.max("n").alias("longer"))
    twos = (
        named.join(longer, ["k1", "k2"], "left")
        .filter(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("n") * share)
        .select("lang1", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), _score("n", "f1", "f2").alias("score"))
    )
    threes = (
        triples.join(word(1), "k1").join(word(2), "k2").join(word(3), "k3")
        .join(pairs.select("k1", "k2", F.col("n").alias("f12")), ["k1", "k2"])
        .join(pairs.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("n").alias("f23")), ["k2", "k3"])
        .withColumn("s1", _score("n", "f1", "f23"))
        .withColumn("s2", _score("n", "f12", "f3"))
        .select(
            "lang1", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"),
            F.when(F.col("s1") <= F.col("s2"), F.col("f1")).otherwise(F.col("f12")).alias("l"),
            F.when(F.col("s1") <= F.col("s2"), F.col("f23")).otherwise(F.col("f3")).alias("r"),
            F.least("s1", "s2").alias("score"),
        )
    )
    found = twos.union(threes).withColumnRenamed("lang1", "lang").join(totals, "lang")
    order = [F.col("score").desc(), F.col("a").desc()]
    best = top_k(found, ["lang"], order, top, ["phrase"], salts=64)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    return best.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score")
