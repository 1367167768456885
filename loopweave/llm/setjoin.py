"""Set similarity classes of documents: a grouped prefix join on word shingles.

A document's set holds the 64-bit hashes of its distinct k-word shingles. Two documents link when
the Jaccard similarity of their sets reaches a ratio; a class is a connected component of links.

1. A quarter of all shingles, those with the smallest hashes, are counted over all documents, and
   the ones that several documents hold are marked in a Bloom filter of bounded size. All sets are
   ordered alike: counted shingles without a mark first, then marked, then uncounted ones, each by
   hash. Any fixed order gives whole results; this one keeps shared passages out of the prefixes.
   Linked sets share a shingle in their prefixes, the first ``n - ceil(ratio * n) + 1`` shingles.
   While the filter holds every shingle of two documents, an unmarked one is known to be bare, held
   by one document: it is never posted, and ``n - bare`` bounds the overlap with any other set.
2. Equal sets are one class from the start. Sets with an equal prefix and size form one group.
3. Sets that share a minimum hash, or a group, are compared with the member that has the fewest
   bare shingles: linear in the members, and it settles most near copies.
4. Classes whose prefix shingles are posted by more than one component are looked at again among
   themselves, with all their shingles counted: once more by 3, then by a grouped prefix join.
   Groups that meet in a prefix shingle and hold different components are paired where sizes,
   shingle positions and the numbers of their shared shingles in 64 slices of the hash range allow
   a link (the overlap is at most the sum of the smaller numbers); pairs are expanded to their
   members and verified. Pairs inside one component cannot change the result and are not formed,
   so a large group of near copies costs no square.

Verification intersects the whole sets. Hash equality stands for shingle equality (two different
shingles meet with probability 2**-64 a pair).

Defined cases: null text, or text without words, has an empty set, links with nothing and is its
own component. Fewer words than ``k`` are one shingle, the whole sequence. Null doc_ids are joined
like others, and a component's id is its smallest non-null doc_id. Repeated doc_ids keep one row
each; the same id may then stand in several components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopweave.llm.common import Bloom, mix64, set_aside, slices, stored
from loopweave.llm.components import components

MINIMA = 4
COUNTED = np.uint64(1 << 62)
MOST_MARKED = 1 << 23
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class _Words(dict):
    """Scrambled hash of every word met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Sorted distinct shingle hashes of texts; words met before are looked up."""

    def __init__(self, k: int, memory: int = 150_000):
        self.k, self.memory = k, memory
        self.known = _Words()

    def set_of(self, text: str | None) -> np.ndarray:
        words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > self.memory:
            self.known.clear()
        codes = np.array(list(map(self.known.__getitem__, words)), dtype=np.uint64)
        width = min(self.k, len(codes))
        mixed = codes[: len(codes) - width + 1] * FACTORS[0]
        for at in range(1, width):
            mixed ^= codes[at : len(codes) - width + 1 + at]
            mixed *= FACTORS[at % 3]
            mixed ^= mixed >> np.uint64(29)
        own = np.sort(mix64(mixed + np.uint64(width) * FACTORS[2]))
        return own[np.concatenate([[True], own[1:] != own[:-1]])]


@dataclass(frozen=True)
class Ratio:
    """Linked when ``bottom * |intersection| >= top * |union|``; 0 < top <= bottom."""

    top: int
    bottom: int

    def __post_init__(self) -> None:
        if not 0 < self.top <= self.bottom:
            raise ValueError("a similarity ratio lies above 0 and reaches at most 1")

    def prefix(self, n: int) -> int:
        return n - -(-self.top * n // self.bottom) + 1 if n else 0

    def linked(self, both: Column, n: Column, m: Column) -> Column:
        return F.lit(self.bottom) * both >= F.lit(self.top) * (n + m - both)

    def sizes_allow(self, n: Column, m: Column) -> Column:
        return F.lit(self.bottom) * F.least(n, m) >= F.lit(self.top) * F.greatest(n, m)

    def overlap_allows(self, most: Column, n: Column, m: Column) -> Column:
        return F.lit(self.top + self.bottom) * most >= F.lit(self.top) * (n + m)


@dataclass
class Marks:
    """Bloom filter of shared shingles among those with a hash below ``below``; exact: none of them is missing."""

    bloom: Bloom
    below: np.uint64
    exact: bool

    def ordered(self, own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The first ``size`` shingles of a set in the common order that have to be posted, their
        positions, and the number of bare shingles."""
        counted = int(np.searchsorted(own, self.below)) if self.below else len(own)
        marked = self.bloom.holds(own[:counted])
        order = np.concatenate([own[:counted][~marked], own[:counted][marked], own[counted:]])
        bare = int(counted - marked.sum()) if self.exact else 0
        return order[bare:size], np.arange(bare, max(bare, min(size, len(own)))), bare


def marks_of(counts: DataFrame, below: np.uint64, most: int = MOST_MARKED) -> Marks:
    """Marks of ``counts(h, n)``: shingles of two documents or more, or of the smallest power of two that fits."""
    shared = stored(counts.filter("n > 1"), "shared-shingles")
    tiers = shared.groupBy(F.floor(F.log2("n")).alias("tier")).count().orderBy(F.desc("tier")).collect()
    least, total = 2, 0
    for row in tiers:
        total += row["count"]
        if total > most:
            least = 2 << row["tier"]
            break
    chosen = shared.filter(F.col("n") >= least).select("h")
    return Marks(Bloom.gather(chosen, "h", Bloom.size_for(min(total, most))), below, least == 2)


def shingle_counts(docs: DataFrame, k: int) -> DataFrame:
    """h, n: in how many documents every shingle with a hash below ``COUNTED`` occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for part in slices(batches, "text"):
            sets = [shingler.set_of(t) for t in part.column(0).to_pylist()]
            values, counts = np.unique(np.concatenate([s[: np.searchsorted(s, COUNTED)] for s in sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


POSTED = "n long, bare long, minima array<long>, posted array<long>, places array<int>"


def _posted(sets: list[np.ndarray], ratio: Ratio, marks: Marks, turns: np.ndarray) -> list[pa.Array]:
    """Columns of ``POSTED`` for the given sets."""
    longs = pa.list_(pa.int64())
    sizes, bares, minima, posted, places = [], [], [], [], []
    for own in sets:
        order, at, bare = marks.ordered(own, ratio.prefix(len(own)))
        sizes.append(len(own))
        bares.append(bare)
        minima.append([int(own[0].view(np.int64)), *(int(mix64(own ^ t).min().view(np.int64)) for t in turns)] if len(own) else [])
        posted.append(order.view(np.int64))
        places.append(at.astype(np.int32))
    return [
        pa.array(sizes, pa.int64()),
        pa.array(bares, pa.int64()),
        pa.array(minima, longs),
        pa.array(posted, longs),
        pa.array(places, pa.list_(pa.int32())),
    ]


NAMES = ["n", "bare", "minima", "posted", "places"]
SLICE_SHIFT = np.uint64(58)
SLICES = 64


def _slice_counts(own: np.ndarray, marks: Marks) -> np.ndarray:
    """Shingles per slice of the hash range, without those that are known to be bare."""
    shared = own[marks.bloom.holds(own)] if marks.exact else own
    return np.bincount((shared >> SLICE_SHIFT).astype(np.int64), minlength=SLICES).astype(np.int32)


def sketches(docs: DataFrame, k: int, ratio: Ratio, marks: Marks) -> DataFrame:
    """doc_id, key (digest of the set, null when empty) and the columns of ``POSTED``."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, turns = Shingler(k), mix64(np.arange(1, MINIMA, dtype=np.uint64))
        for part in slices(batches, "text"):
            sets = [shingler.set_of(t) for t in part.column(1).to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(keys, pa.binary()), *_posted(sets, ratio, shared.value, turns)],
                names=["doc_id", "key", *NAMES],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, key binary, {POSTED}")


def resketched(sets: DataFrame, ratio: Ratio) -> DataFrame:
    """key, comp, ``POSTED`` anew and counts for ``sets(key, comp, items)``, with all shingles counted among these sets."""
    counts = sets.select(F.explode("items").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    shared = sets.sparkSession.sparkContext.broadcast(marks_of(counts, np.uint64(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = mix64(np.arange(1, MINIMA, dtype=np.uint64))
        for part in slices(batches, "key", 1 << 14):
            items = part.column(2)
            own = [np.sort(items[i].values.to_numpy().view(np.uint64)) for i in range(part.num_rows)]
            counts = pa.array([_slice_counts(o, shared.value) for o in own], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *_posted(own, ratio, shared.value, turns), counts], names=["key", "comp", *NAMES, "counts"]
            )

    return sets.select("key", "comp", "items").mapInArrow(run, f"key binary, comp long, {POSTED}, counts array<int>")


def whole_sets(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """key, items: the sets of the classes in ``wanted(key, doc_id)``, each once.

    Only documents whose doc_id is met in a Bloom filter of the wanted ids, bounded in size, are cut
    into shingles; a null id is always looked at.
    """
    ids = wanted.select("doc_id").dropna()
    shared = docs.sparkSession.sparkContext.broadcast(Bloom.gather(ids, "doc_id", Bloom.size_for(wanted.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, given = Shingler(k), set()
        for part in slices(batches, "text"):
            ids = part.column(0)
            seen = shared.value.holds(ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            keys, items = [], []
            for at in np.flatnonzero(seen):
                own = shingler.set_of(part.column(1)[int(at)].as_py())
                key = xxhash.xxh3_128_digest(own.tobytes())
                if len(own) and key not in given:
                    given.add(key)
                    keys.append(key)
                    items.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(items, pa.list_(pa.int64()))], names=["key", "items"]
            )

    found = docs.select("doc_id", "text").mapInArrow(run, "key binary, items array<long>")
    return found.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def verified(pairs: DataFrame, sets: DataFrame, ratio: Ratio) -> DataFrame:
    """The pairs (a, b) whose whole sets, from ``sets(key, items)``, link."""
    left = sets.select(F.col("key").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(ratio.linked(both, F.size("x"), F.size("y")))
        .select("a", "b")
    )


def star_pairs(classes: DataFrame, ratio: Ratio) -> DataFrame:
    """a, b: every class with the barest class of each bucket (minimum hash, or group) it is in."""
    buckets = F.concat("minima", F.array(F.xxhash64("posted", "n", "bare")))
    filed = classes.select("key", "n", "bare", F.posexplode(buckets).alias("slot", "value"))
    hubs = filed.groupBy("slot", "value").agg(
        F.min(F.struct("bare", "key", "n")).alias("hub"), F.count("*").alias("members")
    )
    n, m = F.col("n"), F.col("hub.n")
    most = F.least(n - F.col("bare"), m - F.col("hub.bare"))
    return (
        filed.join(hubs.filter("members > 1"), ["slot", "value"])
        .filter((F.col("hub.key") != F.col("key")) & ratio.sizes_allow(n, m) & ratio.overlap_allows(most, n, m))
        .select(F.greatest("key", "hub.key").alias("a"), F.least("key", "hub.key").alias("b"))
        .distinct()
    )


def _open_postings(units: DataFrame, name: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """g, comp, n, at, h and the extra columns of posted shingles that more than one component posts.

    ``units(g, comp, n, posted, places)``. A Bloom filter of the open shingles, bounded in size,
    keeps the others from being shuffled a second time.
    """
    postings = units.select("g", "comp", "n", *extra, F.explode(F.arrays_zip("posted", "places")).alias("p"))
    postings = postings.select("g", "comp", "n", F.col("p.places").alias("at"), F.col("p.posted").alias("h"), *extra)
    open_shingles = stored(
        postings.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("h"), f"{name}-open"
    )
    marks = Bloom.gather(open_shingles, "h", Bloom.size_for(open_shingles.count(), 1 << 24))
    shared = units.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(4).to_numpy()
            if len(values):
                yield batch.filter(pa.array(shared.value.holds(values)))

    return stored(postings.mapInArrow(run, postings.schema).join(open_shingles, "h", "left_semi"), name)


def group_pairs(classes: DataFrame, ratio: Ratio) -> DataFrame:
    """a, b: classes of different components whose groups meet in a posted shingle that lets them link.

    ``classes(key, comp, ...)`` with the columns of ``POSTED``; comp is a 64-bit hash of the component so far.
    """
    grouped = classes.withColumn("g", F.xxhash64("posted", "n", "bare", "counts"))
    units = grouped.groupBy("g", "comp").agg(*[F.first(c).alias(c) for c in ("n", "posted", "places", "counts")])
    left = _open_postings(units, "group-postings", ("counts",))
    right = left.select("h", *[F.col(c).alias(f"{c}2") for c in ("g", "comp", "n", "at", "counts")])
    sliced = F.aggregate(F.zip_with("counts", "counts2", lambda a, b: F.least(a, b)), F.lit(0), lambda s, c: s + c)
    most = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"), sliced)
    met = (
        left.join(right, "h")
        .filter(F.col("comp") < F.col("comp2"))
        .filter(ratio.sizes_allow(F.col("n"), F.col("n2")) & ratio.overlap_allows(most, F.col("n"), F.col("n2")))
        .select("g", "comp", "g2", "comp2")
        .distinct()
    )
    own = grouped.select("g", "comp", "key")
    first = own.select("g", "comp", F.col("key").alias("a"))
    second = own.select(F.col("g").alias("g2"), F.col("comp").alias("comp2"), F.col("key").alias("b"))
    return met.join(first, ["g", "comp"]).join(second, ["g2", "comp2"]).select("a", "b").distinct()


def _classified(docs: DataFrame, k: int, ratio: Ratio) -> DataFrame:
    """doc_id, key, n, component_id, rows (of the component), kept (the row stands for its component)."""
    rows = stored(sketches(docs, k, ratio, marks_of(shingle_counts(docs, k), COUNTED)), "set-sketches")
    filled = rows.filter(F.col("key").isNotNull())
    classes = stored(
        filled.groupBy("key").agg(
            F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in NAMES]
        ),
        "set-classes",
    )

    def sets_of(keys: DataFrame) -> DataFrame:
        wanted = stored(classes.select("key", "doc_id").join(keys, "key", "left_semi"), "wanted-sets")
        return stored(whole_sets(docs, k, wanted), "whole-sets")

    pairs = stored(star_pairs(classes, ratio), "star-pairs")
    links = stored(verified(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()), ratio), "star-links")

    def labelled(found: DataFrame, frame: DataFrame) -> DataFrame:
        return frame.join(found, "key", "left").withColumn("comp", F.xxhash64(F.coalesce("comp", "key")))

    so_far = components(links)
    units = labelled(so_far, classes.select("key", "n", "posted", "places")).withColumn("g", F.xxhash64("key"))
    met = _open_postings(units, "class-postings").select("g").distinct()
    near = classes.select("key").withColumn("g", F.xxhash64("key")).join(met, "g", "left_semi").select("key")
    sets = sets_of(near)
    again = stored(resketched(labelled(so_far, sets), ratio), "sketched-again")
    links = stored(links.union(verified(star_pairs(again, ratio), sets, ratio)), "more-links")
    again = labelled(components(links), again.drop("comp"))
    links = stored(links.union(verified(stored(group_pairs(again, ratio), "group-pairs"), sets, ratio)), "all-links")
    joined = components(links)
    named = classes.select("key", "doc_id", "copies").join(joined, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    ids = named.groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"), F.sum("copies").alias("rows")
    )
    of_key = named.select("key", "comp").join(ids, "comp").select("key", "first", "rows")
    return rows.select("doc_id", "key", "n").join(of_key, "key", "left").select(
        "doc_id",
        "key",
        "n",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.coalesce("rows", F.lit(1)).alias("rows"),
        F.when(F.col("key").isNull(), True)
        .otherwise((F.col("first.key") == F.col("key")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id")))
        .alias("kept"),
    )


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def similarity_classes(docs: DataFrame, k: int = 5, top: int = 8, bottom: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id, component_rows for every row of ``docs(doc_id, text)``."""
    return _classified(_plain(docs), k, Ratio(top, bottom)).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("rows").alias("component_rows")
    )


def keep_one(docs: DataFrame, k: int = 5, top: int = 8, bottom: int = 10) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id.

    Rows with an empty set all stay. Only rows whose doc_id is met in a Bloom filter of the ids to
    look at (dropped or repeated ones) are shuffled, with their texts; all others pass straight.
    All columns of ``docs`` come out as they were, whatever their names.
    """
    docs, own = set_aside(docs, "_key", "_look", "_id", "_gone")
    ratio, columns = Ratio(top, bottom), docs.columns
    rows = stored(_classified(_plain(docs), k, ratio), "classified")
    dropped = rows.filter(~F.col("kept")).select("doc_id", "key").distinct()
    repeated = rows.filter("kept").groupBy("doc_id", "key").count().filter("count > 1").select("doc_id", "key")
    look = stored(dropped.union(repeated).select("doc_id").dropna().distinct(), "ids-to-look-at")
    marks = Bloom.gather(look, "doc_id", Bloom.size_for(look.count()))
    shared = docs.sparkSession.sparkContext.broadcast(marks)
    at_id, at_text = columns.index("doc_id"), columns.index("text")
    schema = docs.select("*").schema.add("_key", "binary").add("_look", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for part in slices(batches, "text"):
            ids = part.column(at_id).cast(pa.int64())
            seen = shared.value.holds(ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            keys: list[bytes | None] = [None] * part.num_rows
            for at in np.flatnonzero(seen):
                own = shingler.set_of(part.column(at_text)[int(at)].as_py())
                keys[at] = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
            looked = pa.array([key is not None for key in keys])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(keys, pa.binary()), looked], names=[*columns, "_key", "_look"]
            )

    marked = docs.mapInArrow(run, schema)
    gone = dropped.select(F.col("doc_id").alias("_id"), F.col("key").alias("_gone"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_gone"))
    checked = marked.filter("_look").join(gone, same, "left_anti").dropDuplicates(["doc_id", "_key"])
    return own(marked.filter("not _look").select(*columns).union(checked.select(*columns)))
