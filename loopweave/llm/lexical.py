"""Ranked lexical search through document FP-trees.

Every document becomes a vector of its terms that occur in some item, restricted to them and ordered
by descending document frequency, with their counts. Blocks of vectors are sorted into an FP-tree:
documents that begin with the same terms share a path, equal vectors share a leaf. A node knows the
largest count of every term of its subtree, the smallest length norm ``m`` and the smallest doc_id.
Scores grow with counts and fall with ``m``, so the score of those maxima at that norm bounds every
document below. Items descend together, depth first, the child with the largest bounds before its
siblings; an item leaves a subtree whose bound cannot enter its best ``k``. What a task has found so
far bounds its later trees too. Bounds and scores are whole numbers, nothing is estimated.

A leaf keeps the ``k`` smallest doc_ids of equal vectors: no item can take more of them. The best of
all tasks meet in a ranking that is cut down in slices first.

Items are searched in groups of ``GROUP_ITEMS``; the terms of one group (bounded by the texts of so
many items) are sent to the tasks at once.

Defined cases: null or wordless texts are no documents and match nothing; null or wordless items give
no rows; rows of one item_id are read as one item; repeated documents are ranked one by one; a null
doc_id comes before all others; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopweave.llm.common import slices, stored
from loopweave.plans.scan import dense_index
from loopweave.plans.topk import top_k

GROUP_ITEMS = 256
TREE_ROWS, TREE_POSTINGS = 1 << 14, 1 << 21
#: Subtrees of fewer leaves are not split further.
LEAST_LEAVES = 8
NO_ID = -(1 << 63)
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
VECTOR = "doc_id long, n long, ids array<int>, tfs array<int>"


def term_counts(text: bytes, most: int = 4 << 20) -> Counter:
    """The terms of a text with their counts, read in parts of about ``most`` bytes."""
    counts: Counter = Counter()
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + most)
        stop = gap.start() if gap else len(text)
        counts.update(TERM.findall(text[start:stop].lower()))
        start = stop
    return counts


def item_terms(items: DataFrame) -> DataFrame:
    """item, item_id, term: distinct terms of ``items(item_id, text)``; items are numbered from 0."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for row in range(batch.num_rows):
                terms = list(term_counts(batch.column(1)[row].as_buffer().to_pybytes()))
                if terms:
                    one = batch.column(0).slice(row, 1)
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([one] * len(terms)), pa.array(terms, pa.binary())], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    terms = items.filter("text is not null").select("item_id", "text").mapInArrow(split, f"item_id {kind}, term binary")
    terms = stored(terms.distinct(), "item-terms")
    numbers = dense_index(terms.select("item_id").distinct(), ["item_id"], "item")
    numbers = numbers.withColumnRenamed("item_id", "_id")
    return terms.join(numbers, F.col("item_id").eqNullSafe(F.col("_id"))).select("item", "item_id", "term")


def vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n, ids, tfs of every document with a term; ``ids`` are places in ``terms``."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(sent.value)}
        for batch in slices(batches, "text"):
            rows: list[list] = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = term_counts(text.as_buffer().to_pybytes())
                if counts:
                    own = counts.keys() & known.keys()
                    for to, value in zip(rows, (doc, counts.total(), [known[t] for t in own], [counts[t] for t in own])):
                        to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, schema)], schema=schema)

    return docs.filter("text is not null").select("doc_id", "text").mapInArrow(read, VECTOR)


class Weights:
    """For every term, in rank order, the items that hold it and its weight; scores of many vectors at once."""

    def __init__(self, items: int, at: np.ndarray, of: np.ndarray, weight: np.ndarray):
        self.items, self.at, self.of, self.weight = items, at, of, weight

    def scores(self, row: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray, rows: int) -> np.ndarray:
        """rows x items; entry i says that vector ``row[i]`` of norm ``m[i]`` holds term ``rank[i]`` ``tf[i]`` times.

        Sums stay below 2**53, so that doubles hold them exactly.
        """
        value = self.weight[rank] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        many = self.at[rank + 1] - self.at[rank]
        place = np.arange(many.sum()) + np.repeat(self.at[rank] - np.cumsum(many) + many, many)
        cell = np.repeat(row * self.items, many) + self.of[place]
        return np.bincount(cell, np.repeat(value, many), rows * self.items).reshape(rows, self.items).astype(np.int64)


class Node:
    """A subtree: leaves [first, last), per term the largest count, the smallest norm and doc_id.

    ``loose`` are the leaves below it that belong to none of its ``children``.
    """

    __slots__ = ("children", "doc", "first", "last", "loose", "m", "rank", "tf")

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last
        self.children: list[Node] = []


class FPTree:
    """A block of vectors: ``docs``, their norms ``m``, and flat ``rank``/``tf`` with ``at`` where each begins."""

    def __init__(self, docs: np.ndarray, m: np.ndarray, at: np.ndarray, rank: np.ndarray, tf: np.ndarray, k: int):
        order = np.lexsort((rank, np.repeat(np.arange(len(docs)), np.diff(at))))
        rank, tf = rank[order], tf[order]
        path, count = rank.astype(">u4").tobytes(), tf.astype(">u4").tobytes()
        keys = [(path[4 * at[i] : 4 * at[i + 1]], count[4 * at[i] : 4 * at[i + 1]], int(m[i]), int(docs[i])) for i in range(len(docs))]
        self.docs: list[list[int]] = []
        kept, last = [], None
        for i in sorted(range(len(docs)), key=keys.__getitem__):
            if last is not None and keys[last][:3] == keys[i][:3]:
                if len(self.docs[-1]) < k:
                    self.docs[-1].append(keys[i][3])
            else:
                kept.append(i)
                self.docs.append([keys[i][3]])
                last = i
        kept_at = np.array(kept)
        size = at[kept_at + 1] - at[kept_at]
        self.at = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(self.at[-1]) + np.repeat(at[kept_at] - self.at[:-1], size)
        self.rank, self.tf, self.m = rank[take], tf[take], m[kept_at]
        self.doc = np.array([d[0] for d in self.docs])
        self.root = self._grow(self._shared())

    def _shared(self) -> np.ndarray:
        """Terms that each leaf's path shares with the one before."""
        out = [0]
        for i in range(1, len(self.m)):
            a = self.rank[self.at[i - 1] : self.at[i]]
            b = self.rank[self.at[i] : self.at[i + 1]]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            out.append(int(differ[0]) if len(differ) else n)
        return np.array(out)

    def _grow(self, shared: np.ndarray) -> Node:
        """Leaves part where they share least with their neighbour; parts of a few leaves stay with their parent."""
        nodes = [Node(0, len(self.m))]
        for node in nodes:  # grows meanwhile; children come after their parents
            inside = shared[node.first + 1 : node.last]
            cuts = np.flatnonzero(inside == inside.min(initial=1 << 31)) + node.first + 1
            loose = []
            for first, last in zip([node.first, *cuts], [*cuts, node.last]):
                if last - first < LEAST_LEAVES:
                    loose.extend(range(first, last))
                else:
                    node.children.append(Node(first, last))
            node.loose = np.array(loose, dtype=np.int64)
            nodes.extend(node.children)
        for node in reversed(nodes):
            own = self.entries(node.loose)
            rank = np.concatenate([self.rank[own], *[c.rank for c in node.children]])
            tf = np.concatenate([self.tf[own], *[c.tf for c in node.children]])
            order = np.argsort(rank, kind="stable")
            rank, tf = rank[order], tf[order]
            start = np.flatnonzero(np.diff(rank, prepend=-1))
            node.rank, node.tf = rank[start], np.maximum.reduceat(tf, start) if len(start) else tf
            node.m, node.doc = self.m[node.first : node.last].min(), self.doc[node.first : node.last].min()
        return nodes[0]

    def entries(self, leaves: np.ndarray) -> np.ndarray:
        size = self.at[leaves + 1] - self.at[leaves]
        return np.arange(size.sum()) + np.repeat(self.at[leaves] - np.cumsum(size) + size, size)


class Best:
    """The best ``k`` of every item so far, worst first; ``score`` and ``doc`` are those of the k-th, 0 while there are fewer."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.score, self.doc = np.zeros(items, np.int64), np.full(items, NO_ID)

    def open(self, bound: np.ndarray, doc: np.ndarray | int) -> np.ndarray:
        """Where a score of ``bound`` at ``doc`` would enter."""
        return (bound > self.score) | (bound == self.score) & (doc < self.doc)

    def add(self, item: int, score: int, docs: list[int]) -> None:
        heap = self.heaps[item]
        for doc in docs:
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -doc))
            elif (score, -doc) > heap[0]:
                heapq.heapreplace(heap, (score, -doc))
            else:
                break
        if len(heap) == self.k:
            self.score[item], self.doc[item] = heap[0][0], -heap[0][1]


def descend(tree: FPTree, weights: Weights, best: Best, leaves: int = 256) -> int:
    """Depth-first branch and bound of all items; the number of (leaf, item) scores that were still open."""
    looked = 0
    top = weights.scores(np.zeros(len(tree.root.rank), np.int64), tree.root.rank, tree.root.tf, np.full(len(tree.root.rank), tree.root.m), 1)[0]
    stack = [(tree.root, top)]
    while stack:
        node, bound = stack.pop()
        if not best.open(bound, node.doc).any():
            continue
        for at in range(0, len(node.loose), leaves):
            some = node.loose[at : at + leaves]
            own = tree.entries(some)
            row = np.repeat(np.arange(len(some)), tree.at[some + 1] - tree.at[some])
            score = weights.scores(row, tree.rank[own], tree.tf[own], tree.m[some][row], len(some))
            for leaf, item in zip(*np.nonzero(best.open(score, tree.doc[some][:, None]))):
                best.add(item, int(score[leaf, item]), tree.docs[some[leaf]])
                looked += 1
        if node.children:
            size = [len(c.rank) for c in node.children]
            row = np.repeat(np.arange(len(size)), size)
            below = weights.scores(
                row,
                np.concatenate([c.rank for c in node.children]),
                np.concatenate([c.tf for c in node.children]),
                np.array([c.m for c in node.children])[row],
                len(size),
            )
            stack.extend((node.children[i], below[i]) for i in np.argsort(below.max(axis=1), kind="stable"))
    return looked


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """doc_ids, n, at, ids, tfs of consecutive vectors, at most ``TREE_ROWS`` and about ``TREE_POSTINGS`` at a time."""
    held: list[pa.RecordBatch] = []
    postings = 0

    def block():
        whole = pa.Table.from_batches(held).combine_chunks()
        docs, n, ids, tfs = (c.chunk(0) for c in whole.columns)
        at = np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))])
        docs = docs.fill_null(NO_ID)
        return docs.to_numpy(), n.to_numpy(), at, *(x.flatten().to_numpy().astype(np.int64) for x in (ids, tfs))

    rows = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            held.append(part)
            rows += part.num_rows
            postings += len(part.column(2).flatten())
            if rows >= TREE_ROWS or postings >= TREE_POSTINGS:
                yield block()
                held.clear()
                rows = postings = 0
    if rows:
        yield block()


def _search_group(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score: candidates for the best ``k`` of a group's ``terms(item, term)``."""
    spark = docs.sparkSession
    pairs = terms.toArrow()
    items, of = np.unique(pairs["item"].to_numpy(), return_inverse=True)
    words = sorted(set(pairs["term"].to_pylist()))
    table = stored(vectors(docs, words), "item-vectors")
    total, length = table.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(words), np.int64)
    for row in table.select(F.explode("ids").alias("i")).groupBy("i").count().toLocalIterator():
        df[row[0]] = row[1]
    order = np.argsort(-df, kind="stable")
    rank = np.argsort(order, kind="stable")
    weight = np.array([math.floor(1000 * math.log((2 * (total or 0) + 2) / (2 * int(d) + 1))) for d in df[order]], dtype=np.int64)
    number = {t: i for i, t in enumerate(words)}
    place = rank[[number[t] for t in pairs["term"].to_pylist()]]
    by = np.argsort(place, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(words)))])
    sent = spark.sparkContext.broadcast((rank, at, of[by], weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, at, of, weight = sent.value
        weights, best = Weights(len(items), at, of, weight), Best(len(items), k)
        for doc, n, begin, ids, tfs in _trees(batches):
            m = 50 + (50 * n * total) // length
            descend(FPTree(doc, m, begin, rank[ids], tfs, k), weights, best)
        for item, heap in zip(items, best.heaps):
            if heap:
                docs = [None if -d == NO_ID else -d for _, d in heap]
                yield pa.RecordBatch.from_arrays([pa.array([int(item)] * len(heap)), pa.array(docs, pa.int64()), pa.array([s for s, _ in heap])], names=["item", "doc_id", "score"])

    return table.filter(F.size("ids") > 0).mapInArrow(search, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item with a score above 0.

    ``docs(doc_id, text)``, ``items(item_id, text)``.
    """
    terms = stored(item_terms(items), "numbered-terms")
    last = terms.agg(F.max("item")).first()[0]
    found = None
    for first in range(0, (-1 if last is None else last) + 1, GROUP_ITEMS):
        group = terms.filter(F.col("item").between(first, first + GROUP_ITEMS - 1)).select("item", "term")
        part = stored(_search_group(docs, group, k), "item-best")
        found = part if found is None else found.union(part)
    names = terms.select("item", "item_id").distinct()
    if found is None:
        return names.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    best = top_k(found, ["item"], [F.col("score").desc()], k, ["doc_id"], salts=16)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id"))
    return best.withColumn("rank", rank).join(names, "item").select("item_id", "rank", "doc_id", "score")
