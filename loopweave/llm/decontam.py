"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Text is lower-cased in A-Z and cut into words of digits, letters and characters above ASCII. One
automaton holds every item's word sequence (sequences never join). Document words stream through
it; at each word it knows the length of the longest run ending there that occurs in some item. A
run of ``window`` words or more is a match, and all its words are hit; an item of fewer words has
to occur whole.

Before a document enters the automaton, runs of words whose neighbouring pairs all occur in the
items are found with array operations; only runs long enough to hold a window are streamed, which
leaves out nothing.

Items are dealt into groups of at most ``GROUP_WORDS`` words (one longer item is a group of its
own). Each group's word sequences are broadcast, a bounded size, and the documents are streamed
against one group after the other; one group is the usual case. Only items' ids and words travel.

Defined cases: null or wordless text has no words and hits nothing; null or wordless items are no
item; a null item_id is listed as the empty string; repeated item_ids count once, repeated items
each under their id; repeated documents are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from loopweave.llm.common import set_aside, slices, stored

WINDOW = 10
GROUP_WORDS = 1 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class ItemAutomaton:
    """Suffix automaton over item word sequences ``[(item_id, words)]``."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.windows: dict[tuple[int, ...], set[str]] = {}
        whole: dict[tuple[int, ...], None] = {}
        pairs: set[int] = set()
        for item, words in items:
            if not words:
                continue
            codes = [self.ids.setdefault(w, len(self.ids)) for w in words]
            pairs.update(a << 32 | b for a, b in zip(codes, codes[1:]))
            size = min(window, len(codes))
            for at in range(len(codes) - size + 1):
                self.windows.setdefault(tuple(codes[at : at + size]), set()).add(item)
            if tuple(codes) not in whole:
                whole[tuple(codes)] = None
                self._add(codes)
        self.short = sorted({len(w) for w in self.windows if len(w) < window})
        self.least = min((len(w) for w in self.windows), default=window)
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _add(self, codes: list[int]) -> None:
        """Extend the automaton by one sequence, starting from the root."""
        last = 0
        for c in codes:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def scan(self, codes: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans [start, stop) of one stream of word codes (-1: no item word), and the items."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for at, c in enumerate(codes):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            else:
                size = 0
            if size >= self.window:
                spans.append((at + 1 - size, at + 1))
                items |= self.windows.get(tuple(codes[at + 1 - self.window : at + 1]), set())
            for n in self.short:
                if n <= size and (found := self.windows.get(tuple(codes[at + 1 - n : at + 1]))):
                    spans.append((at + 1 - n, at + 1))
                    items |= found
        return spans, items

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Boolean per word, and the items with an occurring window."""
        hit = np.zeros(len(codes), dtype=bool)
        items: set[str] = set()
        known = codes >= 0
        if not known.any() or not len(self.windows):
            return hit, items
        if self.least < 2:
            starts, stops = np.array([0]), np.array([len(codes)])
        else:
            joined = (codes[:-1] << 32) | np.maximum(codes[1:], 0)
            at = np.searchsorted(self.pairs, joined)
            chained = (at < len(self.pairs)) & known[:-1] & known[1:]
            chained[chained] = self.pairs[at[chained]] == joined[chained]
            edge = np.diff(np.concatenate([[0], chained.view(np.int8), [0]]))
            starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            enough = stops - starts >= self.least
            starts, stops = starts[enough], stops[enough]
        for start, stop in zip(starts.tolist(), stops.tolist()):
            spans, found = self.scan(codes[start:stop].tolist())
            for a, b in spans:
                hit[start + a : start + b] = True
            items |= found
        return hit, items

    def codes(self, words: list[bytes]) -> np.ndarray:
        known = self.ids
        return np.fromiter((known.get(w, -1) for w in words), dtype=np.int64, count=len(words))


def item_groups(items: DataFrame, group_words: int = GROUP_WORDS) -> list[list[tuple[str, list[bytes]]]]:
    """Groups of items with at most ``group_words`` words; one group at a time is on the driver's path.

    Grouping follows the item order of the driver's iterator, which holds one partition at a time.
    """
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    groups: list[list[tuple[str, list[bytes]]]] = [[]]
    room = group_words
    for row in rows.dropna(subset=["text"]).toLocalIterator():
        words = words_of(row["text"])
        if not words:
            continue
        if len(words) > room and groups[-1]:
            groups.append([])
            room = group_words
        groups[-1].append((row["item"], words))
        room -= len(words)
    return groups


ADDED = ("n_words", "hit_words", "hit_items")


def _marks(part: pa.RecordBatch, at_text: int, earlier: list, automaton: ItemAutomaton) -> tuple[list, list, list]:
    """Per row: number of words, hit word positions, items; joined with what earlier groups found."""
    sizes, places, names = [], [], []
    for row, text in enumerate(part.column(at_text).to_pylist()):
        words = words_of(text)
        hit, found = automaton.hits(automaton.codes(words))
        place = np.flatnonzero(hit)
        if earlier:
            place = np.union1d(place, np.array(earlier[0][row].as_py(), dtype=np.int64))
            found |= set(earlier[1][row].as_py())
        sizes.append(len(words))
        places.append(place.astype(np.int32))
        names.append(sorted(found))
    return sizes, places, names


def mark_hits(docs: DataFrame, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> DataFrame:
    """``docs`` with hit_words array<int> (word positions) and hit_items array<string>, added to any there."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    rest = [c for c in docs.columns if c not in ADDED]
    used = docs.select(*rest, *[c for c in ADDED[1:] if c in docs.columns])
    schema = docs.select(*rest).schema.add("n_words", "long").add("hit_words", ArrayType(IntegerType())).add("hit_items", ArrayType(StringType()))
    at_text = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ItemAutomaton(shared.value, window)
        for part in slices(batches, "text"):
            sizes, places, names = _marks(part, at_text, part.columns[len(rest) :], automaton)
            marks = [pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *marks], names=[*rest, *ADDED])

    return used.mapInArrow(run, schema)


def _marked_by_all_but_last(docs: DataFrame, groups: list, window: int) -> DataFrame:
    marked = docs.drop(*ADDED)
    for group in groups[:-1]:
        marked = stored(mark_hits(marked, group, window), "contamination")
    return marked


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, group_words: int = GROUP_WORDS) -> DataFrame:
    """``docs`` with n_words, hit_words and hit_items against every row of ``items(item_id, text)``.

    Columns of ``docs`` with these names give way.
    """
    groups = item_groups(items, group_words)
    return mark_hits(_marked_by_all_but_last(docs, groups, window), groups[-1], window)


def cut(text: str, places: list[int]) -> str:
    """``text`` without the words at ``places``, and without the separators behind each run of them."""
    raw = text.encode("utf-8", "surrogatepass")
    hit = set(places)
    out, keep = [], 0
    spans = [m.span() for m in WORD.finditer(raw.lower())]
    for k in places:
        if k - 1 not in hit:
            out.append(raw[keep : spans[k][0]])
        keep = spans[k + 1][0] if k + 1 < len(spans) else spans[k][1]
    out.append(raw[keep:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def remove_contamination(
    docs: DataFrame, items: DataFrame, most_share: float = 0.5, window: int = WINDOW, group_words: int = GROUP_WORDS
) -> DataFrame:
    """``docs`` without hit words, and without rows whose hit share is over ``most_share``.

    From the text goes, for every run of neighbouring hit words, all from its first to its last
    character and the separators up to the next word. Clean rows stay as they are, character for
    character. ``n_chars``, where present, is counted anew for texts that were cut. All other columns
    come out as they were, whatever their names.
    """
    docs, own = set_aside(docs, *ADDED)
    groups = item_groups(items, group_words)
    marked = _marked_by_all_but_last(docs, groups, window)
    shared = docs.sparkSession.sparkContext.broadcast(groups[-1])
    columns = [c for c in docs.columns if c not in ADDED]
    used = marked.select(*columns, *[c for c in ADDED[1:] if c in marked.columns])
    at_text = columns.index("text")
    at_size = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ItemAutomaton(shared.value, window)
        for part in slices(batches, "text"):
            sizes, places, _ = _marks(part, at_text, part.columns[len(columns) :], automaton)
            kept = pa.array([len(p) <= most_share * n for p, n in zip(places, sizes)])
            texts = [cut(t, p.tolist()) if len(p) else t for t, p in zip(part.column(at_text).to_pylist(), places)]
            arrays = list(part.columns[: len(columns)])
            arrays[at_text] = pa.array(texts, pa.string())
            if at_size is not None:
                old = part.column(at_size)
                fresh = [len(t) if len(p) else n for t, p, n in zip(texts, places, old.to_pylist())]
                arrays[at_size] = pa.array(fresh).cast(old.type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(kept)

    return own(used.mapInArrow(run, docs.select(*columns).schema))
