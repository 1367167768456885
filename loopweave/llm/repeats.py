"""Suffix-array deduplication: every byte of a string of ``length`` bytes that also starts earlier goes.

**Anchors.** The smallest hash among the k-grams of a window of ``length`` bytes is its anchor. Equal
windows have equal anchors, so only places around anchors that occur more than once can repeat. The
windows of one anchor form a segment, at most ``2 * length - k`` bytes of text. Equal segments are one
class, known by its first place; each later place is a repeat as a whole.

**Interval expansion.** The classes of an anchor meet in a block of segments, where a suffix array and
its Burrows-Wheeler transform are built. Starting from the interval of the empty string, intervals are
extended backwards, breadth first; when the intervals of strings of l bytes are extended, the ends that
are still open separate suffixes with a common prefix of exactly l bytes. The expansion stops before
``length``: ends open then lie between suffixes that share ``length`` bytes or more, which gives the
classes of equal windows. All but the earliest window of each are repeats.

**Hot anchors.** An anchor with more than ``HOT`` classes is cut into parts of ``STEPS`` windows, each
named by the bytes its windows share, and those into single windows where they are still hot. Equal
parts collapse again, so a block stays small whatever one passage is surrounded by.

The filter that finds repeated anchors in the second reading is a Bloom filter of bounded size; a false
positive makes a class without a partner.

Defined cases: null text is empty; texts shorter than ``length`` keep all bytes; repeated rows are one
document and all get its answer; different texts under one doc_id come one after the other in the order
of their hashes; a null doc_id comes before all others; an empty table gives no rows. Other columns of
the table are kept by ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.llm.common import Bloom, slices, stored
from loopweave.session import bound_batches

LENGTH = 100
#: Bytes of the words that the sort of a block begins with.
WORD = 5
GRAM = 32
CHUNK = 1 << 20
#: Bytes of short texts that are hashed together.
GROUP = 1 << 18
#: Classes of an anchor up to which they meet in one block, and the windows of the parts beyond it.
HOT = 1024
STEPS = (8, 1)
#: Bytes of segments in a block, and classes that a task remembers while it reads.
BLOCK = 1 << 20
REMEMBERED = 100_000
NO_ID = -(1 << 63)
PLACE = np.uint64((1 << 21) - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= MIX
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every place on: a sum of its words of 8 bytes with odd factors, scrambled."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    n = len(data) - GRAM + 1
    out = words[:n] * MIX
    for at in range(8, GRAM, 8):
        out += words[at : at + n] * np.uint64((int(MIX) * (2 * at + 1)) % (1 << 64))
    return _scramble(out)


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    size = stop - start
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window the place of its anchor (the first smallest hash), and the hashes of all places."""
    hashes = gram_hashes(data)
    low = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    return (low & PLACE).astype(np.int64), hashes.view(np.int64)


def segments(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """data, text, shift, first, n, anchor, hash of the segments of all texts, some of them at a time.

    Segment i belongs to ``texts[text[i]]``; its ``n[i]`` windows start at ``first[i]`` of ``data``, which
    is ``shift[i]`` further on in the text. Long texts are read in chunks that overlap by all but a window.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def found():
        data = b"".join(piece for _, _, piece in held)
        ends = np.cumsum([len(piece) for _, _, piece in held])
        begins = ends - np.array([len(piece) for _, _, piece in held])
        place, hashes = _anchors(np.frombuffer(data, np.uint8), length)
        start = _ranges(begins, np.maximum(ends - length + 1, begins))
        of = np.repeat(np.arange(len(held)), np.maximum(ends - length + 1 - begins, 0))
        anchor = place[start]
        at = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        n = np.diff(np.append(at, len(start)))
        first, of, anchor = start[at], of[at], anchor[at]
        text = np.array([t for t, _, _ in held])[of]
        shift = np.array([s for _, s, _ in held])[of] - begins[of]
        return data, text, shift, first, n, anchor, hashes[anchor]

    for t, text in enumerate(texts):
        for base in range(0, len(text) - length + 1, CHUNK):
            piece = text[base : base + CHUNK + length - 1]
            if held and size + len(piece) > GROUP:
                yield found()
                held, size = [], 0
            held.append((t, base, piece))
            size += len(piece)
    if held:
        yield found()


def suffix_order(codes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """order, word: circular suffixes of ``codes`` (bytes, below 2**21) sorted by ``length`` bytes or more, and where a new first word begins.

    Words of ``WORD`` bytes (fewer below that ``length``) are sorted first, then pairs of ranks, of doubled
    length. A key carries its place in its low bits, so that values are sorted, not places.
    """
    n = len(codes)
    if n > PLACE:
        raise ValueError("a block holds at most 2 MB")
    size = min(WORD, length)
    bits, place = np.uint64(21), np.arange(n, dtype=np.uint64)
    looped = np.resize(codes, n + 8)
    key = np.ndarray(n, ">u8", looped, strides=(1,)).astype(np.uint64) >> np.uint64(64 - 8 * size)
    words = None
    while True:
        key = np.sort((key << bits) | place)
        order = (key & PLACE).astype(np.int32)
        key >>= bits
        begins = np.concatenate([[True], key[1:] != key[:-1]])
        words = begins if words is None else words
        if size >= length or begins.all():
            return order, words
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(begins, dtype=np.uint64) - np.uint64(1)
        key = (rank << bits) | np.roll(rank, -size)
        size *= 2


def open_ends(bwt: np.ndarray, words: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether sorted suffix i shares ``length`` bytes or more with its predecessor.

    Breadth-first backward extension of intervals (Beller, Gog, Ohlebusch and Schnattinger 2013), from the
    intervals of the first words on, which the sort has found: an interval is extended by each byte of its
    part of the transform, all intervals of a level at once. A byte's last occurrence in the interval gives
    the right end of the longer string's interval, its first occurrence the left end. An interval goes on
    only where its right end was still open.
    """
    n = len(bwt)
    by_byte = np.argsort(bwt, kind="stable").astype(np.int32)
    to = np.empty(n, np.int32)
    to[by_byte] = np.arange(n, dtype=np.int32)
    same = bwt[by_byte][1:] == bwt[by_byte][:-1]
    following, preceding = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    following[by_byte[:-1][same]] = by_byte[1:][same]
    preceding[by_byte[1:][same]] = by_byte[:-1][same]
    still = np.append(~words, False)
    start = np.flatnonzero(words).astype(np.int32)
    stop = np.append(start[1:], np.int32(n))
    for _ in range(min(WORD, length), length):
        size = stop - start
        skip = np.cumsum(size, dtype=np.int32) - size
        inside = np.arange(size.sum(), dtype=np.int32) + np.repeat(start - skip, size)
        last = inside[following[inside] >= np.repeat(stop, size)]
        first = inside[preceding[inside] < np.repeat(start, size)]
        stop = np.sort(to[last]) + np.int32(1)
        new = still[stop]
        start, stop = np.sort(to[first])[new], stop[new]
        if not len(stop):
            break
        still[stop] = False
    return still[:n]


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For all windows of all parts, part after part: whether an earlier part holds the same window.

    No part may hold one window twice (as segments of one anchor never do).
    """
    size = np.array([len(p) for p in parts])
    begins = np.cumsum(size + 1) - size - 1
    codes = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    order, words = suffix_order(codes, length)
    group = np.cumsum(~open_ends(codes[order - 1], words, length))
    of = np.empty(len(codes), np.int64)
    of[order] = group
    place = _ranges(begins, begins + size - length + 1)
    group = of[place]
    by = np.argsort(group, kind="stable")
    later = np.concatenate([[False], group[by][1:] == group[by][:-1]])
    out = np.empty(len(place), bool)
    out[by] = later
    return out


CLASS = "h long, k long, d long, t long, anchor long, lo long, n long, part binary"
JUDGED = "d long, t long, lo long, start long, n long"
JUDGED_NAMES = ["d", "t", "lo", "start", "n"]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(batch.schema.get_field_index("text"))]


def anchor_counts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """h, count of the anchors of all texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for *_, hashes in segments(_texts(batch), length):
                yield pa.RecordBatch.from_arrays([pa.array(hashes)], names=["h"])

    return docs.select("text").mapInArrow(read, "h long").groupBy("h").count()


def classes(docs: DataFrame, repeated, length: int = LENGTH) -> DataFrame:
    """The distinct segments of repeated anchors, each with its first place; ``docs(d, t, text)``."""
    names = ["h", "k", "d", "t", "anchor", "lo", "n", "part"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bloom(repeated.value)
        seen: dict[bytes, tuple[int, int, int]] = {}
        for batch in slices(batches, "text"):
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for data, text, shift, first, n, anchor, h in segments(_texts(batch), length):
                keep = np.flatnonzero(known.holds(h))
                rows = []
                if len(seen) > REMEMBERED:
                    seen.clear()
                for x, s, lo, many, a, hash_ in zip(*(c[keep].tolist() for c in (text, shift, first, n, anchor, h))):
                    part = data[lo : lo + many + length - 1]
                    place = (ids[x], hashes[x], a + s)
                    before = seen.get(part)
                    if before is None or place < before:
                        seen[part] = place
                        rows.append((hash_, xxhash.xxh64_intdigest(part) - (1 << 63), *place, lo + s, many, part))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    rows = docs.select("d", "t", "text").mapInArrow(read, CLASS)
    return _first(rows)


def _first(rows: DataFrame) -> DataFrame:
    """One row per class, that of its first place."""
    place = F.min(F.struct("d", "t", "anchor", "lo", "n", "part")).alias("p")
    return rows.groupBy("h", "k").agg(place).select("h", "k", "p.*")


def _parts(rows: DataFrame, step: int, length: int) -> DataFrame:
    """Segments cut into parts of ``step`` windows by their distance from the anchor, named by what a part's windows share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                part, lo, anchor = row["part"], row["lo"], row["anchor"]
                far = anchor - lo
                for block in range((far - row["n"] + 1) // step, far // step + 1):
                    # Windows whose distance from the anchor lies in [block * step, block * step + step).
                    start = max(lo, anchor - block * step - step + 1)
                    stop = min(lo + row["n"], anchor - block * step + 1)
                    common = anchor - block * step - lo
                    core = part[common : common + length - step + 1]
                    own = part[start - lo : stop - lo + length - 1]
                    out.append((xxhash.xxh64_intdigest(core, block + 1) - (1 << 63), xxhash.xxh64_intdigest(own, step) - (1 << 63), row["d"], row["t"], anchor, start, stop - start, own, lo))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["h", "k", "d", "t", "anchor", "lo", "n", "part", "whole"])

    return rows.select("h", "k", "d", "t", "anchor", "lo", "n", "part").mapInArrow(cut, f"{CLASS}, whole long")


def _expand(rows: DataFrame, length: int) -> DataFrame:
    """d, t, lo, start, n: the repeated windows of classes that share their anchor with others; ``rows`` lie dealt by h."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def judged():
            held.sort(key=lambda r: r[1:4])
            later = repeated_windows([r[6] for r in held], length)
            at, out = 0, []
            for _, d, t, _, lo, n, _ in held:
                own = np.flatnonzero(np.diff(later[at : at + n], prepend=False, append=False))
                at += n
                for start, stop in own.reshape(-1, 2).tolist():
                    out.append((d, t, lo, lo + start, stop - start))
            held.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=JUDGED_NAMES)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK and row[0] != held[-1][0]:
                    yield from judged()
                    size = 0
                held.append(row)
                size += len(row[6]) + 1
        if held:
            yield from judged()

    columns = rows.select("h", "d", "t", "anchor", "lo", "n", "part")
    return columns.sortWithinPartitions("h").mapInArrow(judge, JUDGED)


def _likely(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The classes whose h is among ``keys``, by a Bloom filter: few others stay."""
    words = rows.sparkSession.sparkContext.broadcast(Bloom.gather(keys, "h", Bloom.size_for(keys.count())).words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bloom(words.value)
        for batch in batches:
            yield batch.filter(pa.array(known.holds(batch.column(0).to_numpy())))

    return rows.select("h", "k", "d", "t", "anchor", "lo", "n", "part").mapInArrow(keep, CLASS)


def _judge(found: DataFrame, steps: tuple[int, ...], hot: int, length: int) -> DataFrame:
    """d, t, lo, start, n: the repeated windows of the first places of all classes ``found`` (a stored table)."""
    many = stored(found.groupBy("h").agg(F.count("*").alias("classes")).filter("classes > 1"), "repeat-shared")
    # Dealt before the join, which keeps that layout: segments are shuffled once, without those of lone classes.
    shared = _likely(found, many).repartition("h").join(many, "h")
    if not steps or not many.filter(F.col("classes") > hot).limit(1).count():
        return _expand(shared, length)
    parts = stored(_parts(shared.filter(F.col("classes") > hot), steps[0], length), "repeat-parts")
    first = stored(_first(parts), "repeat-part-classes")
    # A part that is equal to an earlier one is repeated whole, the first of its class is judged again.
    place = first.select("h", "k", F.struct("d", "t", "anchor").alias("first"))
    later = parts.join(place, ["h", "k"]).filter(F.struct("d", "t", "anchor") != F.col("first"))
    judged = _judge(first, steps[1:], hot, length)
    home = parts.select("d", "t", F.col("lo").alias("part_lo"), "whole").distinct()
    inner = judged.withColumnRenamed("lo", "part_lo").join(home, ["d", "t", "part_lo"])
    cut = later.select("d", "t", F.col("whole").alias("lo"), F.col("lo").alias("start"), "n")
    return _expand(shared.filter(F.col("classes") <= hot), length).union(cut).union(
        inner.select("d", "t", F.col("whole").alias("lo"), "start", "n")
    )


def repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``docs(doc_id, text)`` with kept (binary), n_bytes, n_removed, n_spans.

    ``kept`` are the bytes that no string of ``length`` bytes covers that also starts earlier.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    spark = docs.sparkSession
    bound_batches(spark, 8 << 20)
    place = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("t")]
    keyed = docs.select(*place, "doc_id", "text")
    twice = stored(anchor_counts(docs, length).filter("count > 1").select("h"), "repeated-anchors")
    repeated = spark.sparkContext.broadcast(Bloom.gather(twice, "h", Bloom.size_for(twice.count())).words)
    found = stored(classes(keyed, repeated, length), "repeat-classes", "zstd")
    judged = _judge(found, STEPS, hot, length)
    firsts = found.select("d", "t", "lo", F.col("lo").alias("start"), F.lit(0).cast("long").alias("n")).union(judged)
    known = firsts.groupBy("d", "t").agg(F.collect_list(F.struct("lo", "start", "n")).alias("known"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Bloom(repeated.value)
        for batch in slices(batches, "text"):
            texts = _texts(batch)
            lo, start, n = (c.to_numpy() for c in batch.column(2).flatten().flatten())
            of = np.repeat(np.arange(len(texts)), pc.list_value_length(batch.column(2)).to_numpy())
            sizes = np.array([len(x) for x in texts])
            base = np.concatenate([[0], np.cumsum(sizes + 1)])
            first = np.sort(lo + base[of])
            begins = [start[n > 0] + base[of[n > 0]]]
            many = [n[n > 0]]
            for _, text, shift, place, windows, _, h in segments(texts, length):
                whole = place + shift + base[text]
                near = np.searchsorted(first, whole)
                later = anchors.holds(h) & (first[np.minimum(near, len(first) - 1)] != whole) if len(first) else anchors.holds(h)
                begins.append(whole[later])
                many.append(windows[later])
            begins, many = np.concatenate(begins), np.concatenate(many)
            by = np.argsort(begins, kind="stable")
            begins = begins[by]
            stops = np.maximum.accumulate(begins + many[by] + length - 1)
            fresh = np.flatnonzero(np.concatenate([[True], begins[1:] > stops[:-1]])) if len(begins) else by
            begins, stops = begins[fresh], stops[np.append(fresh[1:], len(stops)) - 1] if len(fresh) else begins
            owner = np.searchsorted(base, begins, "right") - 1
            removed = np.bincount(owner, stops - begins, len(texts)).astype(np.int64)
            spans = np.bincount(owner, minlength=len(texts))
            kept = list(texts)
            at = np.concatenate([[0], np.cumsum(spans)])
            for i in np.flatnonzero(spans):
                cuts = zip([0, *(stops[at[i] : at[i + 1]] - base[i])], [*(begins[at[i] : at[i + 1]] - base[i]), sizes[i]])
                kept[i] = b"".join([texts[i][a:b] for a, b in cuts])
            columns = [batch.column(0), *(pa.array(c.astype(np.int64)) for c in (sizes, removed, spans)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    none = F.array().cast("array<struct<lo:bigint,start:bigint,n:bigint>>")
    joined = keyed.join(known, ["d", "t"], "left").select("doc_id", "text", F.coalesce("known", none).alias("known"))
    return joined.mapInArrow(cut, schema)
