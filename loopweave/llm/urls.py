"""URL filter: listed rules first, then the ratio of two character language models.

Two smoothed variable-order Markov models are learned from URLs, one from accepted, one from
rejected ones. A character's probability starts from the uniform one and is sharpened by ever longer
contexts, up to ``order`` characters: ``p = (count + beta * shorter) / (context + beta)``. A context
never seen leaves the shorter one's value, so every position uses the order that the data support.
A URL's score is the difference of its log-likelihoods under the two models per character. The
threshold is calibrated on ruled URLs the models have not seen, a fifth of them by hash of the URL: it is the
one with the best mean of both classes' accuracies, by a histogram of scores.

Counts of all n-grams of all training URLs are gathered with partial sums and kept as a stored table with
a row per gram (named by 63 bits of hash), which grows with the input and is nowhere held as a whole. For
scoring, URLs are sorted into chunks of bounded text, so that neighbours share most grams; each chunk's
distinct grams are joined with the counts, and a chunk meets the counts of its own grams only.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; an
empty text scores 0. Without training URLs of both classes scores are 0. A score at the threshold
is allowed; the threshold is 0 without calibration URLs of both classes. Repeated URLs count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopweave.llm.common import mix64, set_aside, slices, stored

ORDER = 5
#: Bytes of URLs in a task, in a chunk (one URL at least), and worked on at once.
PART_BYTES = 1 << 20
CHUNK_BYTES = 1 << 18
WORK_BYTES = 1 << 16
BETA = 2.0
SYMBOLS = 256.0
BINS = 2000
SPREAD = 10.0
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), CAPITALS, CAPITALS.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per order 0..order: 64-bit hashes of contexts and of contexts with their character; the owners.

    Every text is preceded by ``order`` blanks of its own, so that its beginning is a context too.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw])
    whole = np.frombuffer(b"".join(b"\0" * order + r for r in raw), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    starts = np.cumsum(sizes + order) - sizes
    at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)]) if len(raw) else np.zeros(0, int)
    at = at.astype(np.int64)
    context = np.zeros((order + 1, len(at)), dtype=np.uint64)
    for n in range(1, order + 1):
        context[n] = mix64(context[n - 1] + (whole[at - n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    for n in range(order + 1):
        context[n] = mix64(context[n] + np.uint64(n + 1))
    with_next = mix64(context ^ ((whole[at] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return context, with_next, owner


def _named(hashes: np.ndarray) -> np.ndarray:
    """63 bits of the hashes, as Spark's longs."""
    return (hashes >> np.uint64(1)).view(np.int64)


def _distinct(texts: list[str | None], order: int) -> np.ndarray:
    context, with_next, _ = _grams(texts, order)
    return np.unique(_named(np.concatenate([context.ravel(), with_next.ravel()])))


def _scores(texts: list[str | None], order: int, beta: float, names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Scores by the counts (row 0: rejected, row 1: accepted) of the sorted ``names``; other grams were never seen."""
    context, with_next, owner = _grams(texts, order)
    if not len(owner) or not len(names):
        return np.zeros(len(texts))

    def count(hashes: np.ndarray) -> np.ndarray:
        wanted = _named(hashes)
        at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        return np.where(names[at] == wanted, counts[:, at], 0)

    p = np.full((2, len(owner)), 1.0 / SYMBOLS)
    for n in range(order + 1):
        p = (count(with_next[n]) + beta * p) / (count(context[n]) + beta)
    sums = np.bincount(owner, weights=np.log(p[1]) - np.log(p[0]), minlength=len(texts))
    return sums / np.maximum(np.bincount(owner, minlength=len(texts)), 1)


@dataclass
class UrlModels:
    """counts(gram, rejected, accepted): a stored row for every gram of the training URLs."""

    counts: DataFrame
    ready: bool
    order: int = ORDER
    beta: float = BETA
    threshold: float = 0.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of a few texts, for the driver."""
        if not self.ready or not any(texts):
            return np.zeros(len(texts))
        wanted = self.counts.sparkSession.createDataFrame(pa.table({"gram": _distinct(texts, self.order)}))
        found = self.counts.join(wanted, "gram", "left_semi").orderBy("gram").toArrow()
        return _scores(texts, self.order, self.beta, found["gram"].to_numpy(), _both(found))


def _both(found: pa.Table) -> np.ndarray:
    return np.array([found["rejected"].to_numpy(), found["accepted"].to_numpy()], dtype=float)


def learn(urls: DataFrame, order: int = ORDER) -> UrlModels:
    """Models from ``urls(text, accepted boolean)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 19):
            context, with_next, owner = _grams(part.column(0).to_pylist(), order)
            accepted = np.tile(part.column(1).to_numpy(zero_copy_only=False).astype(bool)[owner], 2 * (order + 1))
            names, at = np.unique(_named(np.concatenate([context.ravel(), with_next.ravel()])), return_inverse=True)
            n = [np.bincount(at[side], minlength=len(names)) for side in (~accepted, accepted)]
            yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(x.astype(np.int64)) for x in n)], names=["gram", "rejected", "accepted"])

    grams = urls.select("text", "accepted").dropna().mapInArrow(run, "gram long, rejected long, accepted long")
    counts = stored(grams.groupBy("gram").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted")), "url-grams")
    ready = counts.agg(F.max("rejected") > 0, F.max("accepted") > 0).first()
    return UrlModels(counts, bool(ready[0] and ready[1]), order)


def chunked(urls: DataFrame) -> DataFrame:
    """``urls`` with _chunk, stored: chunks of at most CHUNK_BYTES (one row at least) of URLs sorted by text."""
    size = urls.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    rows = urls.withColumn("_chunk", F.monotonically_increasing_id())
    # The row number parts repeated URLs, so that no task holds more than its share.
    dealt = rows.repartitionByRange(1 + size // PART_BYTES, "text", "_chunk").sortWithinPartitions("text", "_chunk")
    at_text = urls.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 33, 0
        for part in slices(batches, "text", WORK_BYTES):
            size = sum(len(x.as_buffer()) if x.is_valid else 0 for x in part.column(at_text)) + part.num_rows
            if held and held + size > CHUNK_BYTES:
                chunk, held = chunk + 1, 0
            held += size
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.full(part.num_rows, chunk))], names=part.schema.names)

    return stored(dealt.mapInArrow(run, dealt.schema), "url-chunks")


def scored_chunks(chunks: DataFrame, models: UrlModels) -> DataFrame:
    """``chunks``, as ``chunked`` makes them, without _chunk and with lm_score of the column ``text``."""
    columns = [c for c in chunks.columns if c != "_chunk"]
    if not models.ready:
        return chunks.select(*columns, F.lit(0.0).alias("lm_score"))
    order, beta = models.order, models.beta

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(chunk: int, seen: list[np.ndarray]) -> pa.RecordBatch:
            names = np.unique(np.concatenate(seen))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), chunk)), pa.array(names)], names=["_chunk", "gram"])

        now, seen = None, []
        for part in slices(batches, "text", WORK_BYTES):
            texts, owners = part.column(0).to_pylist(), part.column(1).to_numpy()
            for chunk in np.unique(owners):
                if chunk != now and seen:
                    yield done(now, seen)
                    seen = []
                now = chunk
                seen.append(_distinct([t for t, o in zip(texts, owners) if o == chunk], order))
        if seen:
            yield done(now, seen)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("gram")
        names, counts = right["gram"].to_numpy(), _both(right)
        parts = slices(left.to_batches(), "text", WORK_BYTES)
        value = [_scores(x.column("text").to_pylist(), order, beta, names, counts) for x in parts]
        return left.select(columns).append_column("lm_score", pa.array(np.concatenate([*value, np.zeros(0)])))

    # Spark sizes the rows of a Python step by those it reads, here a hundredth of them or less: neither side may be broadcast.
    wanted = chunks.select("text", "_chunk").mapInArrow(grams, "_chunk long, gram long").hint("merge")
    found = wanted.join(models.counts, "gram").select("_chunk", "gram", "rejected", "accepted")
    schema = chunks.select(*columns).schema.add("lm_score", "double")
    return chunks.groupBy("_chunk").cogroup(found.groupBy("_chunk")).applyInArrow(score, schema)


def scored(urls: DataFrame, models: UrlModels) -> DataFrame:
    """``urls`` with lm_score of the column ``text``; a column of that name gives way, all others stay as they were."""
    aside, own = set_aside(urls.drop("lm_score"), "_chunk")
    return own(scored_chunks(chunked(aside), models), "lm_score")


def calibrated(urls: DataFrame, models: UrlModels) -> UrlModels:
    """The models with the threshold that best parts ``urls(text, accepted)``, from a histogram."""
    models.threshold = best_threshold(scored(urls.select("text", "accepted").dropna(), models))
    return models


def best_threshold(scores: DataFrame) -> float:
    """The value that best parts ``scores(accepted, lm_score)``; 0 without both classes."""
    width = 2 * SPREAD / BINS
    cell = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("lm_score") + SPREAD) / width)))
    rows = scores.groupBy("accepted", cell.alias("cell")).count().collect()
    seen = np.zeros((2, BINS))
    for r in rows:
        seen[int(r["accepted"]), r["cell"]] += r["count"]
    if not seen.sum(axis=1).all():
        return 0.0
    share = seen / seen.sum(axis=1, keepdims=True)
    below = np.concatenate([[0.0], np.cumsum(share[0])])
    above = 1.0 - np.concatenate([[0.0], np.cumsum(share[1])])
    good = below + above
    ties = np.flatnonzero(good >= good.max() - 1e-12)
    return float(ties[len(ties) // 2] * width - SPREAD)


def judge(pages: DataFrame, rules: list[Rule], order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, lm_score of every row of ``pages(page_id, url)``."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    plain = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("url").cast("string").alias("text"))
    ruled = plain.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    ruled = ruled.select("page_id", "host", "path", "text", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))
    chunks = chunked(ruled)
    accepted = (F.col("verdict") == "allow").alias("accepted")
    kept_back = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    known = F.col("verdict").isNotNull() & F.col("text").isNotNull()
    models = learn(chunks.filter(known & ~kept_back).select("text", accepted), order)
    scores = stored(scored_chunks(chunks, models), "url-scores")
    models.threshold = best_threshold(scores.filter(known & kept_back).select(accepted, "lm_score"))
    verdict = F.coalesce("verdict", F.when(F.col("lm_score") >= models.threshold, "allow").otherwise("block"))
    return scores.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "lm_score")


__all__ = ["Rule", "UrlModels", "calibrated", "host_of", "judge", "learn", "path_of", "rule_of", "scored"]
