"""A toxicity classifier with a counterfactual penalty.

A text is the set of its word features: words, and beginnings of 4 and 5 letters of longer words,
lower-cased and hashed into a fixed number of cells. A logistic model over the present features is
fitted to labelled texts. For texts that mention an identity term, every term is swapped for another
of its group and the squared difference between the two raw scores is added to the loss: weight that
would rest on the mere mention of a group is pushed to zero, and with it false positives on neutral
mentions. An L1 pull worth ``support`` texts that are half
wrong keeps the weights of chance words at zero.

Training looks at ``LABELLED_BOUND`` labelled rows at most, half of it per label at most, taken in
the order of a hash of the text (a uniform sample of distinct texts, the same on every run); only
their feature cells reach the driver.
Scoring covers every text in whole. Weights have a fixed size and are broadcast.

Defined cases: null and empty texts have no features and score as the bias says (below 0.5 unless
most training rows are toxic); null labels teach nothing; a text labelled both ways is learned both
ways; without rows of both labels the score is the share of label 1 (0 without rows).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.llm.common import slices

CELLS = 1 << 18
LABELLED_BOUND = 12_000
WORD = re.compile(r"[^\W\d_]+")

#: Groups of exchangeable identity terms, by kind of mention.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "disabled", "deaf", "blind"),
)


class Features:
    """Cells of a text's features; words met before are looked up."""

    def __init__(self, cells: int = CELLS, memory: int = 100_000):
        self.cells, self.memory = cells, memory
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            parts = [f"w:{word}"] + [f"p{n}:{word[:n]}" for n in (4, 5) if len(word) >= n]
            found = tuple(xxhash.xxh64_intdigest(p) % self.cells for p in parts)
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[word] = found
        return found

    def text(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        cells: set[int] = set()
        for w in set(WORD.findall(text.lower())):
            cells.update(self.word(w))
        return np.fromiter(sorted(cells), dtype=np.int32, count=len(cells))


@dataclass(frozen=True)
class Swaps:
    """The next term of the same group for every identity term."""

    groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS
    table: dict[str, str] = field(init=False)

    def __post_init__(self) -> None:
        pairs = {a: b for g in self.groups for a, b in zip(g, (*g[1:], g[0]))}
        object.__setattr__(self, "table", pairs)

    def apply(self, text: str) -> str | None:
        """The counterfactual of ``text``, None without an identity term."""
        if not any(w in self.table for w in set(WORD.findall(text.lower()))):
            return None
        return WORD.sub(lambda m: self.table.get(m[0].lower(), m[0]), text)


@dataclass(frozen=True)
class ToxicityParams:
    rounds: int = 150
    rate: float = 0.5
    support: float = 2.0
    penalty: float = 1.0
    bound: int = LABELLED_BOUND
    cells: int = CELLS


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def raw(self, cells: np.ndarray) -> float:
        return float(self.weights[cells].sum()) + self.bias


def fit(rows: list[tuple[np.ndarray, np.ndarray | None, int]], p: ToxicityParams) -> ToxicityModel:
    """Adaptive-rate descent over (cells, swapped cells or None, label), all rows per round in a fixed order."""
    weights = np.zeros(p.cells)
    positive = sum(y for _, _, y in rows)
    if not rows or positive in (0, len(rows)):
        share = min(max(positive / max(len(rows), 1), 1e-6), 1 - 1e-6)
        return ToxicityModel(weights, float(np.log(share / (1 - share))))
    own = _packed([r[0] for r in rows])
    y = np.array([r[2] for r in rows], dtype=float)
    pull = p.support * 0.5 / len(rows)
    pairs = [k for k, r in enumerate(rows) if r[1] is not None]
    left = _packed([rows[k][0] for k in pairs])
    right = _packed([rows[k][1] for k in pairs])
    grown, bias, bias_grown, n = np.zeros(p.cells), 0.0, 0.0, len(rows)
    for _ in range(p.rounds):
        raw = _sums(own, weights, n) + bias
        error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / n
        slope = np.bincount(own[0], weights=error[own[1]], minlength=p.cells)
        if pairs:
            gap = (_sums(left, weights, len(pairs)) - _sums(right, weights, len(pairs))) * 2 * p.penalty / n
            slope += np.bincount(left[0], weights=gap[left[1]], minlength=p.cells)
            slope -= np.bincount(right[0], weights=gap[right[1]], minlength=p.cells)
        grown += slope**2
        step = p.rate / (np.sqrt(grown) + 1e-6)
        weights -= step * slope
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * pull, 0.0)
        bias_grown += error.sum() ** 2
        bias -= p.rate / (np.sqrt(bias_grown) + 1e-6) * error.sum()
    return ToxicityModel(weights, bias)


def _packed(cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(c) for c in cells]
    flat = np.concatenate(cells) if cells else np.zeros(0, np.int32)
    return flat.astype(np.int64), np.repeat(np.arange(len(cells)), sizes)


def _sums(packed: tuple[np.ndarray, np.ndarray], weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(packed[1], weights=weights[packed[0]], minlength=n)


def train(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams(), swaps: Swaps = Swaps()) -> ToxicityModel:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Rows are chosen by hashes alone; only the chosen texts are looked at, where they lie.
    """
    text = F.col("text").cast("string")
    drawn = docs.filter(text.isNotNull()).select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("draw"))
    marked = labels.select(F.col("doc_id").alias("id"), (F.col("toxic").cast("double") == 1).cast("int").alias("toxic")).dropna()
    known = drawn.join(marked, "id").groupBy("toxic", "draw").agg(F.min("id").alias("id"))
    halves = [known.filter(F.col("toxic") == label).orderBy("draw").limit(p.bound // 2) for label in (0, 1)]
    chosen = halves[0].unionByName(halves[1])  # at most ``bound`` rows
    here = (F.col("doc_id") == F.col("id")) & (F.xxhash64(text) == F.col("draw"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), here).select(text.alias("text"), "toxic", "draw")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(p.cells)
        for part in slices(batches, "text"):
            texts = part.column(0).to_pylist()
            changed = [swaps.apply(t) for t in texts]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([features.text(t) for t in texts], kind),
                    pa.array([None if c is None else features.text(c) for c in changed], kind),
                    part.column(1),
                    part.column(2),
                ],
                names=["cells", "swapped", "toxic", "draw"],
            )

    found = sample.mapInArrow(cells, "cells array<int>, swapped array<int>, toxic int, draw long")
    found = found.dropDuplicates(["toxic", "draw"]).toArrow()
    rows = [
        (np.array(c, np.int32), None if s is None else np.array(s, np.int32), y)
        for c, s, y in zip(*(found.column(k).to_pylist() for k in range(3)))
    ]
    return fit(sorted(rows, key=lambda r: (r[2], r[0].tobytes())), p)


def score(docs: DataFrame, model: ToxicityModel, cells: int = CELLS) -> DataFrame:
    """``docs`` with tox_score (0 to 1) and tox_label (1 from 0.5 on); existing columns of these names give way."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    rest = [c for c in docs.columns if c not in ("tox_score", "tox_label")]
    schema = docs.select(*rest).schema.add("tox_score", "double").add("tox_label", "integer")
    at_text = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        features = Features(cells)
        for part in slices(batches, "text"):
            raw = np.array([weights[features.text(t)].sum(dtype=float) + bias for t in part.column(at_text).to_pylist()])
            value = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32))],
                names=[*rest, "tox_score", "tox_label"],
            )

    return docs.select(*rest).mapInArrow(run, schema)
