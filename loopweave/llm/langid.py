"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1 that its code point fixes. A trigram of letters is
bound into one vector: the first letter's vector permuted (rolled) twice, the second's once, the
third's not at all, multiplied element by element. A text is the bundle (sum) of its trigram
vectors, a language the bundle of its training texts, each text weighing the same. A text gets the
language whose prototype has the largest cosine with it.

Text is lower-cased; every run of characters that are no letters is one blank, also at both ends.
Bundling is linear, so training gathers trigram weights per language with ordinary partial sums
over all training rows and binds them once, in slices; no text leaves its task. Prototypes are one
vector per language, few by nature.

Defined cases: null text, or text without a letter, is ``und`` with score 0. Without any learned
language every row is ``und``. Equal cosines: the language that sorts first. Repeated rows are
judged one by one and learned as often as they occur. The score is the winning cosine, 0 at least.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.llm.common import mix64, slices

WIDTH = 1024
BLANK = 32
SLICE_BYTES = 1 << 20
SLICE_ROWS = 256


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point: the lower-case code point of a letter, else the blank."""
    own = np.full(sys.maxunicode + 1, BLANK, dtype=np.int32)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            own[point] = ord(low[0]) if low[0].isalpha() else point
    return own


def letter_vectors(points: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """One row of +1 and -1 per code point, the same on every machine."""
    cells = points.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(width, dtype=np.uint64)
    return ((mix64(mix64(cells) + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(40)) & np.uint64(1)).astype(np.int8) * 2 - 1


def bind(trigrams: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Vectors of trigrams packed as ``(first << 42) | (second << 21) | third``."""
    parts = np.stack([trigrams >> 42, (trigrams >> 21) & 0x1FFFFF, trigrams & 0x1FFFFF])
    points, at = np.unique(parts, return_inverse=True)
    vectors = letter_vectors(points, width)
    at = at.reshape(parts.shape)
    return np.roll(vectors, 2, axis=1)[at[0]] * np.roll(vectors, 1, axis=1)[at[1]] * vectors[at[2]]


def trigram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of a slice, the counts (texts x trigrams) and each text's letters."""
    blank = [" " if t is None else f" {t} " for t in texts]
    points = np.frombuffer("".join(blank).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(b) for b in blank])
    letters = _letters()[points]
    solid = letters != BLANK
    n_letters = np.bincount(owner[solid], minlength=len(texts))
    keep = solid.copy()
    keep[0] = True
    keep[1:] |= solid[:-1] | (owner[1:] != owner[:-1])
    letters, owner = letters[keep], owner[keep]
    if len(letters) < 3:
        return np.zeros(0, np.int64), np.zeros((len(texts), 0)), n_letters
    whole = owner[2:] == owner[:-2]
    seen = np.zeros(sys.maxunicode + 1, dtype=bool)
    seen[letters] = True
    alphabet = np.flatnonzero(seen)
    rank = np.zeros(sys.maxunicode + 1, dtype=np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    code, size = rank[letters], len(alphabet)
    keys = ((code[:-2] * size + code[1:-1]) * size + code[2:])[whole]
    owner = owner[2:][whole]
    if size**3 <= 1 << 24:
        present = np.zeros(size**3, dtype=bool)
        present[keys] = True
        distinct = np.flatnonzero(present)
        place = np.zeros(size**3, dtype=np.int64)
        place[distinct] = np.arange(len(distinct))
        column = place[keys]
    else:
        distinct, column = np.unique(keys, return_inverse=True)
    counts = np.bincount(owner * len(distinct) + column, minlength=len(texts) * len(distinct))
    packed = (alphabet[distinct // size**2] << 42) | (alphabet[distinct // size % size] << 21) | alphabet[distinct % size]
    return packed, counts.reshape(len(texts), len(distinct)), n_letters


def learn(rows: DataFrame, width: int = WIDTH) -> dict[str, np.ndarray]:
    """Prototypes by language from ``rows(text, lang)``; null text or language teaches nothing."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES, SLICE_ROWS):
            packed, counts, _ = trigram_counts(part.column(0).to_pylist())
            total = counts.sum(axis=1)
            share = counts / np.maximum(total, 1)[:, None]
            langs = np.array(part.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                weight = share[langs == lang].sum(axis=0)
                some = np.flatnonzero(weight)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(packed[some]), pa.array(weight[some])],
                    names=["lang", "trigram", "weight"],
                )

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            trigrams, weight = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for at in range(0, len(langs), 4096):
                vectors = bind(trigrams[at : at + 4096], width)
                for lang in set(langs[at : at + 4096]):
                    mine = langs[at : at + 4096] == lang
                    sums[lang] = sums.get(lang, 0.0) + weight[at : at + 4096][mine] @ vectors[mine]
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * width), pa.array(np.arange(width, dtype=np.int32)), pa.array(vector)],
                names=["lang", "cell", "value"],
            )

    known = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()
    weights = (
        known.mapInArrow(gather, "lang string, trigram long, weight double")
        .groupBy("lang", "trigram")
        .agg(F.sum("weight").alias("weight"))
    )
    cells = weights.mapInArrow(project, "lang string, cell int, value double").groupBy("lang", "cell").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for row in cells.toLocalIterator():
        found.setdefault(row["lang"], np.zeros(width))[row["cell"]] = row["value"]
    return {k: v for k, v in sorted(found.items()) if np.any(v)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], width: int = WIDTH) -> DataFrame:
    """``docs`` with lang_pred and score; existing columns of these names give way."""
    names = sorted(prototypes)
    unit = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]).astype(np.float32) if names else None
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")
    at_text = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES, SLICE_ROWS):
            packed, counts, letters = trigram_counts(part.column(at_text).to_pylist())
            langs, scores = ["und"] * part.num_rows, np.zeros(part.num_rows)
            if names and len(packed):
                bundle = counts.astype(np.float32) @ bind(packed, width).astype(np.float32)
                length = np.linalg.norm(bundle, axis=1)
                cosines = (bundle @ unit.T) / np.maximum(length, 1e-12)[:, None]
                best = cosines.argmax(axis=1)
                langs = [names[b] if n else "und" for b, n in zip(best, letters)]
                scores = np.where(letters > 0, np.clip(cosines.max(axis=1), 0.0, 1.0), 0.0).astype(float)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*rest, "lang_pred", "score"],
            )

    return docs.select(*rest).mapInArrow(run, schema)
