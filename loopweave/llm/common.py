"""Shared helpers: table access, bounded text batches, Bloom bits, byte-wise words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.session import materialize, scratch_path

MIX = np.uint64(0x9E3779B97F4A7C15)


#: Rows in an Arrow batch of texts: a worker holds a few MB of them at a time, not ten thousand.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python workers small in this session from now on."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, to be read in small batches."""
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with its columns of these names (in any case) renamed, and the way back to its own columns.

    An operator that needs the names for columns of its own works on the first and hands its rows to the
    second, which picks the columns of ``df`` in their order under their old names, and ``more`` behind them.
    Without such columns the first is ``df`` as it is.
    """
    taken = {n.lower() for n in names}
    used = taken | {c.lower() for c in df.columns}
    other = {}
    for c in df.columns:
        if c.lower() in taken:
            n = 1
            while f"{c}_{n}".lower() in used:
                n += 1
            other[c] = f"{c}_{n}"
            used.add(other[c].lower())
    quoted = ["`" + other.get(c, c).replace("`", "``") + "`" for c in df.columns]
    own = df.columns

    def back(out: DataFrame, *more: Column | str) -> DataFrame:
        return out.select(*[F.col(q).alias(c) for q, c in zip(quoted, own)], *more)

    return (df.withColumnsRenamed(other) if other else df), back


def slices(
    batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20, most_rows: int = 1 << 16
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` (a string or binary) holds about ``most_bytes``, one row at least, and ``most_rows``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.nan_to_num(
            pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)
        )
        ends = np.cumsum(sizes + 1)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            stop = min(stop, start + most_rows)
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Bloom:
    """A bit array of fixed size; membership is a pure function of a 64-bit key."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.bits = np.uint64(len(words) * 64)

    @staticmethod
    def size_for(keys: int, most_bits: int = 1 << 27) -> int:
        """About 8 bits a key, a power of two between 2**16 and ``most_bits``."""
        return min(most_bits, 1 << max(16, (8 * max(keys, 1) - 1).bit_length()))

    @classmethod
    def gather(cls, keys: DataFrame, column: str, bits: int) -> "Bloom":
        """Set the bit of every key; at most ``bits / 64`` rows reach the driver."""
        at = F.pmod(F.col(column), F.lit(bits))
        rows = (
            keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 64) as int))").alias("b"))
            .groupBy("w")
            .agg(F.bit_or("b").alias("b"))
            .toArrow()
        )
        words = np.zeros(bits // 64, dtype=np.uint64)
        words[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
        return cls(words)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) % self.bits
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.parquet(path)


__all__ = ["Bloom", "bound_batches", "MIX", "materialize", "mix64", "set_aside", "slices", "stored", "table"]
