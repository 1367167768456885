"""Graphs in blocks: iterative messages whose rounds exchange packed arrays.

The edges are dealt into blocks of about ``BLOCK`` rows once and stored, a row of arrays per block.
A round shuffles, for every two blocks, the bare numbers one sends the other: which edge a number
belongs to follows from its place. What a task holds is bounded by a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.plans.rounds import bucketed, drop_bucketed
from loopweave.plans.vectors import items

#: Edges and nodes in a block at most, on the mean.
BLOCK, NODES = 1 << 18, 1 << 16


def block_of(count: int, *cols: Column | str) -> Column:
    """The block of a key among ``count``."""
    return F.pmod(F.xxhash64(*cols), F.lit(count)).cast("int")


def blocks_for(rows: int, nodes: int = 0) -> int:
    return max(1, math.ceil(rows / BLOCK), math.ceil(nodes / NODES))


def _starts(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, where each starts, ending with the length)."""
    keys, at = np.unique(sorted_keys, return_index=True)
    return keys, np.append(at, len(sorted_keys))


LINKS = "block int, counts binary, others binary, nodes binary, answers binary"
SEATS = "block int, counts binary, others binary, places binary, answers binary, ids binary, phi binary"
_SEATS = ["block", "counts", "others", "places", "answers", "ids", "phi"]
STATE = "block int, other int, kind string, step int, total double, n bigint, ids binary, data binary"
_STATE = ["block", "other", "kind", "step", "total", "n", "ids", "data"]


def _links(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
    """The directed edges of a block in the order in which messages come in, and that of the answers."""
    rows = rows.sort_values(["owner", "node", "nbr"])
    owner, node, nbr = (rows[c].to_numpy() for c in ("owner", "node", "nbr"))
    others, at = _starts(owner)
    arrays = np.diff(at), others.astype(np.int64), node.astype(np.int64), np.lexsort((node, nbr, owner)).astype(np.int32)
    return pd.DataFrame(
        [(int(key[0]), *[a.tobytes() for a in arrays])], columns=["block", "counts", "others", "nodes", "answers"]
    )


class MessageBlocks:
    """Both directions of every edge in blocks of whole nodes; nodes with very many neighbours belong into ``MessageRows``.

    ``nodes`` is the number of nodes that have scores, with edges or without: their blocks are bounded as well.
    """

    def __init__(self, both: DataFrame, rows: int, nodes: int = 0):
        self.count = blocks_for(rows, nodes)
        dealt = both.select(
            block_of(self.count, F.col("node").cast("bigint")).alias("block"),
            block_of(self.count, F.col("nbr").cast("bigint")).alias("owner"),
            F.col("node").cast("bigint").alias("node"), F.col("nbr").cast("bigint").alias("nbr"),
        )
        self.links = bucketed(dealt.groupBy("block").applyInPandas(_links, LINKS), "block")

    def seats(self, unary: DataFrame, k: int) -> DataFrame:
        """The links of every block that has nodes, with their packed log densities; stored once for all rounds."""
        names = [f"f{i}" for i in range(k)]

        def pack(key: tuple[Any, ...], links: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame(columns=_SEATS)
            rows = rows.sort_values("idx")
            ids, phi = rows["idx"].to_numpy(np.int64), rows[names].to_numpy(float)
            counts, others, places, answers = b"", b"", b"", b""
            if len(links):
                counts, others, nodes, answers = links.iloc[0][["counts", "others", "nodes", "answers"]]
                nodes = np.frombuffer(nodes, np.int64)
                place = np.minimum(np.searchsorted(ids, nodes), len(ids) - 1)
                # A node without scores has no place.
                places = np.where(ids[place] == nodes, place, -1).astype(np.int32).tobytes()
            one = (int(key[0]), counts, others, places, answers, ids.tobytes(), np.ascontiguousarray(phi).tobytes())
            return pd.DataFrame([one], columns=_SEATS)

        flat = unary.select(
            block_of(self.count, F.col("idx").cast("bigint")).alias("block"), F.col("idx").cast("bigint").alias("idx"),
            *[p.alias(n) for p, n in zip(items("phi", k), names)],
        )
        return bucketed(self.links.groupBy("block").cogroup(flat.groupBy("block")).applyInPandas(pack, SEATS), "block", dealt=True)

    def drop(self) -> None:
        drop_bucketed(self.links)

    def start(self, spark: SparkSession) -> DataFrame:
        """The state before the first round: no messages."""
        return spark.createDataFrame([], STATE)

    def round(self, seats: DataFrame, state: DataFrame, potential: np.ndarray, step: int) -> DataFrame:
        """The state after a round; the beliefs of this and earlier rounds of ``state`` come along.

        ``state`` holds, by block, the messages that came in.
        """
        k = len(potential)

        def one(key: tuple[Any, ...], own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return pd.DataFrame(columns=_STATE)
            block, row = int(key[0]), own.iloc[0]
            beliefs = np.frombuffer(row["phi"]).reshape(-1, k).copy()
            came = rows[rows["kind"] == "message"]
            came = dict(zip(came["other"], came["data"]))
            counts, others = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["others"], np.int64)
            ends = np.cumsum(counts)
            place, answers = np.frombuffer(row["places"], np.int32), np.frombuffer(row["answers"], np.int32)
            known = place >= 0
            pieces = []
            for other, lo, hi in zip(others, ends - counts, ends):
                got = np.frombuffer(came[other]).reshape(-1, k) if other in came else np.zeros((hi - lo, k))
                pieces.append((int(other), lo, hi, got))
                for i in range(k):
                    beliefs[:, i] += np.bincount(np.maximum(place[lo:hi], 0), np.where(known[lo:hi], got[:, i], 0.0), len(beliefs))
            beliefs -= np.logaddexp.reduce(beliefs, axis=1)[:, None]
            earlier = rows[rows["kind"] == "belief"]
            out = [tuple(r) for r in earlier[_STATE].itertuples(index=False)]
            out.append((block, block, "belief", step, float(beliefs.sum()), len(beliefs), row["ids"], beliefs.tobytes()))
            for other, lo, hi, got in pieces:
                free = beliefs[place[lo:hi]] - got
                sent = np.empty_like(free)
                for a in range(k):
                    sent[:, a] = np.logaddexp.reduce(free + potential[a], axis=1)
                sent[~known[lo:hi]] = 0.0
                out.append((other, block, "message", step, 0.0, 0, b"", sent[answers[lo:hi] - lo].tobytes()))
            return pd.DataFrame(out, columns=_STATE)

        return seats.groupBy("block").cogroup(state.groupBy("block")).applyInPandas(one, STATE)


def unpack(state: DataFrame, step: int, k: int) -> DataFrame:
    """idx, belief of a round."""

    def rows(batches):
        for batch in batches:
            for ids, data in zip(batch["ids"], batch["data"]):
                values = np.frombuffer(data).reshape(-1, k)
                yield pd.DataFrame({"idx": np.frombuffer(ids, np.int64), "belief": list(values)})

    kept = state.filter((F.col("kind") == "belief") & (F.col("step") == step)).select("ids", "data")
    return kept.mapInPandas(rows, "idx bigint, belief array<double>")


#: Cells of a matrix block on the mean, where the matrix is large, and the blocks a smaller one is dealt into at most.
CELLS, LEAST_CELLS, SPREAD = 1 << 22, 1 << 19, 12
#: Consecutive indices that are dealt together, so that near neighbours mostly share a block.
STRIP = 10

MATRIX = "block int, ids binary, others binary, gives binary, places binary, takes binary, rows binary, slots binary, weights binary"
PIECES = "block int, source int, data binary"
PACKED = "block int, sums array<double>, data binary"

#: Vectors of a block as rows of an array, and what a step makes of them.
Arrays = np.ndarray
Before = Callable[[Arrays], tuple[Arrays, Arrays]]
After = Callable[[Arrays, Arrays], tuple[Arrays, Sequence[float]]]


def _matrix(key: tuple[Any, ...], cells: pa.Table) -> pa.Table:
    """A block: its sorted indices, what it gives to and takes from other blocks, and its cells."""
    node, nbr, owner, weight = (cells.column(c).combine_chunks() for c in ("node", "nbr", "owner", "weight"))
    ids = np.unique(node.to_numpy())
    linked = nbr.is_valid().to_numpy(zero_copy_only=False)
    node, nbr, owner, weight = (c.to_numpy(zero_copy_only=False)[linked] for c in (node, nbr, owner, weight))
    rows = np.searchsorted(ids, node).astype(np.int32)
    nbr, owner = nbr.astype(np.int64), owner.astype(np.int64)
    order = np.lexsort((nbr, owner))
    rows, nbr, owner, weight = rows[order], nbr[order], owner[order], weight[order]
    fresh = np.ones(len(nbr), bool)
    fresh[1:] = (nbr[1:] != nbr[:-1]) | (owner[1:] != owner[:-1])
    slots = (np.cumsum(fresh) - 1).astype(np.int32)
    others, at = _starts(owner)
    takes = np.add.reduceat(fresh, at[:-1]) if len(others) else at[:0]
    # The matrix is symmetric: another block needs the own indices that have a cell there.
    places = [np.unique(rows[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
    gives = np.array([len(p) for p in places], np.int64)
    packed = (
        ids, others, gives, np.concatenate([*places, np.zeros(0, np.int32)]).astype(np.int32),
        takes.astype(np.int64), rows, slots, weight.astype(float),
    )
    names = ["ids", "others", "gives", "places", "takes", "rows", "slots", "weights"]
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), **{n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(names, packed)}})


def _read(table: pa.Table, name: str, kind: type, row: int = 0) -> np.ndarray:
    return np.frombuffer(table.column(name)[row].as_buffer(), kind)


def _vectors(table: pa.Table, n: int, row: int = 0) -> Arrays:
    return _read(table, "data", np.float64, row).reshape(-1, n)


def _packed(block: int, arrays: Arrays, sums: Sequence[float]) -> pa.Table:
    return pa.table({
        "block": pa.array([block], pa.int32()), "sums": pa.array([[float(s) for s in sums]], pa.list_(pa.float64())),
        "data": pa.array([np.ascontiguousarray(arrays, float).tobytes()], pa.binary()),
    })


class MatrixBlocks:
    """A symmetric matrix in blocks of whole rows, and vectors packed alike.

    A product shuffles, for every two blocks, the bare values that one needs of the other, each once
    however many cells it meets; both sides keep them in the order of the indices. ``cells(node, nbr,
    weight)``; a null ``nbr`` names an index without a cell. What a task holds is bounded by a block.
    """

    def __init__(self, cells: DataFrame, rows: int):
        self.count = max(math.ceil(rows / CELLS), min(math.ceil(rows / LEAST_CELLS), SPREAD), 1)
        dealt = cells.select(
            self._home("node").alias("block"), self._home("nbr").alias("owner"),
            F.col("node").cast("bigint").alias("node"), F.col("nbr").cast("bigint").alias("nbr"), F.col("weight").cast("double").alias("weight"),
        )
        made = dealt.repartition(2 * self.count, "block").groupBy("block").applyInArrow(_matrix, MATRIX)
        self.blocks = bucketed(made, "block", dealt=True, buckets=2 * self.count)

    def _home(self, col: str) -> Column:
        return F.when(F.col(col).isNotNull(), block_of(self.count, F.shiftright(F.col(col).cast("bigint"), STRIP)))

    def constant(self, value: float) -> DataFrame:
        """A vector of equal values."""

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    n = len(batch.column(1)[k].as_buffer()) // 8
                    yield from _packed(batch.column(0)[k].as_py(), np.full((1, n), value), []).to_batches()

        return self.blocks.select("block", "ids").mapInArrow(fill, PACKED)

    def gathered(self, values: DataFrame, width: int) -> DataFrame:
        """The vectors of ``values(idx, value)``, arrays of ``width``, and one that is 1 where an index has a value; else 0."""
        flat = values.select(
            self._home("idx").alias("block"), F.col("idx").cast("bigint").alias("idx"),
            *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"v{k}") for k, v in enumerate(items("value", width))],
            F.col("value").isNotNull().cast("double").alias(f"v{width}"),
        )

        def place(key: tuple[Any, ...], own: pa.Table, rows: pa.Table) -> pa.Table:
            ids = _read(own, "ids", np.int64)
            out = np.zeros((width + 1, len(ids)))
            if rows.num_rows:
                at = np.searchsorted(ids, rows.column("idx").to_numpy())
                for k in range(width + 1):
                    out[k, at] = rows.column(f"v{k}").to_numpy()
            return _packed(key[0].as_py(), out, [])

        own = self.blocks.select("block", "ids")
        return own.groupBy("block").cogroup(flat.groupBy("block")).applyInArrow(place, PACKED)

    def product(self, state: DataFrame, before: Before, after: After) -> DataFrame:
        """``before`` makes of a block's vectors those to keep and those to multiply, ``after`` of the kept and the products the next and sums."""

        def give(key: tuple[Any, ...], own: pa.Table, rows: pa.Table) -> pa.Table:
            block, n = key[0].as_py(), len(_read(own, "ids", np.int64))
            kept, sent = before(_vectors(rows, n))
            # How many vectors are sent, for blocks that take none.
            places, ends = _read(own, "places", np.int32), np.cumsum(_read(own, "gives", np.int64))
            out = [(block, -1, np.ascontiguousarray(kept).tobytes()), (block, -2, bytes(len(sent)))]
            for other, lo, hi in zip(_read(own, "others", np.int64), np.append(0, ends), ends):
                out.append((int(other), block, np.ascontiguousarray(sent[:, places[lo:hi]]).tobytes()))
            return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["block", "source", "data"])

        def take(key: tuple[Any, ...], own: pa.Table, rows: pa.Table) -> pa.Table:
            n = len(_read(own, "ids", np.int64))
            came = {s: k for k, s in enumerate(rows.column("source").to_pylist())}
            kept, vectors = _vectors(rows, n, came[-1]), len(_read(rows, "data", np.uint8, came[-2]))
            pieces = [_read(rows, "data", np.float64, came[o]).reshape(-1, t) for o, t in zip(_read(own, "others", np.int64).tolist(), _read(own, "takes", np.int64)) if t]
            at, slots, weights = _read(own, "rows", np.int32), _read(own, "slots", np.int32), _read(own, "weights", np.float64)
            if pieces:
                products = np.array([np.bincount(at, weights * v[slots], n) for v in np.concatenate(pieces, axis=1)])
            else:
                products = np.zeros((vectors, n))
            return _packed(key[0].as_py(), *after(kept, products))

        gives = self.blocks.select("block", "ids", "others", "gives", "places").groupBy("block")
        sent = gives.cogroup(state.groupBy("block")).applyInArrow(give, PIECES)
        takes = self.blocks.select("block", "ids", "others", "takes", "rows", "slots", "weights").groupBy("block")
        return takes.cogroup(sent.groupBy("block")).applyInArrow(take, PACKED)

    def keep(self, state: DataFrame) -> DataFrame:
        """``state`` stored in the layout of the blocks, in which ``product`` leaves it."""
        return bucketed(state, "block", dealt=True, buckets=2 * self.count)

    def rows(self, state: DataFrame, width: int, last: bool = False) -> DataFrame:
        """idx and value, the array of the first or last ``width`` vectors."""

        def unpack(key: tuple[Any, ...], own: pa.Table, rows: pa.Table) -> pa.Table:
            ids = _read(own, "ids", np.int64)
            vectors = _vectors(rows, len(ids))
            flat = np.ascontiguousarray((vectors[-width:] if last else vectors[:width]).T).ravel()
            offsets = np.arange(0, len(flat) + 1, width, dtype=np.int32)
            return pa.table({"idx": pa.array(ids), "value": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

        own = self.blocks.select("block", "ids")
        return own.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(unpack, "idx bigint, value array<double>")


def sums_of(state: DataFrame, n: int) -> list[float]:
    """The sums of a stored step over all blocks."""
    return list(state.agg(*[F.sum(F.col("sums")[k]) for k in range(n)]).first())


def matrix_blocks(cells: DataFrame) -> MatrixBlocks | None:
    """``cells(node, nbr, weight)`` in blocks, see there; none where the matrix is not symmetric or one strip
    of indices has more cells than a block should hold. ``cells`` are read twice.
    """

    def mark(row: str, col: str) -> Column:
        return F.when(F.col("nbr").isNotNull(), F.pmod(F.xxhash64(row, col, "weight"), F.lit(1 << 31)))

    strip = F.shiftright(F.col("node").cast("bigint"), STRIP)
    sizes = cells.groupBy(strip).agg(F.count("nbr").alias("n"), F.sum(mark("node", "nbr")).alias("a"), F.sum(mark("nbr", "node")).alias("b"))
    rows, most, there, back = sizes.agg(F.sum("n"), F.max("n"), F.sum("a"), F.sum("b")).first()
    return MatrixBlocks(cells, rows or 0) if (most or 0) <= CELLS and there == back else None
