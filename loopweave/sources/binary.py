"""Readers of the little-endian binary formats, one part file per task."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _decode(spark: SparkSession, path: str, schema: str, parse: Callable[[bytes], Iterator[tuple]], rows: int = 8192) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                chunk: list[tuple] = []
                for record in parse(content):
                    chunk.append(record)
                    if len(chunk) == rows:
                        yield pd.DataFrame(chunk, columns=names)
                        chunk = []
                if chunk:
                    yield pd.DataFrame(chunk, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """id1, id2, weight of a node list: count, then per node index, degree and neighbours."""

    def parse(data: bytes) -> Iterator[tuple]:
        (nodes,) = struct.unpack_from("<I", data, 0)
        at = 4
        for _ in range(nodes):
            index, degree = struct.unpack_from("<IH", data, at)
            at += 6
            for _ in range(degree):
                neighbour, weight = struct.unpack_from("<If", data, at)
                at += 8
                if weight <= 0:
                    raise ValueError(f"edge {index} - {neighbour} has weight {weight}")
                yield index, neighbour, float(weight)

    return _decode(spark, path, "id1 bigint, id2 bigint, weight double", parse)


def read_node_labels(spark: SparkSession, path: str) -> DataFrame:
    """idx, label: one 32-bit integer per node."""

    def parse(data: bytes) -> Iterator[tuple]:
        yield from enumerate(int(v) for v in np.frombuffer(data, "<i4"))

    return _decode(spark, path, "idx bigint, label bigint", parse)


def read_measures(spark: SparkSession, path: str, states: int) -> DataFrame:
    """idx, post: ``states`` 32-bit floats per node."""

    def parse(data: bytes) -> Iterator[tuple]:
        for i, row in enumerate(np.frombuffer(data, "<f4").reshape(-1, states)):
            yield i, row.astype(float)

    return _decode(spark, path, "idx bigint, post array<double>", parse)


def read_posterior(spark: SparkSession, path: str) -> DataFrame:
    """idx, post: node and state counts, then per node its index and one float per state."""

    def parse(data: bytes) -> Iterator[tuple]:
        nodes, states = struct.unpack_from("<IH", data, 0)
        at, size = 6, 4 + 4 * states
        for _ in range(nodes):
            (index,) = struct.unpack_from("<I", data, at)
            yield index, np.frombuffer(data, "<f4", states, at + 4).astype(float)
            at += size

    return _decode(spark, path, "idx bigint, post array<double>", parse)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """name, vec of the binary embedding form: ``N dim`` line, then name and float32 values."""

    def parse(data: bytes) -> Iterator[tuple]:
        head, _, _ = data.partition(b"\n")
        count, dim = (int(v) for v in head.split())
        at = len(head) + 1
        for _ in range(count):
            stop = data.index(b" ", at)
            name = data[at:stop].strip().decode()
            yield name, np.frombuffer(data, "<f4", dim, stop + 1).astype(float)
            at = stop + 1 + 4 * dim + 1

    return _decode(spark, path, "name string, vec array<double>", parse)


def read_map_header(spark: SparkSession, path: str) -> DataFrame:
    """version, genome, chrom, length of a contact-map file's header; the first, whole-genome
    entry is left out and names get their prefix.
    """

    def parse(data: bytes) -> Iterator[tuple]:
        def text(at: int) -> tuple[str, int]:
            stop = data.index(b"\0", at)
            return data[at:stop].decode("latin-1"), stop + 1

        if data[:3] != b"HIC":
            raise ValueError("not a contact map")
        version, _ = struct.unpack_from("<iq", data, 4)
        genome, at = text(16)
        (attributes,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(2 * attributes):
            _, at = text(at)
        (chroms,) = struct.unpack_from("<i", data, at)
        at += 4
        for k in range(chroms):
            name, at = text(at)
            (length,) = struct.unpack_from("<i", data, at)
            at += 4
            if k:
                yield version, genome, f"chr{name}", length

    return _decode(spark, path, "version bigint, genome string, chrom string, length bigint", parse)
