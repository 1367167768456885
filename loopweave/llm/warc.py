"""Web archives with a two-level capture index.

Every page becomes one WARC/1.0 record. Of records with equal payloads the one with the smallest
page_id is a response, the others are revisits that name it and carry no payload. Archives are plain
text to Spark (records end in two line ends, the format's own separator), so any file system that
Spark writes can hold them; files are bounded in size and read back as bytes.

The index has a line per record: the URL key with its host labels reversed, page, file, offset and
length. Lines are sorted by key across range partitions and cut into compressed blocks; a sparse
directory keeps every block's first and last key. A look-up bisects the directory, opens the blocks
that can hold the key, bisects their lines and reads the records' byte ranges. ``captures`` reads
every indexed record the same way: the lines of the blocks are dealt by file and offset, and each
task opens the files its lines name and reads their byte ranges, nothing else.

Workers open files through Arrow's file systems (``file``, and those that Arrow can reach). Where a
worker cannot open the first indexed file that way, whole files come through Spark's reader instead.

Defined cases: a null html is an empty payload; a null url has an empty key and no target line; line
ends in URLs are percent-coded. A null page_id is written empty and counts as larger than any other.
Rows that share the smallest page_id and the payload are all responses. An empty table makes no record.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.llm.common import Bloom, slices, stored
from loopweave.session import scratch_path

END = "\r\n"
RECORD_END = END * 2
FILE_BYTES = 8 << 20
HEADER_BYTES = 500
BLOCK_LINES = 1000
#: A directory of up to so many blocks (a line per block, of 1,000 records each) is held by the driver; a larger one stays a table.
DIRECTORY_BLOCKS = 100_000
CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query``: reversed host labels, then the rest; lower-case host."""
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    key = F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), rest)
    return F.coalesce(F.when(F.contains(url, F.lit("://")), key).otherwise(url), F.lit(""))


def records(pages: DataFrame) -> DataFrame:
    """value: the text of one record per row of ``pages(page_id, url, html)``.

    Payloads that occur once are met by a Bloom filter of the repeated digests, bounded in size, and
    become records where they lie; only pages that may be repeated are joined with the first of their kind.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digested = pages.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    first = digested.select("page_id", "sha1").groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    again = stored(first.filter("copies > 1").select("sha1", "first"), "warc-repeated")
    heads = again.select(F.conv(F.substring("sha1", 1, 14), 16, 10).cast("long").alias("h"))
    marks = pages.sparkSession.sparkContext.broadcast(Bloom.gather(heads, "h", Bloom.size_for(again.count())))

    def split(repeated: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "html"):
                heads = np.array([int(x[:14], 16) for x in part.column(3).to_pylist()], dtype=np.uint64)
                mine = part.filter(pa.array(marks.value.holds(heads) == repeated))
                if repeated:
                    yield mine
                else:
                    rows = zip(*(mine.column(k).to_pylist() for k in range(3)))
                    yield pa.RecordBatch.from_arrays([pa.array([record(*row, None) for row in rows], pa.string())], names=["value"])

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            out = [record(*row) for row in zip(*(c.to_pylist() for c in part.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    single = digested.mapInArrow(split(False), "value string")
    marked = digested.mapInArrow(split(True), digested.schema).join(again, "sha1", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    marked = marked.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("first"))
    return single.union(marked.mapInArrow(run, "value string"))


def record(page: int | None, url: str | None, html: str, first: int | None) -> str:
    payload = html.encode("utf-8", "surrogatepass")
    answer = "HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END + f"Content-Length: {len(payload)}" + END * 2
    body = answer if first is not None else answer + html
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if first is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{first}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(body.encode('utf-8', 'surrogatepass'))}")
    return END.join(lines) + RECORD_END + body


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Archive files of about ``file_bytes``, by the mean size of a record, below ``folder``."""
    size = F.avg(F.coalesce(F.octet_length("html"), F.lit(0)) + HEADER_BYTES)
    mean = pages.agg(size).first()[0] or HEADER_BYTES
    writer = records(pages).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", max(1, int(file_bytes / mean)))
    writer.text(folder)


@dataclass
class Parsed:
    offset: int
    length: int
    fields: dict[str, str]
    answer: dict[str, str]
    payload: bytes


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in block.decode("utf-8", "surrogatepass").split(END)[1:])
    return {k: v for k, _, v in pairs}


def parse(data: bytes, offset: int = 0) -> Parsed:
    """The record that starts at ``offset``."""
    head_end = data.index(b"\r\n\r\n", offset)
    fields = _fields(data[offset:head_end])
    start = head_end + 4
    stop = start + int(fields["Content-Length"])
    answer_end = data.index(b"\r\n\r\n", start)
    return Parsed(offset, stop - offset, fields, _fields(data[start:answer_end]), data[answer_end + 4 : stop])


def _page(text: str | None) -> int | None:
    number = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "content")


def one_by_one(batches):
    """Rows of Arrow batches that hold whole files, one row at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1)


def open_range_file(path: str) -> pa.NativeFile:
    """A file opened for reads at any offset, from its path as Spark writes it (``file:/a``, ``hdfs://host/a``)."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest if colon else path).lstrip("/"))
    authority, _, inside = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system.open_input_file(base.rstrip("/") + "/" + inside)


def capture_of(found: Parsed) -> tuple[int | None, int, str, str, int | None]:
    """The cells of CAPTURE."""
    kind = found.fields["WARC-Type"]
    if kind == "response":
        size, digest = len(found.payload), sha1_base32(found.payload)
    else:
        size, digest = int(found.answer["Content-Length"]), found.fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return _page(found.fields["WARC-Record-ID"]), size, digest, kind, _page(found.fields.get("WARC-Refers-To"))


def capture_columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return [pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)]


CAPTURE_NAMES = [c.split(" ")[0] for c in CAPTURE.split(", ")]


def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CAPTURE of every (path, at, length): one open file at a time, one record in memory at a time."""
    name, file = None, None
    try:
        for batch in batches:
            done: list[tuple] = []
            for path, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    if file is not None:
                        file.close()
                    name, file = path, open_range_file(path)
                file.seek(at)
                done.append(capture_of(parse(file.read(length))))
            yield pa.RecordBatch.from_arrays(capture_columns(done), names=CAPTURE_NAMES)
    finally:
        if file is not None:
            file.close()


def opens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether this worker can open the files named."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                open_range_file(path).close()
                good = True
            except (OSError, ValueError, NotImplementedError):
                good = False
            yield pa.RecordBatch.from_arrays([pa.array([good])], names=["good"])


def without_breaks(key: str) -> str:
    return re.sub(r"[\t\n]", " ", key)


def _key_of(line: str) -> str:
    return line.partition("\t")[0]


@dataclass
class CaptureIndex:
    """blocks(block, first, last, n, data): compressed sorted lines; directory: their first and last keys."""

    blocks: DataFrame
    folder: str
    most_blocks: int = DIRECTORY_BLOCKS
    _directory: tuple[list[str], list[str], list[int]] | None = field(default=None, repr=False)

    @classmethod
    def build(cls, spark: SparkSession, folder: str, block_lines: int = BLOCK_LINES) -> "CaptureIndex":
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in one_by_one(batches):
                path, data = row.column(0)[0].as_py(), row.column(1)[0].as_py()
                at, lines = 0, []
                while at < len(data):
                    found = parse(data, at)
                    lines.append((found.fields.get("WARC-Target-URI"), path, at, found.length))
                    at += found.length + len(RECORD_END)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in lines], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))],
                    names=["url", "path", "at", "length"],
                )

        lines = archive_files(spark, folder).mapInArrow(scan, "url string, path string, at long, length long")
        lines = stored(lines.select(url_key(F.col("url")).alias("key"), "path", "at", "length"), "warc-lines")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_lines: list[tuple[str, str, int, int]] = []
            number = TaskContext.get().partitionId() << 33

            def block() -> pa.RecordBatch:
                nonlocal number
                number += 1
                text = "\n".join("\t".join((k, p, str(a), str(n))) for k, p, a, n in open_lines)
                cells = [number, open_lines[0][0], open_lines[-1][0], len(open_lines), zlib.compress(text.encode("utf-8", "surrogatepass"))]
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], names=["block", "first", "last", "n", "data"])

            for batch in batches:
                for line in zip(*(c.to_pylist() for c in batch.columns)):
                    open_lines.append(line)
                    if len(open_lines) == block_lines:
                        yield block()
                        open_lines = []
            if open_lines:
                yield block()

        safe = lines.withColumn("key", F.regexp_replace("key", r"[\t\n]", " "))
        ordered = safe.repartitionByRange("key", "path", "at").sortWithinPartitions("key", "path", "at")
        return cls(stored(ordered.mapInArrow(pack, "block long, first string, last string, n long, data binary"), "warc-index"), folder)

    def directory(self) -> DataFrame:
        """block, first, last: the sparse block directory in key order."""
        return self.blocks.select("block", "first", "last").orderBy("first", "last", "block")

    def blocks_of(self, key: str) -> list[int] | None:
        """The blocks that can hold ``key``, by bisection of the directory; None when it has too many lines to be held."""
        if self._directory is None:
            lines = self.directory().limit(self.most_blocks + 1).toArrow()
            if lines.num_rows > self.most_blocks:
                return None
            self._directory = tuple(lines[c].to_pylist() for c in ("first", "last", "block"))
        firsts, lasts, numbers = self._directory
        return numbers[bisect.bisect_left(lasts, key) : bisect.bisect_right(firsts, key)]

    def entries(self) -> DataFrame:
        """key, path, at, length of every line."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in one_by_one(batches):
                lines = [x.split("\t") for x in zlib.decompress(row.column(0)[0].as_py()).decode("utf-8", "surrogatepass").split("\n")]
                keys, paths, ats, sizes = zip(*lines)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(paths), pa.array(map(int, ats), pa.int64()), pa.array(map(int, sizes), pa.int64())],
                    names=["key", "path", "at", "length"],
                )

        return self.blocks.select("data").mapInArrow(run, "key string, path string, at long, length long")

    def lookup(self, key: str) -> list[tuple[str, int, int]]:
        """(path, at, length) of the captures of one key: only blocks that can hold it are opened, their lines bisected."""
        key = without_breaks(key)
        numbers = self.blocks_of(key)
        if numbers is not None and not numbers:
            return []
        near = (F.col("first") <= key) & (F.col("last") >= key) if numbers is None else F.col("block").isin(numbers)
        found = []
        for row in self.blocks.filter(near).select("data").toLocalIterator():
            lines = zlib.decompress(row["data"]).decode("utf-8", "surrogatepass").split("\n")
            for at in range(bisect.bisect_left(lines, key, key=_key_of), bisect.bisect_right(lines, key, key=_key_of)):
                _, path, start, size = lines[at].split("\t")
                found.append((path, int(start), int(size)))
        return sorted(found)

    def fetch(self, key: str) -> list[Parsed]:
        """The records of one key, read by their byte ranges through Hadoop's file system."""
        spark = self.blocks.sparkSession
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        out = []
        for path, at, length in self.lookup(key):
            where = jvm.org.apache.hadoop.fs.Path(path)
            stream = where.getFileSystem(conf).open(where)
            try:
                stream.seek(at)
                out.append(parse(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))))
            finally:
                stream.close()
        return out

    def captures(self) -> DataFrame:
        """One row per indexed record, read by its byte range. Lines, not payloads, are dealt by file and offset."""
        ranges = self.entries().select("path", "at", "length")
        if not all(r["good"] for r in ranges.select("path").limit(1).mapInArrow(opens, "good boolean").collect()):
            return self.captures_of_whole_files()
        dealt = ranges.repartitionByRange("path", "at").sortWithinPartitions("path", "at")
        return dealt.mapInArrow(read_ranges, CAPTURE)

    def captures_of_whole_files(self) -> DataFrame:
        """The same rows where workers cannot read ranges: files come whole from Spark's reader, the index picks the records."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in one_by_one(batches):
                path, data, found, at = row.column(0)[0].as_py(), row.column(1)[0].as_py(), [], 0
                while at < len(data):
                    record_at = parse(data, at)
                    found.append((path, at, record_at.length, *capture_of(record_at)))
                    at += record_at.length + len(RECORD_END)
                place = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*place, *capture_columns([x[3:] for x in found])], names=["path", "at", "length", *CAPTURE_NAMES])

        read = archive_files(self.blocks.sparkSession, self.folder).mapInArrow(run, f"path string, at long, length long, {CAPTURE}")
        ranges = self.entries().select("path", "at", "length")
        return read.join(ranges, ["path", "at", "length"]).drop("path", "at", "length")


def archive(pages: DataFrame) -> CaptureIndex:
    """Archives of ``pages(page_id, url, html)`` below the shared folder, and their index."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder)
    return CaptureIndex.build(spark, folder)
