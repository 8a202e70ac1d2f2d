"""Recording containers: a splittable source of their chunks, and the tables that the chunks hold.

A container is a magic word and then chunks, each with its length. Boundary chunks hold a fixed 16-byte mark, so a reader may begin anywhere: a
file is cut into byte ranges, and a range holds the chunks from the first mark that begins in it up to that of a later range.
So many tasks read one file, a task reads many small ones, no task holds more of it than a few megabytes and one chunk, and a file that ends in the middle of a chunk gives all
whole ones. Chunks whose content is not asked for are passed over without reading it.
"""

from __future__ import annotations

import fnmatch
import re
import struct
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the container: its magic word, the mark of a boundary chunk, tags that carry a stream id, and the sample formats.
MAGIC = b"XDF:"
MARK = uuid.UUID("43a546dc-cbf5-410f-b30e-d5467383cbe4").bytes
WITH_STREAM = {2, 3, 4, 6}
FORMATS = {"float32": "<f4", "double64": "<f8", "int8": "<i1", "int16": "<i2", "int32": "<i4", "int64": "<i8"}
HEADER, SAMPLES, OFFSET, BOUNDARY, FOOTER = 2, 3, 4, 5, 6

CHUNKS = "file string, position long, tag int, stream_id long, size long, content binary"
#: Bytes of a range, of a read, and of the contents of one batch.
SPLIT, READ, BATCH = 128 << 20, 4 << 20, 16 << 20
#: Bytes that a task reads, and how many more a file counts for.
TASK, OPEN = 128 << 20, 4 << 20


def filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def container_files(path: str) -> list[tuple[str, int]]:
    """Address and size of every file that a path, folder or pattern stands for, in order."""
    from pyarrow.fs import FileSelector, FileType

    wild = re.search(r"[*?\[]", path)
    base = path[: path.rindex("/", 0, wild.start())] if wild else path
    fs, root = filesystem(base)
    if not wild and fs.get_file_info(root).type == FileType.File:
        return [(path, fs.get_file_info(root).size)]
    found = [x for x in fs.get_file_info(FileSelector(root, recursive=bool(wild))) if x.type == FileType.File]
    rest = path[len(base) :] if wild else "/*"
    return sorted((base + x.path[len(root) :], x.size) for x in found if fnmatch.fnmatchcase(x.path[len(root) :], rest) and not x.base_name.startswith(("_", ".")))


class _Bytes:
    """A file by pieces that are read ahead."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(max(n, READ), self.size - at), at)
        return self.held[at - self.at : at - self.at + n]

    def find(self, what: bytes, begin: int, end: int) -> int:
        """Where ``what`` first begins within begin..end, or -1."""
        for at in range(begin, end, READ):
            n = min(min(READ, end - at) + len(what) - 1, self.size - at)
            found = self.get(at, n).find(what) if n >= len(what) else -1
            if found >= 0 and at + found < end:
                return at + found
        return -1


class FileRange(InputPartition):
    def __init__(self, file: str, size: int, begin: int, end: int):
        self.file, self.size, self.begin, self.end = file, size, begin, end


class Share(InputPartition):
    """What one task reads: pieces of files, each of one or more ranges."""

    def __init__(self, pieces: list[FileRange]):
        self.pieces = pieces


def shares(files: list[tuple[str, int]], split: int) -> list[Share]:
    """The files dealt to tasks: TASK bytes each (a range at least), a file counting OPEN more, so that the tasks go with the bytes and files and not with the ranges."""
    out, held, room = [], [], TASK
    step = max(TASK // split, 1) * split
    for file, size in files:
        for at in range(0, max(size, 1), step):
            end = min(at + step, size)
            if held and end - at + OPEN > room:
                out.append(Share(held))
                held, room = [], TASK
            held.append(FileRange(file, size, at, end))
            room -= end - at + OPEN
    return [*out, Share(held)]


def range_chunks(read: _Bytes, part: FileRange, tags: set[int] | None) -> Iterator[tuple[int, int, int | None, int, bytes | None]]:
    """(position, tag, stream id, size, content) of the chunks of a range; content is None if its tag is not among ``tags``."""
    if part.begin == 0:
        if read.get(0, min(4, part.size)) != MAGIC:
            raise ValueError(f"not a container: {part.file} does not begin with the magic word")
        at = len(MAGIC)
    else:
        # the tag stands right before the mark
        tagged = struct.pack("<H", BOUNDARY) + MARK
        found = read.find(tagged, max(part.begin - 2, 0), part.end - 2)
        if found < 0:
            return
        at = found + len(tagged)
    while at + 1 < part.size:
        head = read.get(at, min(1 + 8 + 2 + 4, part.size - at))
        width = head[0]
        if width not in (1, 4, 8):
            raise ValueError(f"damaged container: no chunk begins at {at} of {part.file}")
        size, start = int.from_bytes(head[1 : 1 + width], "little"), at + 1 + width
        if start + size > part.size:
            return
        tag = struct.unpack_from("<H", head, 1 + width)[0]
        own = 4 if tag in WITH_STREAM else 0
        stream = struct.unpack_from("<I", head, 3 + width)[0] if own else None
        body, n = start + 2 + own, size - 2 - own
        yield at, tag, stream, n, read.get(body, n) if tags is None or tag in tags else None
        at = start + size
        if tag == BOUNDARY and body >= part.end:
            return


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.tags = {int(t) for t in options["tags"].split(",") if t} if "tags" in options else None

    def partitions(self) -> list[Share]:
        return shares(container_files(self.path), self.split)

    def _chunks(self, share: Share) -> Iterator[tuple]:
        for piece in share.pieces:
            fs, path = filesystem(piece.file)
            with fs.open_input_file(path) as f:
                own = _Bytes(f, piece.size)
                for at in range(piece.begin, max(piece.end, piece.begin + 1), self.split):
                    for row in range_chunks(own, FileRange(piece.file, piece.size, at, min(at + self.split, piece.end)), self.tags):
                        yield piece.file, *row

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._chunks(partition):
            rows.append(row)
            held += len(row[-1] or b"") + 64
            if held >= BATCH:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in CHUNKS.split(", ")])


class ContainerSource(DataSource):
    """Chunks of containers, as CHUNKS. Options: path, tags (those whose content is read; all if not given) and split (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "oscilla_container"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return ContainerReader(dict(self.options))


def read_chunks(spark: SparkSession, path: str, tags: set[int] | None = None, split: int = SPLIT) -> DataFrame:
    """One row per chunk of every container that ``path`` (a file, folder or pattern) stands for; content only of the tags asked for."""
    spark.dataSource.register(ContainerSource)
    reader = spark.read.format(ContainerSource.name()).option("split", str(split))
    if tags is not None:
        reader = reader.option("tags", ",".join(map(str, sorted(tags))))
    return reader.load(path)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def header_fields(chunks: DataFrame) -> DataFrame:
    """(file, stream_id, path, value): every element of the headers' XML that holds text or nothing, by its path; of repeated ones the number, from 0, is in the path."""
    schema = pa.schema([("file", pa.string()), ("stream_id", pa.int64()), ("path", pa.string()), ("value", pa.string())])

    def walk(node, path: str) -> Iterator[tuple[str, str]]:
        names = [c.tag for c in node]
        if not names:
            yield path, (node.text or "").strip()
        seen: dict[str, int] = {}
        for child in node:
            k = seen[child.tag] = seen.get(child.tag, -1) + 1
            yield from walk(child, f"{path}/{child.tag}".lstrip("/") + (f"[{k}]" if names.count(child.tag) > 1 or child.tag == "channel" else ""))

    def run(batches):
        for b in batches:
            rows = [(file, sid, path, value) for file, sid, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for path, value in walk(ET.fromstring(content), "")]
            yield _table(rows, schema)

    return chunks.where(F.col("tag") == HEADER).select("file", "stream_id", "content").mapInArrow(run, "file string, stream_id long, path string, value string")


def stream_headers(chunks: DataFrame) -> DataFrame:
    """(file, stream_id, name, type, source_id, channel_count, channel_format, nominal_srate) from the headers."""
    field = lambda name: F.max(F.when(F.col("path") == name, F.col("value")))
    text = [F.coalesce(field(c), F.lit("")).alias(c) for c in ("name", "type", "source_id")]
    count = F.coalesce(field("channel_count").try_cast("int"), F.lit(0)).alias("channel_count")
    rate = F.coalesce(field("nominal_srate").try_cast("double"), F.lit(0.0)).alias("nominal_srate")
    return header_fields(chunks).groupBy("file", "stream_id").agg(*text, count, field("channel_format").alias("channel_format"), rate)


def stream_channels(chunks: DataFrame) -> DataFrame:
    """(file, stream_id, channel, label, type, unit, x, y, z) of the channels that headers describe; what is empty or not there is null. normalise_channels() takes these."""
    fields = header_fields(chunks).select("file", "stream_id", "value", F.regexp_extract("path", r"^desc/channels/channel\[(\d+)\]/(.+)$", 1).alias("channel"), F.regexp_extract("path", r"^desc/channels/channel\[(\d+)\]/(.+)$", 2).alias("field"))
    names = {"label": "label", "type": "type", "unit": "unit", "x": "location/X", "y": "location/Y", "z": "location/Z"}
    own = [F.nullif(F.max(F.when(F.col("field") == path, F.col("value"))), F.lit("")).alias(c) for c, path in names.items()]
    return fields.where("channel <> ''").groupBy("file", "stream_id", F.col("channel").cast("int").alias("channel")).agg(*own)


def stream_footers(chunks: DataFrame) -> DataFrame:
    """(file, stream_id, first_timestamp, last_timestamp, sample_count) from the footers; null where one does not tell."""
    schema = pa.schema([("file", pa.string()), ("stream_id", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("n", pa.string())])

    def run(batches):
        for b in batches:
            roots = [ET.fromstring(x) for x in b.column(2).to_pylist()]
            found = [[r.findtext(k) for r in roots] for k in ("first_timestamp", "last_timestamp", "sample_count")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.string()) for x in found)], schema=schema)

    told = chunks.where(F.col("tag") == FOOTER).select("file", "stream_id", "content").mapInArrow(run, "file string, stream_id long, first string, last string, n string")
    return told.select("file", "stream_id", F.col("first").try_cast("double").alias("first_timestamp"), F.col("last").try_cast("double").alias("last_timestamp"), F.col("n").try_cast("long").alias("sample_count"))


def stream_offsets(chunks: DataFrame) -> DataFrame:
    """(file, stream_id, collected, offset) in seconds."""

    def run(batches):
        for b in batches:
            pair = np.frombuffer(b"".join(x[:16] for x in b.column(2).to_pylist()), "<f8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["file", "stream_id", "collected", "offset"])

    return chunks.where(F.col("tag") == OFFSET).select("file", "stream_id", "content").mapInArrow(run, "file string, stream_id long, collected double, offset double")


def _sized(content: bytes, at: int) -> tuple[int, int]:
    width = content[at]
    return int.from_bytes(content[at + 1 : at + 1 + width], "little"), at + 1 + width


def numeric_block(content: bytes, channels: int, form: str) -> tuple[np.ndarray, np.ndarray]:
    """Stamps (NaN where the chunk leaves one to the rate) and values (samples x channels) of a chunk of numbers."""
    n, at = _sized(content, 0)
    kind = np.dtype(FORMATS[form])
    width, raw = channels * kind.itemsize, np.frombuffer(content, np.uint8)
    for stamp in (8, 0):
        # all samples with a stamp, or none: one strided view
        row = np.dtype([("has", "u1"), ("t", "<f8", (stamp // 8,)), ("v", kind, (channels,))])
        if len(content) - at == n * row.itemsize:
            rows = np.frombuffer(content, row, n, at)
            if (rows["has"] == stamp).all():
                return (rows["t"][:, 0] if stamp else np.full(n, np.nan)), rows["v"]
    begin, stamps = np.empty(n, np.int64), np.full(n, np.nan)
    for i in range(n):
        if content[at] == 8:
            stamps[i] = struct.unpack_from("<d", content, at + 1)[0]
        begin[i] = at + 1 + content[at]
        at = begin[i] + width
    return stamps, raw[begin[:, None] + np.arange(width)].view(kind).reshape(n, channels)


def text_block(content: bytes, channels: int) -> tuple[np.ndarray, list[str]]:
    """Stamps and texts (by sample, then channel) of a chunk of strings."""
    n, at = _sized(content, 0)
    stamps, texts = np.full(n, np.nan), []
    for i in range(n):
        if content[at] == 8:
            stamps[i] = struct.unpack_from("<d", content, at + 1)[0]
        at += 1 + content[at]
        for _ in range(channels):
            size, at = _sized(content, at)
            texts.append(content[at : at + size].decode("utf-8", "replace"))
            at += size
    return stamps, texts


#: Samples of a batch of values.
ROWS = 1 << 17


def stream_samples(chunks: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, stream_id, position, n, t, channel, value, text): samples in order of position and n; t is null where the chunk leaves it to the rate."""

    def run(batches):
        for b in batches:
            for file, sid, position, content, count, form in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                stamps, own = text_block(content, count) if form == "string" else numeric_block(content, count, form)
                for at in range(0, len(stamps), step := max(1, ROWS // max(count, 1))):
                    t = stamps[at : at + step]
                    k = len(t) * count
                    values = pa.nulls(k, pa.float64()) if form == "string" else pa.array(own[at : at + step].astype(np.float64).ravel())
                    texts = pa.array(own[at * count : (at + step) * count], pa.string()) if form == "string" else pa.nulls(k, pa.string())
                    n = np.arange(at, at + len(t), dtype=np.int32)
                    every = lambda x, kind: pa.array([x], kind).take(pa.array(np.zeros(k, np.int64)))  # noqa: E731, B023
                    stamp = pa.array(np.repeat(t, count), mask=np.repeat(np.isnan(t), count))
                    yield pa.RecordBatch.from_arrays([every(file, pa.string()), every(sid, pa.int64()), every(position, pa.int64()), pa.array(np.repeat(n, count)), stamp, pa.array(np.tile(np.arange(count, dtype=np.int32), len(t))), values, texts], names=["file", "stream_id", "position", "n", "t", "channel", "value", "text"])

    known = headers.where(F.col("channel_format").isin([*FORMATS, "string"])).select("file", "stream_id", "channel_count", "channel_format")
    joined = chunks.where(F.col("tag") == SAMPLES).join(known, ["file", "stream_id"])
    return joined.select("file", "stream_id", "position", "content", "channel_count", "channel_format").mapInArrow(run, "file string, stream_id long, position long, n int, t double, channel int, value double, text string")


def ingest_recordings(spark: SparkSession, path: str, split: int = SPLIT) -> dict[str, DataFrame]:
    """The tables of all containers that match: chunks, streams, channels, samples, clock_offsets, footers. Each table's scan reads only the contents that it needs.

    Streams of another format than those of numbers and strings have a header only. A file that ends in the middle of a chunk
    gives all whole chunks; one without the magic word, or with a chunk of no known length, is an error.
    """
    of = lambda *tags: read_chunks(spark, path, set(tags), split)
    headers = stream_headers(of(HEADER))
    return {"chunks": of(), "streams": headers, "channels": stream_channels(of(HEADER)), "samples": stream_samples(of(SAMPLES), headers), "clock_offsets": stream_offsets(of(OFFSET)), "footers": stream_footers(of(FOOTER))}
