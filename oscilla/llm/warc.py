"""WARC archives: transactions of request, response or revisit, and metadata records, written by tasks and assembled again."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, written

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "record_id string, type string, uri string, date string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, fields string, payload binary"
_NAMES = [f.split()[0] for f in RECORDS.split(", ")]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **headers, "Content-Length": str(len(block))}.items())
    data = VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    # a member of a few hundred bytes gains nothing from a deeper search
    z = zlib.compressobj(6 if len(data) > 2048 else 1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record_id(kind: str, page_id, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{kind}|{page_id}|{digest}|{copy}'.encode()).digest())}>"


def clean_uri(url: str | None) -> str:
    """A header line's worth of the URL: control characters and spaces are percent-encoded; null gives urn:none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"


def capture(page_id, url, payload: bytes, digest: str, copy: int, response_id, revisit: bool, date: str) -> list[bytes]:
    """The three records of one page. The response is that of the same payload with page_id response_id."""
    own, uri = record_id("capture", page_id, digest, copy), clean_uri(url)
    host, _, path = re.sub(r"^\w+://", "", uri).partition("/")
    common = {"WARC-Date": date, "WARC-Target-URI": uri}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Record-ID": own, **common, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    if revisit:
        first = record("revisit", headers | {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id("capture", response_id, digest, 1)}, http)
    else:
        first = record("response", headers, http + payload)
    beside = lambda kind, content: {"WARC-Record-ID": record_id(kind, page_id, digest, copy), **common, "WARC-Concurrent-To": own, "Content-Type": content}
    fields = "" if page_id is None else f"page-id: {page_id}\r\n"
    return [
        record("request", beside("request", "application/http;msgtype=request"), f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()),
        first,
        record("metadata", beside("metadata", "application/warc-fields"), fields.encode()),
    ]


def _squeeze(batches):
    """Payloads go through the shuffle compressed."""
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield b.set_column(2, b.schema.names[2], pa.array([z.compress(x) for x in b.column(2).to_pylist()], pa.binary()))


def _write(folder: str, roll_bytes: int, date: str):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        unpack = zstandard.ZstdDecompressor().decompress
        # names are an attempt's own: what a lost or repeated attempt leaves is never listed
        stem, number, out, size, files = f"{root}/{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", 0, None, 0, []
        for b in batches:
            for page_id, url, html, digest, copy, response_id, revisit in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if out is None:
                    name = f"{stem}-{number:04d}.warc.gz"
                    out, size, number = fs.open_output_stream(name), 0, number + 1
                    size += out.write(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                payload = unpack(html)
                for data in capture(page_id, url, payload, base64.b32encode(digest).decode(), copy, response_id, revisit, date):
                    size += out.write(data)
                if size >= roll_bytes:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64())], names=["file", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, roll_bytes: int = 64 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write page_id, url, html as archives; gives the table of the files (file, bytes) that hold all records.

    Of payloads that are equal and at least min_revisit_bytes long that of the largest page_id is a response, the
    others revisit it. Null html is empty. Rows that repeat with the same page_id and payload are captures of
    their own, and all but the first revisit the first. Null page_ids count as the smallest. An empty table gives no files;
    other columns are ignored.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    # one key for page and payload, so that the join and the numbering of copies share one exchange
    p = p.withColumn("k", F.unhex(F.md5(F.concat_ws("|", F.hex("digest"), F.col("page_id").cast("string")))))
    large = p.where(F.length("html") >= min_revisit_bytes).select("k", "page_id", "digest")
    firsts = large.groupBy("digest").agg(F.max("page_id").alias("response_id"))
    decided = large.distinct().join(firsts, "digest").select("k", "response_id", F.lit(True).alias("shared"))
    squeezed = p.select("page_id", "url", "html", "digest", "k").mapInArrow(_squeeze, "page_id long, url string, html binary, digest binary, k binary")
    copy = F.row_number().over(Window.partitionBy("k").orderBy("url"))
    rows = squeezed.join(decided, "k", "left").withColumn("copy", copy)
    rows = rows.withColumn("revisit", F.coalesce("shared", F.lit(False)) & (~F.col("page_id").eqNullSafe(F.col("response_id")) | (F.col("copy") > 1)))
    return written(rows.select("page_id", "url", "html", "digest", "copy", "response_id", "revisit").mapInArrow(_write(folder, roll_bytes, date), "file string, bytes long"), "archives")


def parse_records(stream, with_payload: bool):
    """The records of a decompressed archive, one after the other."""
    while line := stream.readline():
        if not line.strip():
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline().strip()):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        block = stream.read(int(headers.get("content-length", 0)))
        kind, n, payload, fields = headers.get("warc-type"), None, None, None
        digest = (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        if kind in ("response", "revisit"):
            head, _, payload = block.partition(b"\r\n\r\n")
            said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
            n = len(payload) if kind == "response" else int(said[1]) if said else None
            if kind == "response":
                digest = base32_sha1(payload)
        elif kind in ("metadata", "request"):
            fields = block.decode("utf-8", "replace")
        yield (headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), digest, n, fields, payload if with_payload and kind == "response" else None)


def _read(folder: str, with_payload: bool, batch_bytes: int = 32 << 20):
    kinds = (*[pa.string()] * 7, pa.int64(), pa.string(), pa.binary())

    def rows(files):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for name in files:
            with fs.open_input_stream(name) as raw, gzip.GzipFile(fileobj=raw) as unzipped:
                yield from parse_records(io.BufferedReader(unzipped, 1 << 20), with_payload)

    def run(batches):
        held, size = [], 0
        for r in rows(f for b in batches for f in b.column(0).to_pylist()):
            held.append(r)
            size += 500 + len(r[-1] or b"")
            if size >= batch_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=_NAMES)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=_NAMES)

    return run


def read_records(files: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the listed archives; files are dealt out one by one and streamed. Digests of responses are worked out anew."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(parts, "file").mapInArrow(_read(folder, with_payload), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: own (its id), capture (response or revisit), requests and metadata (lists: what is concurrent to it).

    Requests and metadata carry the capture's id as their concurrent-to id, so one grouping brings a transaction
    together. A capture without requests or metadata has empty lists; records whose capture is missing are left out;
    of captures with one id the least record counts.
    """
    beside = F.col("type").isin("request", "metadata")
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("record_id", "uri", "date", "fields"))))
    held = records.where("type in ('request', 'metadata', 'response', 'revisit')").withColumn("own", F.when(beside, F.col("concurrent_to")).otherwise(F.col("record_id")))
    capture = F.min(F.when(~beside, F.struct(*_NAMES))).alias("capture")
    return held.groupBy("own").agg(capture, listed("request").alias("requests"), listed("metadata").alias("metadata")).where("capture is not null")


def archive_report(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) and n_requests, read back from the archives.

    An empty table gives no rows; a very long payload is written and digested whole. Null ids, null texts, repeats and other columns: see write_archives.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    folder = folder if "://" in folder else "file://" + folder
    records = read_records(write_archives(pages, folder), folder, with_payload=False)
    # the report needs neither addresses nor dates, nor what requests say, and of ids only that they are equal: 16 bytes of each go through the shuffle
    nothing, short = F.lit(None).cast("string"), lambda c: F.unhex(F.md5(c))
    lean = records.select(
        F.when(F.col("type") != "request", short("record_id")).alias("record_id"), "type", nothing.alias("uri"), nothing.alias("date"), short("concurrent_to").alias("concurrent_to"),
        short("refers_to").alias("refers_to"), "payload_digest", "payload_bytes", F.when(F.col("type") == "metadata", F.col("fields")).alias("fields"), F.lit(None).cast("binary").alias("payload"),
    )
    page = F.regexp_extract(F.get("metadata", F.lit(0))["fields"], r"(?m)^page-id: (-?\d+)", 1)
    captures = assemble(lean).select("own", F.when(page != "", page).cast("long").alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("to"), F.size("requests").cast("long").alias("n_requests"))
    captures = written(captures, "captures")
    target = captures.select(F.col("own").alias("to"), F.col("page_id").alias("refers_to"))
    joined = captures.where("record_type = 'revisit'").join(target, "to", "left")
    both = joined.unionByName(captures.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")))
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_requests")
