import base64
import gzip
import hashlib

import pyarrow.fs as pafs

from oscilla.llm import warc
from oscilla.llm.common import fresh_path


def slow(rows):
    """page_id, bytes, digest, type, refers_to by one pass over payloads; rows in order, page_ids not null."""
    best = {}
    for page, _, html in rows:
        best[html or ""] = max(page, best.get(html or "", page))
    seen, out = set(), []
    for page, _, html in rows:
        data = (html or "").encode()
        first = page == best[html or ""] and (page, html or "") not in seen
        seen.add((page, html or ""))
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else best[html or ""]))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_whole_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    assert got(warc.archive_report(pages)) == slow([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_edges(spark):
    rows = [(1, "http://a/x y\r\nEvil: 1", "same"), (2, None, "same"), (3, "", None), (4, "u", ""), (5, "v", "é\r\n\r\nWARC/1.1\r\n"), (5, "v", "é\r\n\r\nWARC/1.1\r\n"), (6, "w", "long " * 200000)]
    rows += [(i, "h", "hot copy") for i in range(100, 400)]
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "page_id long, url string, html string, digest string, copy int").repartition(4)
    report = warc.archive_report(df)
    assert got(report) == slow(rows) and all(r.n_requests == 1 for r in report.collect())
    assert warc.archive_report(df.where("false")).count() == 0
    nulls = spark.createDataFrame([(None, "u", "a"), (7, "u", "a"), (None, None, "b")], "page_id long, url string, html string")
    assert {(x[0], *x[3:]) for x in got(warc.archive_report(nulls))} == {(None, "revisit", 7), (7, "response", None), (None, "response", None)}


def test_small_payloads_stay_responses(spark):
    folder = fresh_path(spark, "warc-test")
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    files = warc.write_archives(df, folder, min_revisit_bytes=3, roll_bytes=1)
    kinds = warc.read_records(files, folder).where("type in ('response', 'revisit')").groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in kinds} == {"response": 3, "revisit": 1}
    payloads = sorted(bytes(r.capture.payload) for r in warc.assemble(warc.read_records(files, folder)).where("capture.type = 'response'").collect())
    assert payloads == [b"ab", b"ab", b"abcd"]
    fs, _ = pafs.FileSystem.from_uri(folder)
    name = files.first().file
    with fs.open_input_stream(name) as f:
        text = gzip.decompress(f.read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.count(b"WARC-Concurrent-To: <urn:uuid:") == 2
