"""Queries that write the price signals of suppliers as containers, a few chunks of a few suppliers a file, and read them back."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from oscilla.operators import reconcile
from oscilla.session import table
from oscilla.sources import containers, recording
from oscilla.sources.views import DENSE, dense

QUERIES, ORACLE = {}, {}
#: Samples of a chunk, chunks of a stream in a file and bytes of a range.
CHUNK, CHUNKS_A_FILE, SPLIT = 16, 8, 1024
#: Streams of a file.
STREAMS_A_FILE = 16


def _chunk(tag: int, body: bytes, stream: int | None = None) -> bytes:
    own = struct.pack("<H", tag) + (b"" if stream is None else struct.pack("<I", stream)) + body
    return b"\x04" + struct.pack("<I", len(own)) + own


def _header(stream: int, name: str, unit: str) -> bytes:
    channels = "".join(f"<channel><label>{label}</label><unit>{u}</unit><location><X>{x}</X></location></channel>" for label, u, x in (("price", unit, stream), ("double", "", "")))
    return f"<info><name>{name}</name><type>Price</type><source_id>s{stream}</source_id><channel_count>2</channel_count><channel_format>double64</channel_format><nominal_srate>2</nominal_srate><desc><channels>{channels}</channels></desc></info>".encode()


def _write(folder: str):
    """A file of each group: of each stream header, clock offset, chunks of two channels with boundaries between them, and footer."""

    def stream(supplier: int, part: int, name: str, unit: str, idx: list[int], values: list[float]) -> list[bytes]:
        out = [_chunk(containers.HEADER, _header(supplier, name, unit), supplier), _chunk(containers.OFFSET, struct.pack("<dd", part, 0.25), supplier)]
        # every third sample leaves its stamp to the rate
        samples = [struct.pack("<Bdd", 0, v, 2 * v) if i % 3 == 1 else struct.pack("<Bddd", 8, i * 0.5, v, 2 * v) for i, v in zip(idx, values, strict=True)]
        for at in range(0, len(samples), CHUNK):
            own = samples[at : at + CHUNK]
            out += [_chunk(containers.SAMPLES, b"\x01" + bytes([len(own)]) + b"".join(own), supplier), _chunk(containers.BOUNDARY, containers.MARK)]
        footer = f"<info><first_timestamp>{idx[0] * 0.5}</first_timestamp><last_timestamp>{idx[-1] * 0.5}</last_timestamp><sample_count>{len(idx)}</sample_count></info>"
        return [*out, _chunk(containers.FOOTER, footer.encode(), supplier)]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        pack, part = key
        out = [containers.MAGIC, _chunk(1, b"<info/>")]
        rows = rows.sort_values(["supplier", "idx"])
        suppliers = rows["supplier"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(suppliers)) + 1).tolist(), len(rows)]
        columns = [rows[c].tolist() for c in ("name", "unit", "idx", "value")]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            name, unit, idx, values = (c[a:b] for c in columns)
            out += stream(int(suppliers[a]), part, name[0], unit[0], idx, values)
        fs, path = containers.filesystem(folder)
        fs.create_dir(path)
        with fs.open_output_stream(f"{path}/{pack}-{part}.xdf") as f:
            f.write(b"".join(out))
        return pd.DataFrame({"n": [len(rows)]})

    return run


def _recorded(spark, d, label="recording", unit="'euros'") -> str:
    """The folder of the containers of every supplier's prices."""
    folder = recording.fresh_folder(spark, label)
    names = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("stream_key"), F.col("s_name").alias("name"), F.expr(unit).alias("unit"))
    rows = dense(spark, d).join(names, "stream_key").select(F.col("stream_key").cast("long").alias("supplier"), F.expr(f"idx div {CHUNK * CHUNKS_A_FILE}").alias("part"), "name", "unit", "idx", "value")
    written = rows.groupBy(F.expr(f"supplier div {STREAMS_A_FILE}").alias("pack"), "part").applyInPandas(_write(folder), "n long")
    written.agg(F.sum("n")).collect()
    return folder


def s6_ingest(spark, d):
    t = containers.ingest_recordings(spark, f"{_recorded(spark, d)}/*.xdf", SPLIT)
    return t["samples"].join(t["streams"].select("file", "stream_id", "name"), ["file", "stream_id"]).select("name", "t", "channel", "value")


def s6_footers(spark, d):
    t = containers.ingest_recordings(spark, _recorded(spark, d), SPLIT)
    told = t["footers"].join(t["clock_offsets"], ["file", "stream_id"]).join(t["streams"], ["file", "stream_id"])
    return told.select("name", F.col("collected").cast("long").alias("part"), "first_timestamp", "last_timestamp", "sample_count", "nominal_srate")


def s6_channels(spark, d):
    t = containers.ingest_recordings(spark, _recorded(spark, d), SPLIT)
    return t["channels"].select("stream_id", "channel", "label", "unit", "x").distinct()


def s6_structure(spark, d):
    t = containers.ingest_recordings(spark, _recorded(spark, d), SPLIT)
    checks = reconcile.check_structure(reconcile.chunk_inventory(t["chunks"]))
    return checks.groupBy("stream_id").agg(F.count("*").alias("files"), F.count_if("ok").alias("whole"))


def r3_header_diff(spark, d):
    """Two recordings of the same streams, of which the second has another unit where the supplier's number is even."""
    a, b = _recorded(spark, d, "a"), _recorded(spark, d, "b", "case when s_suppkey % 2 = 0 then 'dollars' else 'euros' end")
    fields = lambda folder: containers.header_fields(containers.read_chunks(spark, folder, {containers.HEADER})).select("stream_id", "path", "value").distinct()
    return reconcile.header_diff(fields(a), fields(b), ["stream_id"])


QUERIES |= {"s6_ingest": s6_ingest, "s6_footers": s6_footers, "s6_channels": s6_channels, "s6_structure": s6_structure, "r3_header_diff": r3_header_diff}
NAMED = f"with {DENSE}, named as (select d.*, s_name as name, s_suppkey, idx // {CHUNK * CHUNKS_A_FILE} as part from dense d join supplier s on cast(s_suppkey as varchar) = d.stream_key)"
ORACLE |= {
    "s6_ingest": f"{NAMED} select name, case when idx % 3 <> 1 then idx * 0.5::double end as t, cast(c as int) as channel, value * (c + 1) as value from named, (select unnest([0, 1]) as c)",
    "s6_footers": f"{NAMED} select name, part, min(idx) * 0.5::double as first_timestamp, max(idx) * 0.5::double as last_timestamp, count(*) as sample_count, 2.0::double as nominal_srate from named group by name, part",
    "s6_channels": f"{NAMED} select distinct s_suppkey as stream_id, cast(c as int) as channel, case c when 0 then 'price' else 'double' end as label, case c when 0 then 'euros' end as unit, case c when 0 then cast(s_suppkey as varchar) end as x from named, (select unnest([0, 1]) as c)",
    "s6_structure": f"{NAMED} select s_suppkey as stream_id, count(distinct part) as files, count(distinct part) as whole from named group by s_suppkey",
    "r3_header_diff": f"{NAMED} select distinct s_suppkey as stream_id, 'desc/channels/channel[0]/unit' as path, 'euros' as a, 'dollars' as b from named where s_suppkey % 2 = 0",
}
