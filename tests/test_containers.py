import random
import struct

import numpy as np
import pytest

from oscilla.operators import reconcile, streams
from oscilla.sources import containers


def chunk(tag, body, width=4):
    return bytes([width]) + (len(body) + 2).to_bytes(width, "little") + struct.pack("<H", tag) + body


def samples_body(form, samples):
    body = b"\x01" + bytes([len(samples)])
    for t, vs in samples:
        body += b"\x00" if t is None else b"\x08" + struct.pack("<d", t)
        for v in vs:
            body += b"\x01" + bytes([len(v.encode())]) + v.encode() if form == "string" else np.array([v], containers.FORMATS[form]).tobytes()
    return body


def container(stream_id, form, samples, desc=""):
    """A file with one stream: header, one chunk of (time or None, values) samples, a clock offset and a footer."""
    n = len(samples[0][1])
    xml = f"<info><name>S{stream_id}</name><type>EEG</type><source_id>src</source_id><channel_count>{n}</channel_count><nominal_srate>100</nominal_srate><channel_format>{form}</channel_format>{desc}</info>"
    sid = struct.pack("<I", stream_id)
    foot = f"<info><first_timestamp>1.5</first_timestamp><last_timestamp>9</last_timestamp><sample_count>{len(samples)}</sample_count></info>"
    return b"XDF:" + chunk(1, b"<info/>") + chunk(2, sid + xml.encode()) + chunk(3, sid + samples_body(form, samples)) + chunk(4, sid + struct.pack("<dd", 5.5, 0.25)) + chunk(5, containers.MARK, 1) + chunk(6, sid + foot.encode())


def test_containers_are_read_back(spark, tmp_path):
    channels = "<desc><channels><channel><label>Cz</label><unit>uV</unit><location><X>1</X><Z>3</Z></location></channel><channel/></channels></desc>"
    (tmp_path / "a.xdf").write_bytes(container(7, "int16", [(1.0, [1, -2]), (None, [3, 4])], channels))
    (tmp_path / "b.xdf").write_bytes(container(8, "string", [(2.0, ["left, é"]), (2.5, [""])]))
    (tmp_path / "c.txt").write_bytes(b"not this one")
    t = containers.ingest_recordings(spark, f"file://{tmp_path}/*.xdf")
    got = sorted((r.stream_id, r.n, r.t, r.channel, r.value, r.text) for r in t["samples"].collect())
    assert got == [(7, 0, 1.0, 0, 1.0, None), (7, 0, 1.0, 1, -2.0, None), (7, 1, None, 0, 3.0, None), (7, 1, None, 1, 4.0, None), (8, 0, 2.0, 0, None, "left, é"), (8, 1, 2.5, 0, None, "")]
    assert {(r.stream_id, r.name, r.channel_count, r.nominal_srate) for r in t["streams"].collect()} == {(7, "S7", 2, 100.0), (8, "S8", 1, 100.0)}
    assert {(r.collected, r.offset) for r in t["clock_offsets"].collect()} == {(5.5, 0.25)}
    assert {(r.stream_id, r.first_timestamp, r.last_timestamp, r.sample_count) for r in t["footers"].collect()} == {(7, 1.5, 9.0, 2), (8, 1.5, 9.0, 2)}
    checks = reconcile.check_structure(reconcile.chunk_inventory(t["chunks"])).collect()
    assert len(checks) == 2 and all(r.ok for r in checks)
    named = streams.normalise_channels(t["channels"]).orderBy("channel").collect()
    assert [(r.label, r.unit, r.loc and tuple(r.loc)) for r in named] == [("Cz", "uV", (1.0, 0.0, 3.0))]
    assert containers.read_chunks(spark, f"file://{tmp_path}/*.none").count() == 0


def long_file(n, seed=1):
    rng = random.Random(seed)
    out, bodies = b"XDF:" + chunk(1, b"<info/>"), 0
    for k in range(n):
        out += chunk(3, struct.pack("<I", k % 3) + samples_body("int16", [(1.0, [k % 100])] * rng.randint(1, 200)), rng.choice([4, 8]))
        if rng.random() < 0.3:
            out += chunk(5, containers.MARK, 1)
        bodies += 1
    return out


@pytest.mark.parametrize("split", [37, 100, 1000, 4096, 10**6])
def test_any_cut_gives_each_chunk_once(tmp_path, split):
    """Ranges shorter than a chunk, marks that a cut goes through, and a mark at the end."""
    for seed in range(3):
        data = long_file(60, seed) + chunk(5, containers.MARK, 1)
        (tmp_path / "x.xdf").write_bytes(data)
        def rows(n, data=data):
            reader = containers.ContainerReader({"path": f"file://{tmp_path}/x.xdf", "split": str(n)})
            return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        whole, cut = rows(len(data)), rows(split)
        assert cut == whole and [r["position"] for r in whole] == sorted(r["position"] for r in whole) and len(whole) > 60


def test_truncated_and_damaged_files(spark, tmp_path):
    data = container(3, "float32", [(1.0, [1.5])]) + chunk(3, struct.pack("<I", 3) + samples_body("float32", [(2.0, [2.5])]))
    whole = len(list(containers.range_chunks(containers._Bytes(__import__("pyarrow").BufferReader(data), len(data)), containers.FileRange("x", len(data), 0, len(data)), None)))
    assert whole == 7
    for cut in range(len(data) - 1, len(data) - 30, -5):
        (tmp_path / "t.xdf").write_bytes(data[:cut])
        assert containers.read_chunks(spark, f"file://{tmp_path}/t.xdf").count() == whole - 1
    for bad in (b"", b"XDF", b"RIFF1234", b"XDF:\x07abc"):
        (tmp_path / "t.xdf").write_bytes(bad)
        with pytest.raises(Exception, match="container"):
            containers.read_chunks(spark, f"file://{tmp_path}/t.xdf").collect()


def test_contents_that_are_not_asked_for_are_not_read(spark, tmp_path):
    (tmp_path / "a.xdf").write_bytes(container(7, "int16", [(1.0, [1, -2])]))
    rows = containers.read_chunks(spark, f"file://{tmp_path}", {4}).collect()
    assert [r.tag for r in rows if r.content is not None] == [4] and [r.tag for r in rows] == [1, 2, 3, 4, 5, 6] and all(r.size >= 0 for r in rows)


@pytest.mark.parametrize("form", ["float32", "double64", "int8", "int16", "int32", "int64"])
@pytest.mark.parametrize("stamps", ["all", "none", "some"])
def test_blocks_of_numbers(form, stamps):
    rng = np.random.default_rng(2)
    samples = [(None if stamps == "none" or (stamps == "some" and i % 3) else float(i), rng.integers(-100, 100, 3).tolist()) for i in range(50)]
    t, values = containers.numeric_block(samples_body(form, samples), 3, form)
    assert values.tolist() == [v for _, v in samples] and [None if np.isnan(x) else x for x in t] == [x for x, _ in samples]


def test_header_differences_are_told_by_path(spark, tmp_path):
    desc = lambda *labels: "<desc><channels>" + "".join(f"<channel><label>{x}</label><location><X>1</X></location></channel>" for x in labels) + "</channels></desc>"
    for name, labels in (("a", ("Cz", "Pz")), ("b", ("Cz", "Oz", "Fz"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.xdf").write_bytes(container(7, "int16", [(1.0, [1, 2])], desc(*labels)))
    fields = [containers.header_fields(containers.read_chunks(spark, f"file://{tmp_path}/{n}")) for n in "ab"]
    got = {(r.path, r.a, r.b) for r in reconcile.header_diff(*fields, ["stream_id"]).collect()}
    assert got == {("desc/channels/channel[1]/label", "Pz", "Oz"), ("desc/channels/channel[2]/label", None, "Fz"), ("desc/channels/channel[2]/location/X", None, "1")}
