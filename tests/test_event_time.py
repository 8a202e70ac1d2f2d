"""Streams that come in any order within the watermark give what the batch forms give."""

import random

import pytest
from pyspark.sql import functions as F

from oscilla.operators import condition as c
from oscilla.operators import decimate, spectral, timebase
from oscilla.operators import events as e
from oscilla.sources import recording
from oscilla.streaming import live

T0 = 1_700_000_000_000_000


def run(spark, tmp_path, tables, build, cuts, name):
    """What build(streams) writes if the rows of each table (rows, schema) come in batches that end at these shares."""
    streams = []
    for k, (rows, schema) in enumerate(tables):
        for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 1], strict=True)):
            own = rows[int(a * len(rows)) : int(b * len(rows))]
            spark.createDataFrame(own, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{name}/in{k}/{i}")
        streams.append(live.read_stream(spark, f"file://{tmp_path}/{name}/in{k}/*", schema, maxFilesPerTrigger="1"))
    live.record_stream(build(*streams), f"file://{tmp_path}/{name}/out", f"file://{tmp_path}/{name}/cp").awaitTermination(240)
    return recording.read_recording(spark, f"file://{tmp_path}/{name}/out")


def shuffled(rows, us, at, seed=3):
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[at] + rng.randint(0, us))


def same(a, b):
    columns = b.columns
    return sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.collect()))


def signal(n, gaps=(), seed=1):
    """(stream_key, channel, idx, t_us, value) at 10 ms with dropouts (index, seconds)."""
    rng, t, rows = random.Random(seed), T0, []
    for i in range(n):
        t += 10_000 + sum(int(s * 1e6) for at, s in gaps if at == i)
        rows.append(("s", 0, i, t, rng.gauss(0, 1)))
    return rows


SIGNAL = "stream_key string, channel int, idx long, t_us long, value double"


@pytest.mark.parametrize("cuts", [(0.5,), (0.07, 0.11, 0.4, 0.83)])
def test_spectrogram_of_any_cut_equals_the_batch_form(spark, tmp_path, cuts):
    """Gaps at a window's end, close together, before the first window, and near the end; rows up to a second late."""
    gaps = ((10, 0.5), (200, 1.0), (264, 0.3), (280, 0.4), (700, 20.0), (1390, 0.3))
    rows = signal(1400, gaps)
    got = run(spark, tmp_path, [(shuffled(rows, 900_000, 3), SIGNAL)], lambda s: live.spectrogram_stream(s, 64, 32, 10_000, late="1 second"), cuts, "x").collect()
    settled = spark.createDataFrame([r for r in rows if r[3] <= rows[-1][3] - 1_000_000], SIGNAL).withColumn("seq", F.col("idx"))
    anchors = settled.groupBy("stream_key").agg(F.min("t_us").alias("t0_us"))
    found = timebase.detect_gaps(settled, 10_000)
    want = spectral.stft_through_gaps(c.to_chunks(settled, 100), anchors, found, 64, 32, 10_000, 100).collect()
    key = lambda r: (r.col, r.end_idx, r.t_us, r.power and [round(p, 9) for p in r.power])
    # the window that ends with the last settled sample waits for the next one
    assert sorted(map(key, got), key=lambda x: x[0]) == sorted((key(r) for r in want if r.end_idx != settled.count()), key=lambda x: x[0])
    ends = [r.end_idx for r in sorted(want, key=lambda r: r.col) if r.end_idx]
    assert [x for x in ends if x > 264][:3] == [344, 376, 408] and 192 not in ends and [r.col for r in sorted(want, key=lambda r: r.col)] == list(range(len(want)))


def test_bins_stand_samples_that_come_late(spark, tmp_path):
    rows = [("s", 0, i, float(i)) for i in (0, 1, 2, 4, 5, 3, 6, 7, 9, 8, 11, 10)]
    rows += [("s", 0, i, float("nan")) for i in range(12, 16)]
    got = run(spark, tmp_path, [(rows, "stream_key string, channel int, idx long, value double")], lambda s: live.closed_bins_stream(s, 4), (0.31, 0.6), "b")
    assert same(got.withColumn("channel", F.col("channel").cast("int")), decimate.minmax(spark.createDataFrame(rows, "stream_key string, channel int, idx long, value double"), 4)) and got.count() == 4


def test_gaps_rates_and_grid_with_late_rows(spark, tmp_path):
    rows = [(k, i, T0 + i * 100_000 + (3_000_000 if i > 120 else 0), float(i % 7)) for k in "ab" for i in range(300)]
    schema = "stream_key string, seq long, t_us long, value double"
    settled = spark.createDataFrame([r for r in rows if r[2] <= max(x[2] for x in rows) - 2_000_000], schema).cache()
    own = shuffled(rows, 1_900_000, 2)
    cuts = (0.2, 0.5, 0.9)
    assert same(run(spark, tmp_path, [(own, schema)], lambda s: live.gaps_stream(s.drop("value"), 100_000, late="2 seconds"), cuts, "g"), timebase.detect_gaps(settled, 100_000))
    chunks = lambda d: d.select("stream_key", F.col("seq").alias("chunk_id"), "t_us", F.lit(5).alias("n"))
    rounded = lambda d: d.select("stream_key", "chunk_id", F.round("rate", 6).alias("rate"))
    assert same(rounded(run(spark, tmp_path, [(own, schema)], lambda s: live.measured_rate_stream(chunks(s), late="2 seconds"), cuts, "r")), rounded(c.measured_rate(chunks(settled))))
    held = lambda d: d.withColumn("channel", F.lit(0))
    whole = timebase.sample_and_hold(held(settled), 70_000)
    newest = whole.join(settled.groupBy("stream_key").agg(F.max("t_us").alias("m")), "stream_key").where("t_us < m").select("stream_key", "channel", "idx", "t_us", "value")
    assert same(run(spark, tmp_path, [(own, schema)], lambda s: live.hold_stream(held(s), 70_000, "2 seconds"), cuts, "h"), newest)


def test_a_row_out_of_order_without_a_watermark_is_an_error(spark, tmp_path):
    rows = [("s", i, T0 + i * 1000) for i in (5, 6, 1)]
    with pytest.raises(Exception, match="give late="):
        run(spark, tmp_path, [(rows, "stream_key string, seq long, t_us long")], lambda s: live.gaps_stream(s, 1000), (0.7,), "o")


def test_a_pause_of_400_days_is_a_few_rows(spark, tmp_path):
    rows = [("s", 0, 0, T0, 1.0), ("s", 0, 1, T0 + 400 * 86_400_000_000, 2.0), ("s", 0, 2, T0 + 401 * 86_400_000_000, 3.0)]
    runs = run(spark, tmp_path, [(rows, "stream_key string, channel int, seq long, t_us long, value double")], lambda s: live.hold_runs_stream(s, 10_000, "1 second"), (0.4,), "p")
    r = runs.agg(F.sum(F.col("last") - F.col("first") + 1).alias("points"), F.max("last").alias("last"), F.count("*").alias("n")).first()
    assert r.points == 400 * 86_400 * 100 and r.last == r.points - 1 and r.n == -(-r.points // (1 << 16))


def test_epochs_wait_for_windows_longer_than_the_watermark(spark, tmp_path):
    """Windows of six seconds behind a watermark of half a second; some samples missing, an event before the start and one that is not over."""
    rows = [r for r in signal(2000, ((900, 4.0),)) if r[2] % 1000 != 650]
    rows += [("s", 1, i, t, -v) for _, _, i, t, v in rows if i < 1900]
    at = {r[2]: r[3] for r in rows}
    marks = [("s", k, i, at[i]) for k, i in enumerate((5, 99, 100, 300, 420, 700, 905, 1000, 1500, 1700, 1990))]
    schema = "stream_key string, seq long, idx long, t_us long"
    got = run(spark, tmp_path, [(shuffled(rows, 400_000, 3), SIGNAL), (shuffled(marks, 400_000, 3), schema)], lambda s, m: live.epochs_stream(s, m, 100, 500, "500 milliseconds"), (0.1, 0.3, 0.35, 0.8), "e")
    last = max(r[3] for r in rows) - 500_000
    settled = spark.createDataFrame([r for r in rows if r[3] <= last], SIGNAL)
    long = settled.join(spark.createDataFrame(marks, schema).select("stream_key", F.col("seq").alias("event"), F.col("idx").alias("place")), "stream_key").where("place >= 100 and idx >= place - 100 and idx < place + 500")
    want = long.groupBy("stream_key", "channel", "event").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("v")).where("size(v) = 600").select("channel", "event", F.transform("v", lambda x: x["value"]).alias("values"))
    assert same(got, want) and sorted((r.channel, r.event) for r in want.collect()) == [(k, x) for k in (0, 1) for x in (2, 6, 7)]
    mean = e.erp(e.baseline(got, 100)).where("bin < 100 and channel = 0").agg(F.sum("mean")).first()[0]
    assert abs(mean) < 1e-9


def test_real_time_through_gaps_that_come_as_a_stream(spark, tmp_path):
    rows = [("s", i, T0 + i * 1_000_000) for i in range(600)]
    gaps = [("s", k, T0 + k * 100_000_000 + 500_000 * (k % 2), 2_000_000 + k) for k in range(1, 6)]
    cum, table, cumulated = 0, [], []
    for k, (s, no, old, gap) in enumerate(gaps):
        cum += gap
        table.append((s, old, gap))
        cumulated.append((s, no, old, gap, cum, old + cum))
    r, g = "stream_key string, seq long, old_us long", "stream_key string, old_us long, gap_us long"
    got = run(spark, tmp_path, [(shuffled(rows, 4_000_000, 2), r), (table, g)], lambda a, b: live.real_time_stream(a, b, "5 seconds"), (0.3, 0.6), "t")
    want = timebase.real_time(spark.createDataFrame(rows, r), spark.createDataFrame(cumulated, "stream_key string, gap_no int, old_us long, gap_us long, cum_us long, resume_real_us long")).where(f"old_us <= {rows[-1][2] - 5_000_000}")
    assert same(got, want.select("stream_key", "old_us", "seq", "real_us"))


def test_ring_of_markers_goes_on_numbering(spark, tmp_path):
    rows = [("ab"[i % 2], T0 + i * 1_000_000, f"m{i}") for i in range(500)]
    got = run(spark, tmp_path, [(shuffled(rows, 5_000_000, 1), "stream_key string, t_us long, label string")], lambda s: live.markers_stream(s, 40, "6 seconds"), (0.2, 0.5, 0.7), "m")
    settled = {k: [r for r in rows if r[0] == k and r[1] <= rows[-1][1] - 6_000_000] for k in "ab"}
    want = {(k, n, t, label) for k, own in settled.items() for n, (_, t, label) in enumerate(own, 1)}
    assert {(r.stream_key, r.seq, r.t_us, r.label) for r in got.collect()} == want
    ring = {tuple(r) for r in live.retained(spark, f"file://{tmp_path}/m/cp").select("stream_key", "seq", "t_us", "label").collect()}
    assert ring == {x for x in want if x[1] > len(settled[x[0]]) - 40} and len(ring) == 80


def test_presence_tells_streams_that_are_there(spark, tmp_path):
    at = lambda s: T0 + int(s * 1e6)
    rows = [("a", "A", "EEG", "x", at(s / 5)) for s in range(60)] + [("b", "B", None, "x", at(0.1)), ("b", "B2", "EEG", "x", at(1.5)), ("c", "C", "Control", "x", at(1)), ("d", "D", "EEG", "__x", at(2)), ("e", "E", "EEG", None, at(0))]
    rows.sort(key=lambda r: r[4])
    got = run(spark, tmp_path, [(rows, "stream_key string, name string, type string, source_id string, t_us long")], lambda s: live.presence_stream(s, "1 second"), (0.3, 0.6), "a")
    told = sorted((r.stream_key, (r.t_us - T0) / 1e6, r.name, r.state) for r in got.collect())
    assert told == sorted([("a", 0.0, "A", "there"), ("b", 0.1, "B", "there"), ("b", 0.6, "B", "late"), ("b", 1.1, "B", "stale"), ("b", 1.5, "B2", "there"), ("b", 2.0, "B2", "late"), ("b", 2.5, "B2", "stale"), ("b", 6.5, "B2", "gone"), ("e", 0.0, "E", "there"), ("e", 0.5, "E", "late"), ("e", 1.0, "E", "stale"), ("e", 5.0, "E", "gone")])


def test_streams_share_calls_and_states_by_group(spark, tmp_path):
    """More streams than groups, in two batches: each is told by itself, but a call and a state are a group's."""
    from oscilla.streaming.ordered import GROUPS

    rows = [(f"s{k}", i, T0 + i * 100_000 + (k + 1) * 1_000_000 * (i >= 3)) for i in range(5) for k in range(GROUPS + 300)]
    schema = "stream_key string, seq long, t_us long"
    got = run(spark, tmp_path, [(rows, schema)], lambda s: live.gaps_stream(s, 100_000), (0.5,), "many")
    assert same(got, timebase.detect_gaps(spark.createDataFrame(rows, schema), 100_000)) and got.count() == GROUPS + 300
    states = spark.read.format("statestore").load(f"file://{tmp_path}/many/cp")
    assert states.count() <= GROUPS
