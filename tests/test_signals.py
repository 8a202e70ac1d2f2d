"""Properties of the filters and spectra, and cases worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.operators import condition as c
from oscilla.operators import decimate, markers, spectral, streams, timebase


def tone(spark, n, f, fs, offset=0.0, size=1.0, chunk=1000):
    t = spark.range(n).select(F.lit("s").alias("stream_key"), F.lit(0).alias("channel"), F.col("id").alias("idx"), (offset + size * F.sin(2 * math.pi * f * F.col("id") / fs)).alias("value"))
    return c.to_chunks(t, chunk)


def values(chunks):
    rows = c.to_samples(chunks).orderBy("idx").collect()
    return np.array([r.value for r in rows])


def test_highpass_takes_the_offset_and_keeps_the_tone(spark):
    y = values(c.highpass(tone(spark, 5000, 40, 500, 1000, 10), 0.5, 500))[2500:]
    assert abs(y.mean()) < 1 and 16 < np.ptp(y) < 24
    assert abs(values(c.highpass(tone(spark, 5000, 0, 500, 500), 0.5, 500))[-1]) < 1


@pytest.mark.parametrize(("stage", "f", "low", "high"), [("notch", 60, 0, 0.3), ("notch", 40, 0.8, 1.2), ("low", 5, 0.8, 1.2), ("low", 80, 0, 0.3)])
def test_biquads(spark, stage, f, low, high):
    chunks = tone(spark, 6000, f, 500)
    y = values(c.notch(chunks, 60, 500) if stage == "notch" else c.lowpass(chunks, 30, 500))[3000:]
    assert low <= np.ptp(y) / 2 < high


def test_chunked_filter_equals_one_run(spark):
    o = c.Options(500, 0.5, 60, 40)
    one = c.Chain(o).walk(np.array([values(tone(spark, 3000, 7, 500, 3, 2, 3000))]), np.array([[3.0, 0, 0, 0, 0, 0]]))[0][0]
    assert np.allclose(values(c.condition(tone(spark, 3000, 7, 500, 3, 2, 128), o)), one, atol=1e-9)


def test_segments_restart_the_state(spark):
    o = c.Options(500, 0.5)
    chunks = tone(spark, 400, 3, 500, 9, 1, 100)
    two = c.condition(chunks.withColumn("segment", F.expr("chunk_id div 2")), o)
    alone = c.condition(chunks.where("chunk_id >= 2"), o)
    assert np.allclose(values(two)[200:], values(alone))


def test_options_are_checked():
    with pytest.raises(ValueError, match="above 0"):
        c.Options(500, 0)


def test_psd_peak(spark):
    p = spectral.power(np.sin(2 * np.pi * 40 * np.arange(1024) / 500)[None, :], 500)[0]
    hz = np.arange(513) * 500 / 1024
    assert len(p) == 513 and abs(hz[p.argmax()] - 40) <= 500 / 1024 + 1
    assert p.max() > 100 * p[np.abs(hz - 150).argmin()]


def gaps(spark):
    return spark.createDataFrame([("s", 1, 10_000_000, 5_000_000, 5_000_000, 15_000_000)], "stream_key string, gap_no int, old_us long, gap_us long, cum_us long, resume_real_us long")


@pytest.mark.parametrize(("mode", "want"), [("clamp", [9, 10, 10, 12]), ("code", [9, 12, 10, 12]), ("drop", [9, None, 10, 12])])
def test_times_in_and_around_a_gap(spark, mode, want):
    t = spark.createDataFrame([("s", x * 1_000_000) for x in (9, 12, 15, 17)], "stream_key string, t_us long")
    got = timebase.old_frame_time(t, gaps(spark), mode).orderBy("t_us").collect()
    assert [None if r.old_us is None else r.old_us / 1e6 for r in got] == want


def test_intervals_merge(spark):
    g = spark.createDataFrame([("s", 2, 1), ("s", 3, 1), ("s", 6, 1)], "stream_key string, resume_real_us long, gap_us long")
    got = timebase.missing_intervals(g).orderBy("start_us").collect()
    assert [(r.start_us, r.end_us) for r in got] == [(1, 3), (5, 6)]
    edge = spark.createDataFrame([("s", 100_000, 200_000)], "stream_key string, newest_us long, edge_us long")
    clipped = timebase.missing_intervals(g, view=(2, 150_000), edge=edge).orderBy("start_us").collect()
    assert [(r.start_us, r.end_us) for r in clipped] == [(2, 3), (5, 6), (100_000, 150_000)]


@pytest.mark.parametrize(("pattern", "takes"), [("1", {"1"}), ("L|R", {"L|R"}), ("a | b", {"a", "b"}), ("", {"1", "10", "L|R", "a", "b"}), (" | ", {"1", "10", "L|R", "a", "b"})])
def test_labels(spark, pattern, takes):
    df = spark.createDataFrame([(x,) for x in ("1", "10", "L|R", "a", "b")], "label string")
    assert {r.label for r in df.where(streams.label_match(F.col("label"), pattern)).collect()} == takes


def test_bins(spark):
    rows = [("s", 0, i, v) for i, v in enumerate([float("nan"), 3.0, 1.0, 2.0, 7.0])]
    got = decimate.minmax(spark.createDataFrame(rows, "stream_key string, channel int, idx long, value double"), 4).collect()
    assert [(r.bin, r.lo, r.hi) for r in got] == [(0, 1.0, 3.0)]
    assert decimate.bin_width(8000) == 240 and decimate.bin_width(10) == 1
    assert decimate.uses_bins(80_000, 304, 1000) and not decimate.uses_bins(2000, 304, 1000)


def test_hold(spark):
    rows = [("s", 0, 0, 1.0, 0), ("s", 0, 25_000, 2.0, 1), ("s", 0, 30_000, 3.0, 2)]
    got = timebase.sample_and_hold(spark.createDataFrame(rows, "stream_key string, channel int, t_us long, value double, seq long")).orderBy("idx").collect()
    assert [r.value for r in got] == [1.0, 1.0, 1.0, 3.0]


def test_rank(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(10)], "k string, v double")
    assert decimate.ranked(df, ["k"], "v", {"x": "least(int(0.8 * n), n - 1)"}).first().x == 8.0
    odd = spark.createDataFrame([("g", v) for v in (5.0, 5.0, 5.0, float("nan"), None, -1e300, 1e-300)], "k string, v double")
    assert [tuple(r) for r in decimate.ranked(odd, ["k"], "v", {"a": "0", "b": "1", "c": "n - 1"}, 4).collect()] == [("g", -1e300, 1e-300, 5.0)]


def test_broadband_columns(spark):
    """Four of five columns hold one line; the fifth is lit throughout and is left out, unless it is all there is."""
    rows = [("s", col, k, 1.0 if k == 5 or col == 9 else 1e-9) for col in (*range(8), 9) for k in range(65)]
    cells = spark.createDataFrame(rows, "stream_key string, col int, k int, power double")
    assert abs(spectral.fit_hz_stft(cells, 65, 32.0).first().fit_hz - 32 * 5 / 64 * 1.2) < 1e-9
    assert spectral.fit_hz_stft(cells.where("col = 9"), 65, 32.0).first().fit_hz == 32.0
    blank = cells.withColumn("power", F.lit(None).cast("double"))
    assert spectral.fit_hz_stft(blank, 65, 32.0).count() == 0
    assert spectral.stft_hop(0.001, 256) == 30 and spectral.stft_columns(0.03) == 1500


def test_marker_text(spark):
    df = spark.createDataFrame([("", "b", ""), ("a", "", "c"), ("a", None, None)], "x string, y string, z string")
    assert [r.t for r in df.select(markers.marker_text(["x", "y", "z"]).alias("t")).collect()] == [", b", "a, c", "a"]


def test_selection_is_all_or_nothing(spark):
    cat = spark.createDataFrame([("a",), ("b",)], "stream_key string")
    assert streams.select_streams(cat, "all").count() == 2 and streams.select_streams(cat, "none").count() == 0
    with pytest.raises(ValueError, match="unknown stream z"):
        streams.select_streams(cat, spark.createDataFrame([("a",), ("z",)], "stream_key string"))


def test_blocks_equal_single_steps():
    """Any length, any start, each stage on or off; what is not finite stays where it is."""
    rng = np.random.default_rng(6)
    for o in (c.Options(500, 0.5, 60, 100), c.Options(500, None, 50), c.Options(100, 2.0), c.Options(100, None, None, 20)):
        chain = c.Chain(o)
        for n in (0, 1, 5, 127, 128, 129, 1000):
            x, state = rng.normal(size=n) * 100, rng.normal(size=6)
            want, end = chain.walk(x[None, :], state[None, :])
            got, last = chain.run(x, state)
            assert np.allclose(got, want[0], rtol=1e-9, atol=1e-9) and np.allclose(last, end[0], rtol=1e-9, atol=1e-9)
        x = np.ones(300)
        x[200] = np.nan
        got = chain.run(x, np.zeros(6))[0]
        assert np.isfinite(got[:200]).all() and np.isnan(got[200:]).all()


@pytest.mark.parametrize("run", [1, 3, 64])
def test_runs_of_chunks_equal_one_run(spark, run):
    o = c.Options(500, 0.5, 60, 100)
    whole = {r.idx: r.value for r in c.to_samples(c.condition(tone(spark, 1000, 7, 500, 3, 2, 4000), o)).collect()}
    got = {r.idx: r.value for r in c.to_samples(c.condition(tone(spark, 1000, 7, 500, 3, 2, 70), o, run)).collect()}
    assert got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-9 for k in got)


def test_channels_made_of_one_signal_are_one_pass_over_it(spark, data):
    from oscilla.plans.signal_queries import dense_channels

    plan = dense_channels(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Relation [") == 1


def test_spectrogram_through_gaps_works_the_arrivals_out_once(spark, data):
    """What is left to run reads what has been stored, not the table."""
    from oscilla.plans import epoch_queries

    files = epoch_queries.q7_stft_gaps(spark, data).inputFiles()
    assert files and not any("lineitem" in f for f in files)
