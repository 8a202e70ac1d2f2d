"""Operators that cut a long stream into pieces, against the plain form over whole streams."""

import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from oscilla.operators import condition, decimate, markers, reconcile, spectral, timebase


@pytest.fixture(scope="module")
def one(spark):
    """One stream with ties, gaps of many pieces and null labels."""
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.choice([0, 3, 1000, 50_000], 3000, p=[0.2, 0.5, 0.29, 0.01]))
    rows = [("s", int(i), int(x), None if i % 11 == 0 else f"l{i % 3}", float(i)) for i, x in enumerate(t)]
    return spark.createDataFrame(rows, "stream_key string, seq long, t_us long, label string, value double").repartition(3).cache()


def same(a, b):
    assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("piece", [7, 1000, 10**9])
def test_previous_and_numbers(one, piece):
    w, l = Window.partitionBy("stream_key").orderBy("t_us", "seq"), Window.partitionBy("stream_key", "label").orderBy("t_us", "seq")  # noqa: E741
    same(markers.marker_seq(one, piece), one.withColumn("life_seq", F.row_number().over(w) - 1))
    same(markers.marker_dt(one, piece), one.withColumn("dt_us", F.col("t_us") - F.lag("t_us").over(w)).withColumn("dt_same_us", F.col("t_us") - F.lag("t_us").over(l)))
    back = one.withColumn("t_us", F.col("t_us") * F.when(F.col("seq") % 5 == 0, -1).otherwise(1))
    plain = back.withColumn("next_us", F.lead("t_us").over(Window.partitionBy("stream_key").orderBy("seq"))).where("next_us is not null").select("stream_key", "t_us", "next_us")
    same(reconcile.steps(back, piece), plain)
    step = one.withColumn("gap_us", F.col("t_us") - F.lag("t_us").over(w) - 3).where("gap_us > 10000").select("stream_key", F.col("t_us").alias("resume_real_us"), "gap_us")
    same(timebase.detect_gaps(one, 3, 10_000, piece), timebase.gap_prefix(step))


@pytest.mark.parametrize("piece", [5, 64, 4096])
def test_measured_rate(spark, piece):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.choice([0, 1, 500, 2000], 900))
    chunks = spark.createDataFrame([("s", i, int(x), int(rng.integers(1, 9))) for i, x in enumerate(t)], "stream_key string, chunk_id long, t_us long, n long")
    want, last, y = {}, None, None
    for r in chunks.collect():
        if last is not None and r.t_us - last > 1:
            x = r.n * 1e6 / (r.t_us - last)
            y = x if y is None else 0.9 * y + 0.1 * x
            want[r.chunk_id] = y
        last = r.t_us
    got = {r.chunk_id: r.rate for r in condition.measured_rate(chunks, piece=piece).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), rtol=1e-10)


def test_average_is_decided_once_a_stream(spark):
    rows = [("a", "eeg", 0, 4.0), ("a", "eog", 0, 1.0), ("a", "eog", 1, 7.0), ("b", "x", 0, 3.0), ("c", "eog", 0, 2.0), ("c", "ecg", 0, 4.0), ("d", "eeg1", 0, 1.0), ("d", "eeg2", 0, 3.0), ("d", "eeg1", 1, 5.0)]
    samples = spark.createDataFrame(rows, "stream_key string, channel string, idx long, value double")
    kinds = spark.createDataFrame([("a", "eeg", "EEG"), ("a", "eog", "EOG"), ("b", "x", "EEG"), ("c", "eog", "EOG"), ("c", "ecg", "ECG")], "stream_key string, channel string, type string")
    got = {(r.stream_key, r.channel, r.idx): r.value for r in condition.common_average(samples, kinds).collect()}
    assert got == {("a", "eeg", 0): 0.0, ("a", "eog", 0): -3.0, ("a", "eog", 1): None, ("b", "x", 0): 3.0, ("c", "eog", 0): -1.0, ("c", "ecg", 0): 1.0, ("d", "eeg1", 0): -1.0, ("d", "eeg2", 0): 1.0, ("d", "eeg1", 1): 0.0}


def test_raster_grows_in_proportion(spark):
    seconds = []
    for n in (20_000, 200_000):
        bins = spark.range(n).select(F.lit("s").alias("stream_key"), F.lit(0).alias("channel"), F.col("id").cast("double").alias("t"), F.lit(0.0).alias("lo"), F.col("id").cast("double").alias("hi"))
        began = time.time()
        got = {r.px: r.cell for r in decimate.raster(bins, 0.0, float(n), 50, 1.0).collect()}
        seconds.append(time.time() - began)
        assert len(got) == 50 and all(abs(got[p] - (p + 0.5) * n / 50) <= 1 for p in got)
    assert seconds[1] < 60


def test_grid_is_dealt_out_in_runs(spark):
    df = spark.createDataFrame([("s", 0, 0, 1, 2.0), ("s", 0, 10_007, 2, 3.0)], "stream_key string, channel int, t_us long, seq long, value double")
    for points in (7, 1000, 1 << 16):
        assert [r.idx for r in timebase.hold_grid(df, 10, points).orderBy("idx").collect()] == list(range(1001))
    long = df.withColumn("t_us", F.when(F.col("seq") == 2, 2 * 86_400_000_000).otherwise(0))
    assert timebase.hold_grid(long, 10_000).count() == 2 * 86400 * 100 + 1


def test_windows_meet_stamps_of_their_pieces(spark):
    a = spark.range(500).select(F.lit("s").alias("stream_key"), F.col("id").alias("seq"), (F.col("id") * 10).alias("t_us"), F.col("id").cast("double").alias("value"))
    b = a.withColumn("value", F.when(F.col("seq") == 77, -1.0).otherwise(F.col("value"))).where("seq <> 300")
    windows = reconcile.comparison_windows(a, b, 400, 5, 20)
    for piece in (33, 10**6):
        got = sorted((r.cycle, r.n_a, r.n_b, r.common, r.unequal, r.ok) for r in reconcile.compare_windows(a, b, windows, piece_us=piece).collect())
        assert len(got) == 5 and [g[5] for g in got].count(True) >= 3 and sum(g[4] for g in got) <= 1
        if piece == 33:
            first = got
        assert got == first


def test_short_chunks_are_refused(spark):
    chunks = condition.to_chunks(spark.range(64).select(F.lit("s").alias("stream_key"), F.lit(0).alias("channel"), F.col("id").alias("idx"), F.sin("id").alias("value")), 8)
    with pytest.raises(Exception, match="too short"):
        spectral.stft(chunks, 32, 8, 1.0).count()


def test_references_by_chunk_equal_those_by_sample(spark):
    """Channels of unequal length, one that begins late, one alone in its stream, NaN, and more channels than are gathered at once."""
    rng = np.random.default_rng(5)
    rows = [("s", c, i, float(rng.normal())) for c in range(40) for i in range(c % 3 * 5, 150 - c)]
    rows += [("t", 7, i, float(i)) for i in range(90)] + [("s", 40, i, float("nan") if i == 33 else 1.0) for i in range(60)]
    samples = spark.createDataFrame(rows, "stream_key string, channel int, idx long, value double")
    kinds = spark.createDataFrame([("s", c, "EEG" if c % 4 else "EOG") for c in range(40)], "stream_key string, channel int, type string")
    key = lambda d: {(r.stream_key, r.channel, r.idx): None if r.value is None else round(r.value, 9) for r in d.collect()}
    same = lambda a, b: a.keys() == b.keys() and all(a[k] == b[k] or (a[k] != a[k] and b[k] != b[k]) for k in a)
    chunks = condition.to_chunks(samples, 32)
    for of in (None, kinds):
        got = key(condition.to_samples(condition.common_average_chunks(chunks, 32, of)))
        assert same(got, key(condition.common_average(samples, of))) and len(got) == len(rows)
    for channel in (0, 2, 39, 99):
        assert same(key(condition.to_samples(condition.channel_reference_chunks(chunks, 32, channel))), key(condition.channel_reference(samples, channel)))


def test_a_filter_goes_on_by_blocks_after_what_is_not_finite():
    rng = np.random.default_rng(6)
    for options in (condition.Options(500, 0.5, 60, 40), condition.Options(500, None, 60, None), condition.Options(500, 1.0, None, None), condition.Options(500, None, None, 40)):
        chain = condition.Chain(options)
        for at, what in ((0, np.nan), (1000, np.nan), (2999, np.inf), (1700, -np.inf)):
            x = rng.normal(size=3000)
            x[at] = what
            state = np.array([x[0] if np.isfinite(x[0]) else 0.0, 0, 0, 0, 0, 0])
            got, want = chain.run(x, state)[0], chain.walk(x[None, :], state[None, :])[0][0]
            assert np.allclose(got[:at], want[:at]) and (np.isnan(got) == np.isnan(want)).all()
        assert np.isnan(chain.run(np.ones(1000), np.full(6, np.nan))[0]).all()


def test_ranks_with_one_far_value(spark):
    """The values in between stay few: nearly all are in one thousandth of the range."""
    df = spark.range(200_000).select(F.lit("g").alias("k"), F.when(F.col("id") == 7, 1e18).otherwise((F.col("id") * 7919 % 200_000).cast("double")).alias("v"))
    picks = {"a": "int(0.1 * n)", "m": "n div 2", "z": "n - 1", "o": "0"}
    got = decimate.ranked(df, ["k"], "v", picks).first()
    v = sorted(r.v for r in df.collect())
    assert (got.a, got.m, got.z, got.o) == (v[20_000], v[100_000], v[-1], v[0])
