from pyspark.sql import functions as F

from oscilla.operators import condition as c
from oscilla.operators import decimate
from oscilla.sources import recording
from oscilla.streaming import live


def samples(spark, n=1000):
    return spark.range(n).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("stream_key"), F.lit(0).alias("channel"), F.expr("id div 3").alias("idx"), F.col("id").alias("seq"), (F.col("id") * 1000).alias("t_us"), F.sin("id").alias("value"))


def test_record_and_read_back(spark, tmp_path):
    df = samples(spark)
    recording.record(df.where("seq < 500"), f"file://{tmp_path}/rec")
    recording.record(df.where("seq >= 500"), f"file://{tmp_path}/rec")
    back = recording.read_recording(spark, f"file://{tmp_path}/rec").select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    markers = df.select("stream_key", "seq", "t_us", F.lit('say "x"').alias("label"))
    recording.write_marker_csv(markers, f"file://{tmp_path}/csv")
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/csv").collect()]
    assert len(lines) == 1001 and "time,dt,dt_same,value" in lines and '0.003000,0.003000,0.003000,"say ""x"""' in lines


SCHEMA = "stream_key string, channel int, idx long, seq long, t_us long, value double"


def batches(spark, tmp_path, df, n=3):
    for i in range(n):
        df.where(F.expr(f"idx div 100 % {n} = {i}")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return live.read_stream(spark, f"file://{tmp_path}/in", SCHEMA)


def test_recording_a_stream(spark, tmp_path):
    df = samples(spark)
    live.record_stream(batches(spark, tmp_path, df), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(120)
    assert sorted(map(tuple, recording.read_recording(spark, f"file://{tmp_path}/out").select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_closed_bins_equal_the_batch_form(spark, tmp_path):
    df = samples(spark)
    q = live.closed_bins_stream(batches(spark, tmp_path, df), 32).writeStream.format("memory").queryName("bins").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("bins")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, decimate.minmax(df, 32).collect()))


def test_filter_state_lasts_between_batches(spark, tmp_path):
    o = c.Options(100, 0.5, 20, 30)
    df = samples(spark, 900)
    for i in range(3):
        df.where(F.expr(f"idx div 100 = {i}")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = live.read_stream(spark, f"file://{tmp_path}/in", SCHEMA, maxFilesPerTrigger="1")
    q = live.filter_stream(stream, o).writeStream.format("memory").queryName("filtered").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.stream_key, r.idx): r.value for r in spark.table("filtered").collect()}
    want = c.to_samples(c.condition(c.to_chunks(df, 64), o)).collect()
    assert len(got) == len(want) == 900
    assert all(abs(got[r.stream_key, r.idx] - r.value) < 1e-9 for r in want)


def test_marker_rate_stream(spark, tmp_path):
    df = spark.range(100).select(F.lit("s").alias("stream_key"), F.timestamp_millis(F.col("id") * 500).alias("ts"))
    df.coalesce(1).write.parquet(f"file://{tmp_path}/m")
    stream = live.read_stream(spark, f"file://{tmp_path}/m", "stream_key string, ts timestamp")
    q = live.marker_rate_stream(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rates").agg(F.max("rate")).first()[0] == 2.0


def test_csv_is_in_order_and_whole(spark, tmp_path):
    import csv
    import glob

    rows = [("s", i, 10_000_000 - i * 1000, None if i % 7 == 0 else f'a,"{i}"') for i in range(500)]
    markers = spark.createDataFrame(rows, "stream_key string, seq long, t_us long, label string").repartition(6)
    recording.write_marker_csv(markers, f"file://{tmp_path}/csv")
    text = "".join(open(p, newline="").read() for p in sorted(glob.glob(f"{tmp_path}/csv/part-*")))
    got = list(csv.reader(text.splitlines()))
    assert got[0] == ["time", "dt", "dt_same", "value"] and all(len(r) == 4 for r in got)
    assert [(float(r[0]), r[3]) for r in got[1:]] == [(t / 1e6, label or "") for _, _, t, label in reversed(rows)]


def streamed(spark, df, tmp_path, build, order, parts=4):
    """The rows that a streaming form writes for df, read in ``parts`` batches in order."""
    n = df.count()
    for k in range(parts):
        ranked = df.orderBy(order).collect()[k * n // parts : (k + 1) * n // parts]
        spark.createDataFrame(ranked, df.schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{k}")
    source = live.read_stream(spark, f"file://{tmp_path}/in/*", df.schema, maxFilesPerTrigger="1", latestFirst="false")
    live.record_stream(build(source), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    return recording.read_recording(spark, f"file://{tmp_path}/out")


def test_streamed_gaps_bins_rates_and_grid(spark, tmp_path):
    from oscilla.operators import timebase

    df = samples(spark, 600).withColumn("t_us", F.col("t_us") + F.when(F.col("seq") > 250, 900_000).otherwise(0)).withColumn("value", F.when(F.col("idx") % 9 == 0, float("nan")).otherwise(F.col("value")))
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    got = streamed(spark, df.select("stream_key", "seq", "t_us"), tmp_path / "g", lambda s: live.gaps_stream(s, 3000, 250_000), "seq")
    assert same(got, timebase.detect_gaps(df, 3000, 250_000)) and got.count() == 3
    bins = df.select("stream_key", "channel", "idx", "value")
    assert same(streamed(spark, bins, tmp_path / "b", lambda s: live.closed_bins_stream(s, 8), "idx").withColumn("channel", F.col("channel").cast("int")), decimate.minmax(bins, 8))
    chunks = df.select("stream_key", F.col("idx").alias("chunk_id"), "t_us", F.lit(3).alias("n"))
    rates = streamed(spark, chunks, tmp_path / "r", live.measured_rate_stream, "chunk_id")
    rounded = lambda d: d.select("stream_key", "chunk_id", F.round("rate", 6).alias("rate"))
    assert same(rounded(rates), rounded(c.measured_rate(chunks)))
    values = df.fillna(-1.0).select("stream_key", "channel", "seq", "t_us", "value")
    held = streamed(spark, values, tmp_path / "h", lambda s: live.hold_stream(s, 1700), "seq")
    whole = timebase.sample_and_hold(values, 1700)
    newest = whole.join(values.groupBy("stream_key").agg(F.max("t_us").alias("m")), "stream_key").where("t_us < m").select("stream_key", "channel", "idx", "t_us", "value")
    assert same(held, newest)
