"""How recordings lie on disk: few files however many streams, and keys as they are."""

import glob

from pyspark.sql import functions as F

from oscilla.plans import stream_queries
from oscilla.sources import containers, recording
from oscilla.streaming import live, sink


def many(spark, streams=300):
    key = F.when(F.col("id") % streams == 7, "007").when(F.col("id") % streams == 8, "1.0").otherwise((F.col("id") % streams).cast("string"))
    return spark.range(2 * streams).select(key.alias("stream_key"), F.col("id").alias("seq"), (F.col("id") * 1000).alias("t_us"), F.sin("id").alias("value"))


def rows(df):
    return sorted(map(str, df.select("stream_key", "seq", "t_us", "value").collect()))


def test_recordings_of_many_streams_are_few_files_and_keep_keys(spark, tmp_path):
    df = many(spark)
    recording.record(df, f"file://{tmp_path}/rec")
    assert rows(recording.read_recording(spark, f"file://{tmp_path}/rec")) == rows(df)
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = lambda: live.read_stream(spark, f"file://{tmp_path}/in", df.schema)
    live.record_stream(stream(), f"file://{tmp_path}/live", f"file://{tmp_path}/cp").awaitTermination(120)
    assert rows(recording.read_recording(spark, f"file://{tmp_path}/live")) == rows(df)
    out = sink.RecordingSink(f"file://{tmp_path}/sink")
    out.start(stream(), f"file://{tmp_path}/cp2").awaitTermination(120)
    assert rows(out.samples(spark)) == rows(df)
    for name in ("rec", "live", "sink"):
        assert len(glob.glob(f"{tmp_path}/{name}/**/*.parquet", recursive=True)) <= 30


def test_a_part_of_arrivals_is_one_batch_of_many_files(spark):
    df = spark.range(0, 4000, 1, 6).select((F.col("id") % 40).cast("string").alias("stream_key"), (F.col("id") * 150_000 + stream_queries.START_US).alias("t_us"))
    own = stream_queries.Arriving(spark, df)
    seen = []
    folder = recording.fresh_folder(spark, "test")
    start = lambda: own.stream.writeStream.foreachBatch(lambda b, k: seen.append((k, b.count(), len(glob.glob(f"{own.folder.removeprefix('file://')}/come/{k}/*.parquet"))))).option("checkpointLocation", folder).trigger(availableNow=True).start()
    stream_queries._as_it_comes(start, own)
    assert [k for k, _, _ in seen] == list(range(stream_queries.FILES)) and sum(n for _, n, _ in seen) == 4000
    assert max(f for _, _, f in seen) > 1


def test_tasks_go_with_the_bytes_and_files_of_containers_not_with_ranges():
    small, large = [(f"{i}", 50_000) for i in range(1000)], ("x", 3 * containers.TASK + 5)
    for split in (1024, containers.SPLIT):
        dealt = containers.shares([*small, large], split)
        assert len(dealt) <= 1000 * (containers.OPEN + 50_000) // containers.TASK + 8
        spans = {}
        for piece in (p for share in dealt for p in share.pieces):
            spans.setdefault(piece.file, []).append((piece.begin, piece.end))
            assert piece.begin % split == 0
        assert all(x[0][0] == 0 and all(a[1] == b[0] for a, b in zip(x, x[1:])) for x in spans.values())
        assert {f: x[-1][1] for f, x in spans.items()} == dict([*small, large])


def test_holding_exchanges_samples_and_not_points(spark):
    """Long pauses, nulls first, ties within a step, and pieces without a sample; chunks are the same points."""
    from oscilla.operators import condition, timebase

    own = [("a", "x", i, t, v) for i, (t, v) in enumerate([(0, None), (2500, 1.0), (2600, 2.0), (2600, 3.0), (99_000, 4.0), (100_700, 5.0)])] + [("a", "y", 9, 40_000, None), ("b", "x", 1, 7, 6.0)]
    df = spark.createDataFrame(own, "stream_key string, channel string, seq long, t_us long, value double")
    held = timebase.sample_and_hold(df, 1000, 16)
    got = {(r.stream_key, r.channel, r.idx): (r.t_us, r.value) for r in held.collect()}
    x = lambda i: None if i < 3 else 3.0 if i < 99 else 4.0
    want = {("a", c, i): (1000 * i, x(i) if c == "x" else None) for c in "xy" for i in range(101)} | {("b", "x", 0): (7, 6.0)}
    assert got == want and held.count() == len(want)
    chunks = timebase.hold_chunks(df, 1000, 16)
    assert sorted(map(str, chunks.collect())) == sorted(map(str, condition.to_chunks(held, 16).collect()))
    # one exchange of samples and pieces holds the points: none comes after the run lengths
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode(sequence(first")]
