"""The recording sink and the stored levels of detail."""

import pytest
from pyspark.sql import functions as F

from oscilla.operators import decimate
from oscilla.sources import recording
from oscilla.sources.tiles import Tiles
from oscilla.streaming import sink


def rows(df):
    return sorted(map(str, df.collect()))


def samples(spark, n=600):
    own = spark.range(n).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("stream_key"), F.col("id").alias("seq"), (F.col("id") * 1000 - (F.col("id") % 7) * 3000).alias("t_us"), F.sin("id").alias("value"))
    return own.withColumn("offset_us", F.when(F.col("seq") % 50 < 3, F.col("seq") * 1.5))


@pytest.mark.parametrize("fold", [2, 64])
def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, monkeypatch, fold):
    monkeypatch.setattr(sink, "FOLD", fold)
    out, df = sink.RecordingSink(f"file://{tmp_path}/rec"), samples(spark)
    for k in range(6):
        out.write(df.where(f"seq div 100 = {k}"), k)
        if k in (1, 2, 4):  # replayed after a failure; and once with a file of a half-written try left in its folder
            (tmp_path / f"rec/samples/batch={k}/part-left.parquet").write_bytes(b"PAR1 broken")
            out.write(df.where(f"seq div 100 = {k}"), k)
    assert rows(out.footers(spark)) == rows(recording.recording_summary(df))
    assert rows(out.samples(spark).select("stream_key", "seq", "t_us", "value")) == rows(df.drop("offset_us"))
    assert rows(out.clock_offsets(spark)) == rows(recording.clock_offsets(df.where("offset_us is not null")))


def test_a_stream_whose_commit_was_lost_is_written_once(spark, tmp_path):
    import shutil

    df = samples(spark)
    for k in range(3):
        df.where(f"seq div 200 = {k}").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    out = sink.RecordingSink(f"file://{tmp_path}/rec")
    out.start(stream(), f"file://{tmp_path}/cp").awaitTermination(120)
    for name in ("2", ".2.crc"):  # the last batch is done again
        (tmp_path / f"cp/commits/{name}").unlink(missing_ok=True)
    out.start(stream(), f"file://{tmp_path}/cp").awaitTermination(120)
    assert rows(out.footers(spark)) == rows(recording.recording_summary(df))
    assert out.samples(spark).count() == 600
    shutil.rmtree(tmp_path / "in")


def test_tiles_give_what_bins_give_and_read_few_files(spark, tmp_path):
    n, px = 64_000, 50
    df = spark.range(2 * n).select((F.col("id") % 2).cast("string").alias("stream_key"), F.lit(0).alias("channel"), F.expr("id div 2").alias("idx"), F.sin(F.col("id") * 0.37).alias("value"))
    tiles = Tiles(f"file://{tmp_path}/t", 4, 5, 64)
    step = 64 * tiles.bin_width(4)
    for at in [*range(0, n, step), 0]:  # a recording that grows; its first part comes twice
        tiles.add(df.where(f"idx >= {at} and idx < {at + step}"))
    for first, last in ((0, n - 1), (1003, 9000), (20_000, 20_700), (5, 6), (n - 3000, n + 5000)):
        level = tiles.level_for(first, last, px)
        got = tiles.view(spark, first, last, px)
        width = tiles.bin_width(level)
        want = decimate.minmax(df.where(f"idx >= {first} and idx <= {last}"), width)
        assert rows(got.select("stream_key", "channel", "bin", "lo", "hi")) == rows(want.select("stream_key", "channel", "bin", "lo", "hi"))
        assert level == 4 or (last - first + 1) // tiles.bin_width(level + 1) < px
    files = lambda a, b: len(tiles.view(spark, a, b, px).select(F.input_file_name()).distinct().collect())
    assert files(20_000, 20_700) <= 4 * 2 and files(0, n - 1) <= 2 * (n // step + 1)


def test_tiles_work_on_their_samples_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(4000).select(F.lit("s").alias("stream_key"), F.lit(0).alias("channel"), F.col("id").alias("idx"), F.sin("id").alias("value"))
    Tiles(f"file://{tmp_path}/once", 4, 4, 16).add(df.mapInArrow(counted, df.schema))
    assert seen.value == 4000
