"""Stored levels of detail: closed bins of every level as a table cut by level and range, so that a view reads a few files, however long the recording is."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla.operators.decimate import minmax, minmax_pyramid

FACTOR = 4
#: Bins of a channel in one tile.
TILE = 4096


class Tiles:
    """A table of min/max bins below ``path``: level 0 has bins of ``width`` samples, each level above FACTOR times as many.

    Bins never change once they are closed, so a recording that grows only adds tiles: add() takes samples of whole tiles of the
    topmost level and writes them to folders of their own, named by level and range; one that is added again is overwritten. ``added`` marks the bins of one call.
    """

    def __init__(self, path: str, width: int, levels: int = 5, tile: int = TILE):
        self.path, self.width, self.levels, self.tile = path.rstrip("/"), width, levels, tile

    def bin_width(self, level: int) -> int:
        return self.width * FACTOR**level

    def add(self, samples: DataFrame) -> None:
        """Bins of samples (stream_key, channel, idx, value). A bin that is not whole in them is left to a later call, which must have all of its samples."""
        spark, call = samples.sparkSession, uuid4().hex
        before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            bins = minmax(samples, self.width)
            for level in range(self.levels):
                folder = f"{self.path}/level={level}"
                cut = bins.withColumn("added", F.lit(call)).withColumn("range", F.expr(f"bin div {self.tile}"))
                cut.repartition("range", "stream_key").sortWithinPartitions("stream_key", "channel", "bin").write.mode("overwrite").partitionBy("range").parquet(folder)
                # the level above is made of what this call has just written, told by its mark: the samples are not worked on again
                whole = spark.read.schema(cut.schema).parquet(folder).where(F.col("added") == call)
                bins = minmax_pyramid(whole.drop("added", "range"), FACTOR)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)

    def level_for(self, first: int, last: int, px: int) -> int:
        """The highest level that still has a bin for each of px pixels over samples first..last, 0 if none has."""
        level = 0
        while level + 1 < self.levels and (last - first + 1) // self.bin_width(level + 1) >= px:
            level += 1
        return level

    def view(self, spark: SparkSession, first: int, last: int, px: int) -> DataFrame:
        """(stream_key, channel, level, bin, lo, hi) of the bins that lie within samples first..last, of one level: at most FACTOR px + 1 a channel, if there are levels enough."""
        level = self.level_for(first, last, px)
        width = self.bin_width(level)
        a, b = -(-first // width), (last + 1) // width - 1
        near = (F.col("range") >= a // self.tile) & (F.col("range") <= b // self.tile)
        own = spark.read.parquet(f"{self.path}/level={level}").where(near & (F.col("bin") >= a) & (F.col("bin") <= b))
        return own.select("stream_key", "channel", F.lit(level).alias("level"), "bin", "lo", "hi")
