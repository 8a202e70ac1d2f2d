"""One sink for a recording: samples, clock offsets and footers, written once however often a batch is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla.sources.recording import clock_offsets

#: Batches whose footers are folded into one.
FOLD = 64


class RecordingSink:
    """Writes batches of samples (stream_key, seq, t_us, value and what else they have; offset_us, where a clock was measured) below a folder.

    Each part of a batch goes to a folder of its own, named by the batch, which is overwritten if the batch comes again; so one that
    failed halfway, or whose commit was lost, leaves no second copy. The footers are a table of one row a stream and batch; every FOLD
    batches those before are folded into a new folder, which readers take instead of the ones that it stands for.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        own = batch.persist()
        try:
            place = lambda table: f"{self.path}/{table}/batch={batch_id}"
            samples = own.drop("offset_us") if "offset_us" in own.columns else own
            # the footer last: what has one is whole
            samples.hint("rebalance", "stream_key").sortWithinPartitions("stream_key", "seq").write.mode("overwrite").parquet(place("samples"))
            if "offset_us" in own.columns:
                clock_offsets(own.where("offset_us is not null")).write.mode("overwrite").parquet(place("clock_offsets"))
            ends = own.groupBy("stream_key").agg(F.min(F.struct("seq", "t_us")).alias("first"), F.max(F.struct("seq", "t_us")).alias("last"), F.count("*").alias("n"))
            ends.write.mode("overwrite").parquet(place("footers"))
            if batch_id and batch_id % FOLD == 0:
                self._fold(own.sparkSession, batch_id)
        finally:
            own.unpersist()

    def start(self, samples: DataFrame, checkpoint: str):
        return samples.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _fold(self, spark: SparkSession, upto: int) -> None:
        known = self._footers(spark).where(F.col("batch") < upto)
        whole = known.groupBy("stream_key").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
        whole.write.mode("overwrite").parquet(f"{self.path}/folded/upto={upto}")

    def _footers(self, spark: SparkSession) -> DataFrame:
        """Rows that together stand for all batches: the newest folded ones, and those of later batches."""
        each = spark.read.option("basePath", f"{self.path}/footers").parquet(f"{self.path}/footers")
        try:
            folded = spark.read.parquet(f"{self.path}/folded")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return each.select("stream_key", "first", "last", "n", "batch")
        newest = folded.select(F.max("upto").alias("newest"))
        own = folded.join(F.broadcast(newest), F.col("upto") == F.col("newest")).select("stream_key", "first", "last", "n", (F.col("upto") - 1).alias("batch"))
        later = each.join(F.broadcast(newest), F.col("batch") >= F.col("newest")).select("stream_key", "first", "last", "n", "batch")
        return own.unionByName(later)

    def samples(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", f"{self.path}/samples").parquet(f"{self.path}/samples").drop("batch")

    def clock_offsets(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/clock_offsets").drop("batch")

    def footers(self, spark: SparkSession) -> DataFrame:
        """(stream_key, first_us, last_us, n): recording_summary() of what has been written, from the footers alone."""
        whole = self._footers(spark).groupBy("stream_key").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
        return whole.select("stream_key", F.col("first.t_us").alias("first_us"), F.col("last.t_us").alias("last_us"), "n")
