"""Signal views of plain tables: the columns the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oscilla.session import table

#: Columns that order lineitem rows in full, so that an index made from them is the same in every run.
DENSE_ORDER = "l_orderkey l_linenumber l_partkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
HOUR = 3_600_000_000


def micros(column: str = "ts"):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_key, channel, seq, t_us, label, value): users are streams, event types channels and labels."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("stream_key"), F.col("event_type").alias("channel"), F.col("event_id").alias("seq"), micros().alias("t_us"), F.col("event_type").alias("label"), "value")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_key, channel, idx, value): prices of each supplier in a fixed order."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    idx = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*DENSE_ORDER)) - 1
    return l.select(F.col("l_suppkey").cast("string").alias("stream_key"), F.lit(0).alias("channel"), idx.cast("long").alias("idx"), F.col("l_extendedprice").alias("value"))


#: Of the arrivals: their first time, the spacing of samples, and how long a dropout lasts.
START_US, STEP_US, DROPOUT_US = 1_704_067_200_000_000, 1_000_000, 2_500_000


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dense() with t_us: a sample a second, and a dropout before each one whose whole price is divisible by 40; ``lost`` marks some that a recording may lack."""
    gap = F.sum((F.floor("value") % 40 == 0).cast("long")).over(Window.partitionBy("stream_key").orderBy("idx"))
    return dense(spark, sf_dir).withColumn("t_us", F.lit(START_US) + F.col("idx") * STEP_US + gap * DROPOUT_US).withColumn("lost", F.floor("value") % 50 == 7)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial, label, values): embeddings as ready windows of 64 samples."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), "label", F.col("embedding").cast("array<double>").alias("values"))


# The same views for SQL.
EV = "ev as (select cast(user_id as varchar) as stream_key, event_type as channel, event_id as seq, epoch_us(ts) as t_us, event_type as label, value from events)"
DENSE = f"dense as (select cast(l_suppkey as varchar) as stream_key, row_number() over (partition by l_suppkey order by {', '.join(DENSE_ORDER)}) - 1 as idx, l_extendedprice as value from lineitem)"
ARR = f"{DENSE}, arr as (select *, {START_US} + idx * {STEP_US} + cast(sum(case when floor(value) % 40 = 0 then 1 else 0 end) over (partition by stream_key order by idx) as bigint) * {DROPOUT_US} as t_us, floor(value) % 50 = 7 as lost from dense)"
TRIALS = "trials as (select vec_id as trial, label, cast(embedding as double[]) as v from embeddings)"
