"""Marker streams: (stream_key, seq, t_us, label)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timebase import PIECE_US, numbered, previous


def marker_text(parts: list[str]) -> Column:
    """The parts of a multi-channel marker joined with ", "; empty parts after the first are skipped."""
    first, *rest = (F.coalesce(F.col(c), F.lit("")) for c in parts)
    kept = F.filter(F.array(*rest), lambda x: x != "") if rest else F.array().cast("array<string>")
    return F.array_join(F.concat(F.array(first), kept), ", ")


def marker_seq(df: DataFrame, piece_us: int = PIECE_US) -> DataFrame:
    """Adds life_seq (0-based in time order) by stream; a long stream is numbered in pieces of time."""
    return numbered(df, ["stream_key"], ["t_us", "seq"], "life_seq", piece_us)


def marker_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("stream_key").agg(F.min("t_us").alias("first_us"), F.count("*").alias("n"))


def marker_dt(df: DataFrame, piece_us: int = PIECE_US) -> DataFrame:
    """Adds dt_us and dt_same_us: time since the previous event, and since that with the same label; null if none or negative."""
    since = F.col("t_us") - F.col("__prev.t_us")
    d = previous(df, ["stream_key"], ["t_us", "seq"], ["t_us"], piece_us).withColumn("dt_us", since).drop("__prev")
    # a null label is a label of its own
    d = previous(d.withColumn("__label", F.struct(F.col("label").isNull(), F.coalesce("label", F.lit("")))), ["stream_key", "__label"], ["t_us", "seq"], ["t_us"], piece_us)
    return d.withColumn("dt_same_us", F.when(since >= 0, since)).drop("__prev", "__label")


def marker_rate(df: DataFrame, now_us, seconds: float) -> DataFrame:
    """Events a second over the last ``seconds`` before now."""
    recent = (F.col("t_us") > now_us - int(seconds * 1_000_000)) & (F.col("t_us") <= now_us)
    return df.groupBy("stream_key").agg((F.count(F.when(recent, 1)) / F.lit(seconds)).alias("rate"))


def marker_tail(df: DataFrame, n: int = 500) -> DataFrame:
    """The last n events of each stream; Spark keeps n rows a key before the shuffle."""
    w = Window.partitionBy("stream_key").orderBy(F.col("t_us").desc(), F.col("seq").desc())
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


retain = marker_tail


def marker_since(df: DataFrame, t_us: int) -> DataFrame:
    return df.where(F.col("t_us") > t_us)


def marker_within(df: DataFrame, seconds: float = 64) -> DataFrame:
    """Events within ``seconds`` of their stream's newest."""
    newest = df.groupBy("stream_key").agg(F.max("t_us").alias("newest"))
    return df.join(newest, "stream_key").where(F.col("t_us") >= F.col("newest") - int(seconds * 1_000_000)).drop("newest")


def relative_time(df: DataFrame) -> DataFrame:
    """Adds rel_us: time since the earliest first event (> 0) over all streams."""
    origin = df.where("t_us > 0").agg(F.min("t_us").alias("origin"))  # one row
    return df.join(F.broadcast(origin)).withColumn("rel_us", F.col("t_us") - F.col("origin")).drop("origin")


def merge_markers(dfs: list[DataFrame]) -> DataFrame:
    """All rows of several marker tables in time order."""
    return reduce(lambda a, b: a.unionByName(b), dfs).orderBy("t_us", "stream_key", "seq")


def marker_asof(df: DataFrame, anchor_us: int) -> DataFrame:
    """Of each stream the last event at or before anchor_us, else its first."""
    place = F.struct("t_us", "seq", "label")
    last, first = F.max(F.when(F.col("t_us") <= anchor_us, place)), F.min(place)
    return df.groupBy("stream_key").agg(F.coalesce(last, first).alias("m")).select("stream_key", F.col("m.t_us").alias("t_us"), F.col("m.seq").alias("seq"), F.col("m.label").alias("label"))


def type_counts(channels: DataFrame) -> DataFrame:
    """Channels by type; blank types are (none)."""
    kind = F.when(F.coalesce(F.col("type"), F.lit("")) == "", "(none)").otherwise(F.col("type"))
    return channels.groupBy("stream_key", kind.alias("type")).agg(F.count("*").alias("n"))


def position_counts(channels: DataFrame) -> DataFrame:
    return channels.groupBy("stream_key").agg(F.count("loc").alias("placed"), F.count("*").alias("n"))


def stream_unit(channels: DataFrame) -> DataFrame:
    """The first unit that is not empty."""
    return channels.where("unit <> ''").groupBy("stream_key").agg(F.min_by("unit", "channel").alias("unit"))
