"""Event-aligned averaging. triggers: stream_key, seq, t_us, label; epochs: stream_key, channel, event, values ARRAY<DOUBLE> of pre + post samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decimate import ranked
from .streams import label_match
from .timebase import old_frame_time, time_to_idx


def triggers(markers: DataFrame, labels: str = "", after_seq: int | None = None) -> DataFrame:
    picked = markers.where(label_match(F.col("label"), labels))
    return picked if after_seq is None else picked.where(F.col("seq") > after_seq)


def event_index(trig: DataFrame, anchors: DataFrame, gaps: DataFrame | None, dt_us: float, in_gap: str = "clamp") -> DataFrame:
    """Adds idx: the sample nearest to each trigger, through the gaps."""
    placed = old_frame_time(trig, gaps, in_gap) if gaps is not None else trig.withColumn("old_us", F.col("t_us"))
    return placed.join(anchors, "stream_key").withColumn("idx", time_to_idx(F.col("old_us"), F.col("t0_us"), dt_us)).drop("t0_us", "old_us")


def epoch_shape(pre_ms: float, post_ms: float, rate: float) -> tuple[int, int]:
    return max(1, int(pre_ms * rate / 1000)), max(1, int(post_ms * rate / 1000))


def epoch_axis(bin_, pre: int, dt_ms: float):
    return (bin_ - pre) * dt_ms


def epochs(chunks: DataFrame, indexed: DataFrame, pre: int, post: int, chunk: int) -> DataFrame:
    """(stream_key, channel, event, values): samples [idx - pre, idx + post) of each event; events without all of them have none.

    Each event is sent to the few chunk ids that it touches, so the range join is an equi-join. Chunks hold ``chunk`` samples.
    """
    e = indexed.where(F.col("idx") >= pre).select("stream_key", F.col("seq").alias("event"), (F.col("idx") - pre).alias("from"))
    touched = e.withColumn("chunk_id", F.explode(F.sequence(F.expr(f"`from` div {chunk}"), F.expr(f"(`from` + {pre + post - 1}) div {chunk}"))))
    parts = touched.join(chunks.select("stream_key", "channel", "chunk_id", "start_idx", "values"), ["stream_key", "chunk_id"])
    skip = F.greatest(F.col("from") - F.col("start_idx"), F.lit(0)).cast("int")
    upto = F.least(F.col("from") + (pre + post) - F.col("start_idx"), F.size("values")).cast("int")
    cut = parts.where(skip < upto).select("stream_key", "channel", "event", "chunk_id", F.slice("values", skip + 1, upto - skip).alias("part"))
    whole = cut.groupBy("stream_key", "channel", "event").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "part"))).alias("p"))
    return whole.select("stream_key", "channel", "event", F.flatten(F.transform("p", lambda x: x["part"])).alias("values")).where(F.size("values") == pre + post)


def baseline(ep: DataFrame, pre: int) -> DataFrame:
    """values less the mean of the first ``pre`` samples."""
    mean = F.aggregate(F.slice("values", 1, pre), F.lit(0.0), lambda a, x: a + x) / pre
    return ep.withColumn("__m", mean).withColumn("values", F.transform("values", lambda x: x - F.col("__m"))).drop("__m")


def erp(ep: DataFrame, max_channels: int | None = None) -> DataFrame:
    """(channel, bin, mean, n) over all epochs; partial sums are made before the shuffle."""
    own = ep if max_channels is None else ep.where(F.col("channel") < max_channels)
    return own.select("channel", F.posexplode("values").alias("bin", "v")).groupBy("channel", "bin").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def recent_epochs(ep: DataFrame, n: int = 60) -> DataFrame:
    w = Window.partitionBy("channel").orderBy(F.col("event").desc(), "stream_key")
    return ep.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def robust_range(cells: DataFrame, value: str = "v") -> DataFrame:
    """(channel, half): |v| at 0-based rank int(.95 (n - 1)), times 1.2, at least 1e-3."""
    r = ranked(cells.withColumn("__a", F.abs(F.col(value))), ["channel"], "__a", {"x": "int(0.95 * (n - 1))"})
    return r.select("channel", F.greatest(F.col("x") * 1.2, F.lit(1e-3)).alias("half"))


def erp_matrix(averages: DataFrame) -> DataFrame:
    """(channel, row): the averages of each channel in order of time."""
    return averages.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("bin", "mean"))).alias("r")).select("channel", F.transform("r", lambda x: x["mean"]).alias("row"))


def trial_matrix(ep: DataFrame, channel) -> DataFrame:
    """(event, row): one channel's epochs by event."""
    return ep.where(F.col("channel") == channel).select("stream_key", "event", F.col("values").alias("row"))
