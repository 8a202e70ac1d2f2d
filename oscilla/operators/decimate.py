"""Min/max envelopes on a fixed grid, rasters and level of detail. samples: stream_key, channel, idx, value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timebase import asof_last


def bin_width(rate: float, seconds: float = 60, bins: int = 2000) -> int:
    return max(1, int(rate * seconds / bins))


def minmax(samples: DataFrame, width: int) -> DataFrame:
    """(stream_key, channel, bin, lo, hi) of closed bins, those with all ``width`` samples; NaN counts as a sample but not for lo and hi."""
    good = F.when(~F.isnan("value"), F.col("value"))
    bins = samples.groupBy("stream_key", "channel", F.expr(f"idx div {width}").alias("bin")).agg(F.min(good).alias("lo"), F.max(good).alias("hi"), F.count("*").alias("n"))
    return bins.where(F.col("n") == width).drop("n")


def minmax_chunks(chunks: DataFrame, width: int, chunk: int) -> DataFrame:
    """The same from chunk arrays of a length that ``width`` divides: no shuffle, each chunk gives its own bins."""
    if chunk % width:
        raise ValueError("width must divide the chunk")
    starts = F.sequence(F.lit(0), F.expr(f"size(values) div {width} - 1"))
    part = lambda k: F.filter(F.slice(F.col("values"), k * width + 1, width), lambda v: ~F.isnan(v))
    bins = F.transform(starts, lambda k: F.struct((F.expr(f"start_idx div {width}") + k).alias("bin"), F.array_min(part(k)).alias("lo"), F.array_max(part(k)).alias("hi")))
    return chunks.where(F.size("values") >= width).select("stream_key", "channel", F.explode(bins).alias("b")).select("stream_key", "channel", "b.*")


def bin_times(bins: DataFrame, anchors: DataFrame, width: int, dt_us: float) -> DataFrame:
    """Adds old_us, the centre of the bin on the gapless axis; real_time() adds the gaps."""
    centre = F.col("t0_us") + F.round((F.col("bin") * width + width / 2) * dt_us).cast("long")
    return bins.join(anchors, "stream_key").withColumn("old_us", centre).drop("t0_us")


def bin_tail(bins: DataFrame, n: int, end_bin: int | None = None) -> DataFrame:
    """The last n closed bins of each stream and channel, before end_bin if given."""
    if end_bin is not None:
        bins = bins.where(F.col("bin") < end_bin)
    head = bins.groupBy("stream_key", "channel").agg(F.max("bin").alias("last"))
    return bins.join(head, ["stream_key", "channel"]).where(F.col("bin") > F.col("last") - n).drop("last")


def minmax_pyramid(bins: DataFrame, factor: int = 4) -> DataFrame:
    """Bins of ``factor`` times the width, of those whose parts are all closed."""
    up = bins.groupBy("stream_key", "channel", F.expr(f"bin div {factor}").alias("bin")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))
    return up.where(F.col("n") == factor).drop("n")


def uses_bins(n_samples: int, n_channels: int, px: int, budget: int = 200_000) -> bool:
    return n_samples > 3 * px and n_samples * n_channels > budget


def view(samples: DataFrame, width: int, px: int, budget: int = 200_000) -> DataFrame:
    """By stream, bins (lo, hi) where there is too much to show, else the samples themselves (lo = hi); ``pos`` is bin or idx.

    A stream's samples are counted from its first index to its last.
    """
    size = samples.groupBy("stream_key").agg((F.max("idx") - F.min("idx") + 1).alias("n"), F.size(F.collect_set("channel")).alias("c"))
    size = size.select("stream_key", ((F.col("n") > 3 * px) & (F.col("n") * F.col("c") > budget)).alias("binned"))
    marked = samples.join(size, "stream_key")
    bins = minmax(marked.where("binned"), width).select("stream_key", "channel", F.lit(True).alias("binned"), F.col("bin").alias("pos"), "lo", "hi")
    raw = marked.where("not binned").select("stream_key", "channel", F.lit(False).alias("binned"), F.col("idx").alias("pos"), F.col("value").alias("lo"), F.col("value").alias("hi"))
    return bins.unionByName(raw)


def raster(bins: DataFrame, x0: float, x1: float, px: int, full_scale: float) -> DataFrame:
    """(stream_key, channel, px, cell): of the bin nearest to each column's centre, the earlier of two as near. bins have ``t``.

    The bin before a column is looked up in pieces of time, and the one after it in the same way on negated times.
    """
    step = (x1 - x0) / px
    lines = bins.select("stream_key", "channel").distinct()
    columns = lines.withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(px - 1)))).withColumn("t", F.lit(x0) + (F.col("px") + 0.5) * step)
    keys, cell = ["stream_key", "channel"], ((F.col("hi") - F.col("lo")) / full_scale).alias("cell")

    def beside(df, sign, name):
        marks = bins.select(*keys, (sign * F.col("t")).alias("at"), F.lit(0).alias("tie"), F.struct("t", cell).alias("p"))
        return asof_last(df.withColumn("at", sign * F.col("t")), marks, keys, "at", 64 * step).withColumnRenamed("p", name).drop("at")

    both = beside(beside(columns, 1.0, "left"), -1.0, "right")
    nearer = F.col("left").isNull() | (F.col("right").isNotNull() & (F.col("t") - F.col("left.t") > F.col("right.t") - F.col("t")))
    return both.select(*keys, "px", F.when(nearer, F.col("right.cell")).otherwise(F.col("left.cell")).alias("cell"))


def ranked(df: DataFrame, keys: list[str], value: str, picks: dict[str, str], grid: int = 1024) -> DataFrame:
    """The values at 0-based ranks of each group, NaN and null left out. picks: name -> rank as SQL over n, the group's size.

    A mergeable quantile sketch of each group (errors of at most n / (8 grid) ranks) gives the values at ``grid`` even ranks, and those beside
    a wanted rank enclose it. What lies below is counted only, and of the few values in between the distinct ones are put in order. So no task
    sorts a whole group, however its values are spread.
    """
    own = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("__v"))
    marks = F.percentile_approx("__v", [k / grid for k in range(grid + 1)], 8 * grid).alias("__q")
    sizes = own.groupBy(*keys).agg(F.count("*").alias("n"), marks)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.expr(rank).cast("long").alias("rank")) for name, rank in picks.items()])).alias("p")
    at = F.floor(F.col("p.rank") / F.col("n") * grid).cast("int")
    beside = sizes.select(*keys, wanted, "n", "__q").select(*keys, F.col("p.name").alias("__name"), F.col("p.rank").alias("__rank"), F.when(at >= 1, F.get("__q", at - 1)).alias("__lo"), F.get("__q", at + 2).alias("__hi"))
    placed = own.join(beside, keys).where("__hi is null or __v <= __hi").withColumn("__v", F.when(F.col("__lo").isNull() | (F.col("__v") >= F.col("__lo")), F.col("__v")))
    runs = placed.groupBy(*keys, "__name", "__rank", "__v").agg(F.count("*").alias("__c"))
    past = F.sum("__c").over(Window.partitionBy(*keys, "__name").orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, 0))
    hit = runs.withColumn("__past", past).where("__rank < __past and __rank >= __past - __c")
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in picks])


def auto_gain(samples: DataFrame, full_scale: float) -> DataFrame:
    """(stream_key, channel, gain) from raw samples: clamp(full * 0.4 / max(half of the range from rank .1n to .9n, 1e-3), 0.01, 100)."""
    r = ranked(samples.where("value is not null"), ["stream_key", "channel"], "value", {"lo": "least(int(0.1 * n), n - 1)", "hi": "least(int(0.9 * n), n - 1)"})
    return r.select("stream_key", "channel", _gain(F.lit(0.5) * (F.col("hi") - F.col("lo")), full_scale))


def auto_gain_bins(bins: DataFrame, full_scale: float) -> DataFrame:
    """The same from an envelope: the half-range at rank min(n - 1, int(.8n))."""
    half = bins.withColumn("half", F.lit(0.5) * (F.col("hi") - F.col("lo")))
    return ranked(half, ["stream_key", "channel"], "half", {"amp": "least(int(0.8 * n), n - 1)"}).select("stream_key", "channel", _gain(F.col("amp"), full_scale))


def _gain(amp, full_scale: float):
    return F.least(F.greatest(full_scale * 0.4 / F.greatest(amp, F.lit(1e-3)), F.lit(0.01)), F.lit(100.0)).alias("gain")
