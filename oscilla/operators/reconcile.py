"""Comparison of two recordings. samples: stream_key, seq (arrival order), t_us, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timebase import previous

#: Chunk tags of the container: file header, stream header, samples, clock offset, boundary, stream footer.
TAGS = {"file_header": 1, "stream_header": 2, "samples": 3, "clock_offset": 4, "boundary": 5, "footer": 6}


def stream_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(stream_key, side) of streams in one recording only."""
    ka, kb = (d.select("stream_key").distinct().withColumn(s, F.lit(1)) for d, s in ((a, "in_a"), (b, "in_b")))
    return ka.join(kb, "stream_key", "full_outer").where("in_a is null or in_b is null").select("stream_key", F.when(F.col("in_a").isNull(), "b").otherwise("a").alias("side"))


def chunk_inventory(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file", "stream_id", "tag").agg(F.count("*").alias("n"))


def check_structure(inventory: DataFrame) -> DataFrame:
    """(file, stream_id, ok): one header and footer, offsets and samples there, and one file header in the file."""
    n = lambda tag, f=F.sum: F.coalesce(f(F.when(F.col("tag") == TAGS[tag], F.col("n"))), F.lit(0))
    files = inventory.groupBy("file").agg(n("file_header").alias("heads"))
    per = inventory.where("stream_id is not null").groupBy("file", "stream_id").agg(*[n(t).alias(t) for t in ("stream_header", "samples", "clock_offset", "footer")])
    return per.join(files, "file").select("file", "stream_id", ((F.col("heads") == 1) & (F.col("stream_header") == 1) & (F.col("footer") == 1) & (F.col("clock_offset") >= 1) & (F.col("samples") >= 1)).alias("ok"))


def metadata_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys and field of every value that differs; rows of one side only differ in all that is not null."""
    fields = [c for c in a.columns if c not in keys]
    j = a.alias("a").join(b.alias("b"), keys, "full_outer")
    diffs = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in fields]))
    return j.select(*keys, F.explode(diffs).alias("field"))


def header_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, a, b) of every element of two headers' XML (keys, path, value) that differs; null on the side that has none.

    Repeated elements, as channels are, are matched by their number in the path, so the tables may be nested as deep as they
    like. Empty elements are as if not there. No rows for a key that only one side has: stream_diff() tells these.
    """
    side = lambda d, name: d.where("value <> ''").select(*keys, "path", F.col("value").alias(name))
    both = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys)
    j = side(a, "a").join(side(b, "b"), [*keys, "path"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return j.join(both, keys, "left_semi").select(*keys, "path", "a", "b")


def steps(samples: DataFrame, piece: int = 1 << 20) -> DataFrame:
    """Pairs (stream_key, t_us, next_us) of samples that arrive one after the other; a long stream is cut into pieces of ``piece`` sequence numbers."""
    paired = previous(samples.select("stream_key", "seq", "t_us"), ["stream_key"], ["seq"], ["t_us"], piece)
    return paired.where("__prev is not null").select("stream_key", F.col("__prev.t_us").alias("t_us"), F.col("t_us").alias("next_us"))


def backsteps(a: DataFrame, ref: DataFrame) -> DataFrame:
    """Steps back in time in a that the reference has not, although it has both stamps."""
    back = steps(a).where("next_us < t_us").join(steps(ref).where("next_us < t_us"), ["stream_key", "t_us", "next_us"], "left_anti")
    seen = ref.select("stream_key", "t_us").distinct()
    return back.join(seen, ["stream_key", "t_us"], "left_semi").join(seen.withColumnRenamed("t_us", "next_us"), ["stream_key", "next_us"], "left_semi").select("stream_key", "t_us", "next_us")


def nonfinite(samples: DataFrame) -> DataFrame:
    return samples.where(F.isnan("value") | (F.abs("value") == float("inf")))


def spans(samples: DataFrame) -> DataFrame:
    """First and last stamp of each stream in order of arrival."""
    return samples.groupBy("stream_key").agg(F.min_by("t_us", "seq").alias("first_us"), F.max_by("t_us", "seq").alias("last_us"))


def comparison_windows(a: DataFrame, b: DataFrame, window_us: int, cycles: int, margin_us: int = 50_000) -> DataFrame:
    """(stream_key, cycle, from_us, to_us): the overlap less a margin in ``cycles`` steps of at most window_us; one window over all if it is short."""
    j = spans(a).join(spans(b).select("stream_key", F.col("first_us").alias("f"), F.col("last_us").alias("l")), "stream_key")
    lo, hi = F.greatest("first_us", "f") + margin_us, F.least("last_us", "l") - margin_us
    j = j.select("stream_key", lo.alias("lo"), hi.alias("hi"), F.least("first_us", "f").alias("first"), F.greatest("last_us", "l").alias("last"))
    step = F.expr(f"(hi - lo) div {cycles}")
    many = F.transform(F.sequence(F.lit(0), F.lit(cycles - 1)), lambda c: F.struct(c.alias("cycle"), (F.col("lo") + c * step).alias("from_us"), F.least(F.col("lo") + c * step + window_us, F.col("lo") + (c + 1) * step).alias("to_us")))
    one = F.array(F.struct(F.lit(0).alias("cycle"), F.col("first").alias("from_us"), F.col("last").alias("to_us")))
    return j.select("stream_key", F.explode(F.when(F.col("hi") - F.col("lo") < window_us, one).otherwise(many)).alias("w")).select("stream_key", "w.*")


def compare_windows(a: DataFrame, b: DataFrame, windows: DataFrame, edge: int = 0, regular: Column | bool = True, piece_us: int = 3_600_000_000) -> DataFrame:
    """(stream_key, cycle, n_a, n_b, common, unequal, ok): stamps are matched exactly and values must be equal there.

    A stamp that repeats is matched once, by its first value; its other samples count as unmatched. A window goes to the
    pieces of time that it touches, so stamps meet only windows of their own piece.
    """
    first = lambda d, v: d.groupBy("stream_key", "t_us").agg(F.min_by("value", "seq").alias(v), F.count("*").alias(f"n_{v}"))
    j = first(a, "a").join(first(b, "b"), ["stream_key", "t_us"], "full_outer")
    part = lambda c: F.floor(F.col(c) / piece_us)
    touched = windows.where("from_us <= to_us").withColumn("piece", F.explode(F.sequence(part("from_us"), part("to_us"))))
    inside = touched.join(j.withColumn("piece", part("t_us")), ["stream_key", "piece"]).where("t_us between from_us and to_us")
    both = F.col("n_a").isNotNull() & F.col("n_b").isNotNull()
    counts = inside.groupBy("stream_key", "cycle").agg(F.coalesce(F.sum("n_a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("n_b"), F.lit(0)).alias("n_b"), F.count(F.when(both, 1)).alias("common"), F.count(F.when(both & ~F.col("a").eqNullSafe(F.col("b")), 1)).alias("unequal"))
    all_ = windows.select("stream_key", "cycle").join(counts, ["stream_key", "cycle"], "left").fillna(0, ["n_a", "n_b", "common", "unequal"])
    none = (F.col("n_a") == 0) & (F.col("n_b") == 0)
    fits = (F.col("n_a") + F.col("n_b") - 2 * F.col("common") <= edge) & (F.col("common") > 0) & (F.col("unequal") == 0)
    return all_.withColumn("ok", F.when(none, ~(F.lit(regular) if isinstance(regular, bool) else regular)).otherwise(fits))


def start_spread(samples: DataFrame, skew_us: int) -> DataFrame:
    """One row: the spread of the streams' first stamps and whether it is more than skew_us."""
    firsts = samples.groupBy("stream_key").agg(F.min_by("t_us", "seq").alias("f"))
    return firsts.agg((F.max("f") - F.min("f")).alias("spread_us")).withColumn("too_wide", F.col("spread_us") > skew_us)
