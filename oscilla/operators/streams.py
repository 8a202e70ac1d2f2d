"""Stream identity, classification, selection and windows of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_key(source_id: str = "source_id", name: str = "name", uid: str = "uid") -> Column:
    return F.when(F.coalesce(F.col(source_id), F.lit("")) != "", F.concat(F.col(source_id), F.lit("|"), F.coalesce(F.col(name), F.lit("")))).otherwise(F.col(uid))


def match_streams(a: DataFrame, b: DataFrame) -> DataFrame:
    """(stream_key, uid_a, uid_b) of streams of one key."""
    return a.select(stream_key().alias("stream_key"), F.col("uid").alias("uid_a")).join(b.select(stream_key().alias("stream_key"), F.col("uid").alias("uid_b")), "stream_key")


def classify(streams: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds is_marker: string format, or type marker(s). overrides (stream_key, as_marker) flip irregular or default-marker streams, but never make data of strings."""
    text = F.lower("channel_format") == "string"
    default = text | F.lower(F.coalesce(F.col("type"), F.lit(""))).isin("marker", "markers")
    if overrides is None:
        return streams.withColumn("is_marker", default)
    joined = streams.join(overrides, "stream_key", "left")
    free = ~text & ((F.col("nominal_srate") == 0) | default)
    return joined.withColumn("is_marker", F.when(free & F.col("as_marker").isNotNull(), F.col("as_marker")).otherwise(default)).drop("as_marker")


def normalise_channels(raw: DataFrame) -> DataFrame:
    """Empty labels become "ch N"; loc is there if any of x, y, z is."""
    placed = F.coalesce(F.col("x"), F.col("y"), F.col("z")).isNotNull()
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.concat(F.lit("ch "), F.col("channel").cast("string")))
    return raw.withColumn("label", label).withColumn("loc", F.when(placed, F.struct(zero("x"), zero("y"), zero("z")))).drop("x", "y", "z")


def name_matches(column: Column, pattern: str) -> Column:
    """Comma list of terms to include, "-term" to exclude; case-insensitive substrings; blank takes all."""
    terms = [t.strip().lower() for t in pattern.split(",") if t.strip()]
    has = lambda t: F.lower(column).contains(t)
    wanted = [has(t) for t in terms if not t.startswith("-")]
    out = F.lit(not wanted)
    for w in wanted:
        out = out | w
    for t in terms:
        if len(t) > 1 and t.startswith("-"):
            out = out & ~has(t[1:])
    return out


def filter_channels(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(name_matches(F.col("label"), pattern))


def default_channels(df: DataFrame, n: int = 16) -> DataFrame:
    return df.where(F.col("channel") < n)


def select_streams(catalogue: DataFrame, wanted: DataFrame | str) -> DataFrame:
    """All or nothing: "all", "none", or a table of keys of which none may be unknown."""
    if isinstance(wanted, str):
        return catalogue if wanted == "all" else catalogue.limit(0)
    unknown = wanted.join(catalogue, "stream_key", "left_anti")
    if not unknown.isEmpty():
        raise ValueError(f"unknown stream {unknown.first().stream_key}")
    return catalogue.join(wanted.select("stream_key").distinct(), "stream_key", "left_semi")


def missing_streams(required: DataFrame, catalogue: DataFrame) -> DataFrame:
    return required.join(catalogue, "stream_key", "left_anti")


def label_match(column: Column, expression: str) -> Column:
    """Exact match with any of the labels split at " | "; blank, or separators only, matches all."""
    labels = [x.strip() for x in f" {expression} ".replace(" | ", "\0 ").replace(" | ", "\0 ").split("\0")]
    labels = [x for x in labels if x and x != "|"] if " | " in f" {expression} " else [x for x in labels if x]
    return column.isin(labels) if labels else F.lit(True)


def slice_recent(samples: DataFrame, seconds: float, lag: float = 0.15) -> DataFrame:
    """Each stream's samples in [edge - seconds, edge], edge being its newest less ``lag``."""
    edge = samples.groupBy("stream_key").agg((F.max("t_us") - int(lag * 1_000_000)).alias("edge"))
    return samples.join(edge, "stream_key").where((F.col("t_us") <= F.col("edge")) & (F.col("t_us") >= F.col("edge") - int(seconds * 1_000_000))).drop("edge")


def slice_aligned(samples: DataFrame, seconds: float) -> DataFrame:
    """One window for all streams, ending at the newest sample of all."""
    edge = samples.agg(F.max("t_us").alias("edge"))  # one row
    return samples.join(F.broadcast(edge)).where(F.col("t_us") >= F.col("edge") - int(seconds * 1_000_000)).drop("edge")


def tail(samples: DataFrame, n: int, heads: DataFrame | None = None) -> DataFrame:
    """The last n samples of each stream before its head; heads (stream_key, head) default to the end. No sort."""
    if heads is None:
        heads = samples.groupBy("stream_key").agg((F.max("idx") + 1).alias("head"))
    return samples.join(heads, "stream_key").where((F.col("idx") < F.col("head")) & (F.col("idx") >= F.col("head") - n)).drop("head")


def as_of(samples: DataFrame, heads: DataFrame) -> DataFrame:
    """What was there when the stream's head index was ``head``."""
    return samples.join(heads, "stream_key").where(F.col("idx") < F.col("head")).drop("head")


def pick_signal(raw: DataFrame, conditioned: DataFrame, **stages: bool) -> DataFrame:
    """The conditioned signal if any stage is on; chosen when the plan is made."""
    return conditioned if any(stages.values()) else raw


def apply_gain(samples: DataFrame, gains: DataFrame, full_scale: float) -> DataFrame:
    """Adds scaled: value * gain / full_scale; channels without a gain have 1."""
    keys = [c for c in ("stream_key", "channel") if c in gains.columns]
    return samples.join(gains, keys, "left").withColumn("scaled", F.col("value") * F.coalesce("gain", F.lit(1.0)) / full_scale).drop("gain")


def catalogue(announcements: DataFrame, now_us: int | Column, ttl_us: int = 5_000_000, beacon_type: str = "control", beacon_prefix: str = "__") -> DataFrame:
    """The last announcement of each stream seen within ttl; beacons (by type or id prefix) are hidden."""
    shown = announcements.where((F.lower(F.coalesce(F.col("type"), F.lit(""))) != beacon_type) & ~F.coalesce(F.col("source_id"), F.lit("")).startswith(beacon_prefix))
    last = shown.groupBy("stream_key").agg(F.max("seen_us").alias("seen_us"), F.max_by("name", F.struct("seen_us", "name")).alias("name"))
    return last.where(F.col("seen_us") >= (now_us if isinstance(now_us, Column) else F.lit(now_us)) - ttl_us)


def resolve_template(template: str, values: dict[str, Column]) -> Column:
    """The template with {subject} and so on replaced by columns; unknown keys stay as they are."""
    out = F.lit(template)
    for key, column in values.items():
        out = F.replace(out, F.lit(f"{{{key}}}"), column)
    return out
