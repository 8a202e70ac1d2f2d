"""Streaming queries over the event table, run to the end of what is there, with the SQL of their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from oscilla.operators import events as e
from oscilla.operators import timebase
from oscilla.operators.markers import marker_text
from oscilla.plans.epoch_queries import NF, NH, through_gaps_sql
from oscilla.plans.signal_queries import DAY, GAP_ROWS, GAPS
from oscilla.session import table
from oscilla.sources import recording
from oscilla.sources.views import ARR, EV, HOUR, START_US, STEP_US, arrivals, micros
from oscilla.streaming import live

QUERIES, ORACLE = {}, {}


def _events(spark, d):
    """The event table as a stream of files."""
    schema = table(spark, d, "events").schema
    return live.read_stream(spark, f"{d}/events.parq*", schema)


def _written(spark, df):
    """Runs the stream into a recording in the shared folder and reads that."""
    folder = recording.fresh_folder(spark, "stream")
    live.record_stream(df, f"{folder}/data", f"{folder}/checkpoint").awaitTermination()
    return recording.read_recording(spark, f"{folder}/data")


def s1_stream_samples(spark, d):
    e = _events(spark, d).select(F.col("user_id").cast("string").alias("stream_key"), F.col("event_id").alias("seq"), micros().alias("t_us"), "value")
    return _written(spark, e).select("stream_key", "seq", "t_us", "value")


def s2_stream_markers(spark, d):
    e = _events(spark, d).select(F.col("user_id").cast("string").alias("stream_key"), F.col("event_id").alias("seq"), micros().alias("t_us"), marker_text(["event_type", "props"]).alias("label"))
    return _written(spark, e.where("t_us is not null")).select("stream_key", "seq", "t_us", "label")


def t4_gaps_stream(spark, d):
    e = _events(spark, d).select(F.col("user_id").cast("string").alias("stream_key"), F.col("event_id").alias("seq"), micros().alias("t_us"))
    return _written(spark, live.gaps_stream(e, HOUR, DAY)).select("stream_key", "gap_no", "old_us", "gap_us", "cum_us", "resume_real_us")


QUERIES |= {"t4_gaps_stream": t4_gaps_stream}
ORACLE |= {"t4_gaps_stream": f"with {GAPS} {GAP_ROWS}"}

#: Arrivals come in parts of 150 seconds, the last of which holds all that is left; of the last ten seconds of a part every other sample comes in the next one.
FILE_US, TAIL_US, FILES, LATE_S = 150_000_000, 140_000_000, 4, 30
LATE = f"{LATE_S} seconds"
#: What the watermark has passed in the end.
SETTLED = f"{ARR}, settled as (select * from arr where t_us <= (select max(t_us) from arr) - {LATE_S} * 1000000)"


class Arriving:
    """df (with t_us or old_us) as a ``stream`` that comes part by part, some rows late. A part is a folder, of as many files as its size needs."""

    def __init__(self, spark, df):
        self.spark, self.schema, self.folder = spark, df.schema, recording.fresh_folder(spark, "arrivals")
        at = F.col("t_us" if "t_us" in df.columns else "old_us") - START_US
        late = (F.pmod(at, F.lit(FILE_US)) >= TAIL_US) & (F.pmod(at / STEP_US, F.lit(2)) < 1)
        filed = df.withColumn("file", F.least(F.floor(at / FILE_US) + late.cast("int"), F.lit(FILES - 1)).cast("int"))
        filed.write.partitionBy("file").parquet(f"{self.folder}/all")
        self.stream = live.read_stream(spark, f"{self.folder}/come/*", df.schema)

    def come(self, k: int) -> None:
        """Puts part k where the stream looks."""
        stored = T.StructType([*self.schema.fields, T.StructField("file", T.IntegerType())])
        self.spark.read.schema(stored).parquet(f"{self.folder}/all").where(F.col("file") == k).drop("file").write.parquet(f"{self.folder}/come/{k}")


def _as_it_comes(start, *arriving: Arriving) -> None:
    """Runs a stream once after each part has come, from its checkpoint; so a batch is a part, whatever the number of its files. Only the last run lets the watermark's move be a batch of its own."""
    conf, name = arriving[0].spark.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    try:
        for k in range(FILES):
            for a in arriving:
                a.come(k)
            conf.set(name, str(k == FILES - 1).lower() if before == "true" else before)
            start().awaitTermination()
    finally:
        conf.set(name, before)


def _settled(spark, df, *arriving: Arriving):
    """What the stream df over ``arriving`` has written when all parts have come."""
    folder = recording.fresh_folder(spark, "stream")
    _as_it_comes(lambda: live.record_stream(df, f"{folder}/data", f"{folder}/checkpoint"), *arriving)
    return recording.read_recording(spark, f"{folder}/data")


def d1_bins_stream(spark, d):
    own = Arriving(spark, arrivals(spark, d).select("stream_key", "channel", "idx", "t_us", "value"))
    return _settled(spark, live.closed_bins_stream(own.stream, 32), own).select("stream_key", "bin", "lo", "hi")


def t4_gaps_late_stream(spark, d):
    own = Arriving(spark, arrivals(spark, d).select("stream_key", F.col("idx").alias("seq"), "t_us"))
    return _settled(spark, live.gaps_stream(own.stream, STEP_US, late=LATE), own).select("stream_key", "gap_no", "old_us", "gap_us", "cum_us", "resume_real_us")


def t10_hold_stream(spark, d):
    own = Arriving(spark, arrivals(spark, d).where("not lost").select("stream_key", "channel", F.col("idx").alias("seq"), "t_us", "value"))
    return _settled(spark, live.hold_stream(own.stream, 700_000, LATE), own).select("stream_key", "idx", "t_us", "value")


def q5_spectrogram_stream(spark, d):
    """The spectrogram through dropouts of q7, as samples come."""
    own = Arriving(spark, arrivals(spark, d).select("stream_key", "channel", "idx", "t_us", (F.col("value") / 1000).alias("value")))
    out = _settled(spark, live.spectrogram_stream(own.stream, NF, NH, STEP_US, late=LATE), own)
    return out.select("stream_key", "col", "end_idx", "t_us", F.posexplode_outer("power").alias("k", "power")).withColumn("power", F.round("power", 2))


def t5_real_time_stream(spark, d):
    own = arrivals(spark, d).withColumn("seq", F.col("idx"))
    rows = Arriving(spark, own.select("stream_key", (F.col("idx") * STEP_US + START_US).alias("old_us"), "seq"))
    gaps = Arriving(spark, timebase.detect_gaps(own, STEP_US).select("stream_key", "old_us", "gap_us"))
    return _settled(spark, live.real_time_stream(rows.stream, gaps.stream, LATE), rows, gaps).select("stream_key", "seq", "old_us", "real_us")


#: Samples before and after an event; events are the prices whose tens end with 3.
PRE, POST = 4, 8


def e12_erp_stream(spark, d):
    """The average of the epochs that are whole, over a stream that lacks some samples."""
    own = arrivals(spark, d)
    samples = Arriving(spark, own.where("not lost").select("stream_key", "channel", "idx", "t_us", "value"))
    marks = Arriving(spark, own.where("floor(value / 10) % 10 = 3").select("stream_key", F.col("idx").alias("seq"), "idx", "t_us"))
    ep = _settled(spark, live.epochs_stream(samples.stream, marks.stream, PRE, POST, LATE), samples, marks)
    return e.erp(e.baseline(ep, PRE)).select(F.col("channel").cast("long").alias("channel"), "bin", F.round("mean", 4).alias("mean"), "n")


def s10_presence_stream(spark, d):
    """Announcements of three seconds in nine, with beacons among them."""
    own = Arriving(spark, arrivals(spark, d).where("idx % 9 < 3").select("stream_key", F.concat(F.lit("n"), (F.col("idx") % 2).cast("string")).alias("name"), F.when(F.col("lost"), "Control").otherwise("EEG").alias("type"), F.lit("id").alias("source_id"), "t_us"))
    return _settled(spark, live.presence_stream(own.stream, LATE), own).select("stream_key", "name", "state", "t_us")


def h2_markers_stream(spark, d):
    own = Arriving(spark, arrivals(spark, d).select("stream_key", "t_us", F.floor("value").cast("string").alias("label")))
    return _settled(spark, live.markers_stream(own.stream, 100, LATE), own).select("stream_key", "seq", "t_us", "label")


def h11_retained_stream(spark, d):
    """The ring of the newest 100 that the stream's state holds in the end."""
    own = Arriving(spark, arrivals(spark, d).select("stream_key", "t_us", F.floor("value").cast("string").alias("label")))
    folder = recording.fresh_folder(spark, "stream")
    _as_it_comes(lambda: live.record_stream(live.markers_stream(own.stream, 100, LATE), f"{folder}/data", f"{folder}/checkpoint"), own)
    return live.retained(spark, f"{folder}/checkpoint")


def s3_s5_sink(spark, d):
    """What the sink has written, batch by batch and an empty one after them: samples, first and last stamp by stream."""
    from oscilla.streaming.sink import RecordingSink

    own = arrivals(spark, d).select("stream_key", F.col("idx").alias("seq"), "t_us", "value")
    folder = recording.fresh_folder(spark, "sink")
    out = RecordingSink(f"{folder}/recording")
    arriving = Arriving(spark, own)
    _as_it_comes(lambda: out.start(arriving.stream, f"{folder}/checkpoint"), arriving)
    out.write(own.where("false"), FILES)
    held = out.samples(spark).groupBy("stream_key").agg(F.count("*").alias("held"), F.sum("seq").alias("seqs"))
    return out.footers(spark).join(held, "stream_key")


def d5_tiles(spark, d):
    """Views of 40 pixels over stored tiles, of the middle and of all."""
    from oscilla.sources.tiles import Tiles

    own = arrivals(spark, d).select("stream_key", "channel", "idx", "value")
    tiles = Tiles(f"{recording.fresh_folder(spark, 'tiles')}", 2, 4, 16)
    tiles.add(own)
    return tiles.view(spark, 100, 399, 40).unionByName(tiles.view(spark, 0, 639, 40))


QUERIES |= {f.__name__: f for f in (s3_s5_sink, d5_tiles, d1_bins_stream, t4_gaps_late_stream, t10_hold_stream, q5_spectrogram_stream, t5_real_time_stream, e12_erp_stream, s10_presence_stream, h2_markers_stream, h11_retained_stream)}
GAP_SQL = f"g as (select stream_key, t_us - b - {STEP_US} as gap_us, t_us as resume_real_us, row_number() over w as gap_no from (select *, lag(t_us) over (partition by stream_key order by idx) as b from {{}}) where t_us - b > {STEP_US} + 250000 window w as (partition by stream_key order by t_us)), gs as (select *, cast(sum(gap_us) over (partition by stream_key order by gap_no) as bigint) as cum_us from g)"
NUMBERED = f"with {SETTLED}, m as (select stream_key, t_us, cast(cast(floor(value) as bigint) as varchar) as label from settled), numbered as (select *, row_number() over (partition by stream_key order by t_us, label) as seq, count(*) over (partition by stream_key) as n from m) select stream_key, seq, t_us, label from numbered"
ORACLE |= {
    "d1_bins_stream": f"with {ARR} select stream_key, idx // 32 as bin, min(value) as lo, max(value) as hi from arr group by all having count(*) = 32",
    "t4_gaps_late_stream": f"with {SETTLED}, {GAP_SQL.format('settled')} select stream_key, gap_no, resume_real_us - cum_us as old_us, gap_us, cum_us, resume_real_us from gs",
    "t10_hold_stream": f"with {SETTLED}, own as (select * from settled where not lost), ends as (select stream_key, min(t_us) as t0, max(t_us) as t1 from own group by stream_key), grid as (select stream_key, t0, unnest(range(0, (t1 - t0 - 1) // 700000 + 1)) as idx from ends where t1 > t0) select g.stream_key, g.idx, t0 + g.idx * 700000 as t_us, value from (select *, t0 + idx * 700000 as at from grid) g asof join own o on o.stream_key = g.stream_key and o.t_us <= g.at",
    "q5_spectrogram_stream": f"with {SETTLED}, {through_gaps_sql('settled')} join size on size.stream_key = c.stream_key where c.end_idx is null or c.end_idx < size.n",
    "t5_real_time_stream": f"with {ARR}, {GAP_SQL.format('arr')}, gaps as (select stream_key, resume_real_us - cum_us as old_us, gap_us, cum_us from gs), rows_ as (select stream_key, idx as seq, {START_US} + idx * {STEP_US} as old_us from arr), top as (select greatest((select max(old_us) from rows_), (select max(old_us) from gaps)) - {LATE_S} * 1000000 as w) select r.stream_key, r.seq, r.old_us, r.old_us + coalesce(cum_us, 0) as real_us from rows_ r asof left join gaps g on g.stream_key = r.stream_key and g.old_us <= r.old_us where r.old_us <= (select w from top)",
    "e12_erp_stream": f"with {SETTLED}, own as (select * from settled where not lost), ev_ as (select stream_key, idx as seq, idx from settled where cast(floor(value / 10) as bigint) % 10 = 3 and idx >= {PRE}), cell as (select v.stream_key, seq, o.idx - v.idx + {PRE} as bin, value, count(*) over (partition by v.stream_key, seq) as n from ev_ v join own o on o.stream_key = v.stream_key and o.idx between v.idx - {PRE} and v.idx + {POST} - 1), whole as (select *, avg(value) filter (where bin < {PRE}) over (partition by stream_key, seq) as b from cell where n = {PRE + POST}) select 0::bigint as channel, cast(bin as int) as bin, round(avg(value - b), 4) as mean, count(*) as n from whole group by bin",
    "s10_presence_stream": f"""with {SETTLED}, a as (select stream_key, 'n' || cast(idx % 2 as varchar) as name, t_us, lead(t_us) over (partition by stream_key order by t_us) as next, lag(t_us) over (partition by stream_key order by t_us) as prev from settled where idx % 9 < 3 and not lost), w as (select max(t_us) - {LATE_S} * 1000000 as w from arr where idx % 9 < 3 and not lost), s as (select * from (values ('late', 500000), ('stale', 1000000), ('gone', 5000000)) as x(state, us))
select stream_key, name, state, t_us + us as t_us from a, s, w where t_us <= w.w and t_us + us <= case when next <= w.w then next - 1 else w.w end
union all select stream_key, name, 'there', t_us from a, w where t_us <= w.w and (prev is null or t_us - prev > 500000)""",
    "s3_s5_sink": f"with {ARR} select stream_key, min_by(t_us, idx) as first_us, max_by(t_us, idx) as last_us, count(*) as n, count(*) as held, cast(sum(idx) as bigint) as seqs from arr group by stream_key",
    "d5_tiles": f"with {ARR} " + " union all ".join(f"select stream_key, 0 as channel, {level} as level, idx // {w} as bin, min(value) as lo, max(value) as hi from arr where idx between {a} and {b} group by all having count(*) = {w}" for level, w, a, b in ((0, 2, 100, 399), (1, 8, 0, 639))),
    "h2_markers_stream": NUMBERED,
    "h11_retained_stream": f"{NUMBERED} where seq > n - 100",
}
QUERIES |= {"s1_stream_samples": s1_stream_samples, "s2_stream_markers": s2_stream_markers}
ORACLE |= {
    "s1_stream_samples": f"with {EV} select stream_key, seq, t_us, value from ev",
    "s2_stream_markers": "select cast(user_id as varchar) as stream_key, event_id as seq, epoch_us(ts) as t_us, event_type || case when coalesce(props, '') <> '' then ', ' || props else '' end as label from events",
}
