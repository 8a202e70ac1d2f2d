"""Queries over markers, streams and channels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscilla.operators import markers as m
from oscilla.operators import streams as s
from oscilla.session import table
from oscilla.sources import recording
from oscilla.sources.views import EV, events

QUERIES, ORACLE = {}, {}
DAY = 86_400_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def ev(spark, d):
    return events(spark, d).select("stream_key", "seq", "t_us", "label")


@query(f"with {EV}, props as (select event_id, event_type, props from events) select event_id, event_type || case when coalesce(props, '') <> '' then ', ' || props else '' end as text from props")
def h1_marker_text(spark, d):
    return table(spark, d, "events").select("event_id", m.marker_text(["event_type", "props"]).alias("text"))


@query(f"with {EV} select stream_key, seq, row_number() over (partition by stream_key order by t_us, seq) - 1 as life_seq from ev")
def h2_marker_seq(spark, d):
    return m.marker_seq(ev(spark, d)).select("stream_key", "seq", F.col("life_seq").cast("long").alias("life_seq"))


@query(f"with {EV} select stream_key, min(t_us) as first_us, count(*) as n from ev group by stream_key")
def h2_marker_totals(spark, d):
    return m.marker_totals(ev(spark, d))


DT_SQL = f"with {EV} select stream_key, seq, t_us - lag(t_us) over (partition by stream_key order by t_us, seq) as dt_us, t_us - lag(t_us) over (partition by stream_key, label order by t_us, seq) as dt_same_us from ev"


@query(DT_SQL)
def h3_h4_marker_dt(spark, d):
    return m.marker_dt(ev(spark, d)).select("stream_key", "seq", "dt_us", "dt_same_us")


@query(f"with {EV}, now as (select max(t_us) as n from ev) select stream_key, sum(case when t_us > n - 2 * {DAY} and t_us <= n then 1 else 0 end) / cast(172800 as double) as rate from ev, now group by stream_key")
def h5_marker_rate(spark, d):
    e = ev(spark, d)
    now = e.agg(F.max("t_us")).scalar()
    return m.marker_rate(e, now, 172_800.0)


@query(f"with {EV} select stream_key, seq, t_us from ev qualify row_number() over (partition by stream_key order by t_us desc, seq desc) <= 10")
def h6_marker_tail(spark, d):
    return m.marker_tail(ev(spark, d), 10).select("stream_key", "seq", "t_us")


@query(f"with {EV}, k as (select *, max(t_us) over (partition by stream_key) as newest from ev) select stream_key, seq from k where t_us >= newest - 3 * {DAY}")
def h7_marker_within(spark, d):
    return m.marker_within(ev(spark, d), 3 * 86_400).select("stream_key", "seq")


@query(f"with {EV} select stream_key, seq from ev where t_us > (select min(t_us) from ev) + 20 * {DAY}")
def h7_marker_since(spark, d):
    e = ev(spark, d)
    return m.marker_since(e, e.agg(F.min("t_us")).scalar() + 20 * DAY).select("stream_key", "seq")


@query(f"with {EV} select stream_key, seq, t_us - (select min(t_us) from ev where t_us > 0) as rel_us from ev")
def h8_relative_time(spark, d):
    return m.relative_time(ev(spark, d)).select("stream_key", "seq", "rel_us")


@query(f"with {EV} select stream_key, seq, t_us, label from ev where label in ('click', 'purchase') union all select stream_key, seq, t_us, label from ev where label = 'view'")
def h9_merge_markers(spark, d):
    e = ev(spark, d)
    return m.merge_markers([e.where("label in ('click', 'purchase')"), e.where("label = 'view'")])


ASOF = f"""with {EV}, a as (select min(t_us) + 5 * {DAY} as t from ev), l as (select stream_key, max(struct_pack(t_us := t_us, seq := seq, label := label)) filter (where t_us <= t) as x, min(struct_pack(t_us := t_us, seq := seq, label := label)) as y from ev, a group by stream_key)
select stream_key, coalesce(x, y).t_us as t_us, coalesce(x, y).seq as seq, coalesce(x, y).label as label from l"""


@query(ASOF)
def h10_marker_asof(spark, d):
    e = ev(spark, d)
    return m.marker_asof(e, e.agg(F.min("t_us")).scalar() + 5 * DAY)


@query(f"with {EV}, r as (select *, row_number() over (partition by stream_key order by t_us desc, seq desc) as r, count(*) over (partition by stream_key) as total from ev) select stream_key, count(*) as kept, max(total) as total from r where r <= 40 group by stream_key")
def h11_retain(spark, d):
    e = ev(spark, d)
    kept = m.retain(e, 40).groupBy("stream_key").agg(F.count("*").alias("kept"))
    return kept.join(m.marker_totals(e).select("stream_key", F.col("n").alias("total")), "stream_key")


# Descriptors: suppliers are streams, parts of lineitem channels.
STREAMS = """st as (select case when s_suppkey % 7 = 0 then '' else 'src' || (s_suppkey % 40) end as source_id, s_name as name, 'uid' || s_suppkey as uid,
  case when s_suppkey % 5 = 0 then 'Markers' when s_suppkey % 5 = 1 then ' markers' else 'EEG' end as type, case when s_suppkey % 3 = 0 then 'string' else 'float32' end as channel_format,
  case when s_suppkey % 4 = 0 then 0.0 else 500.0 end as nominal_srate, s_suppkey from supplier)"""


def st(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("src"), (k % 40).cast("string"))).alias("source_id"), F.col("s_name").alias("name"), F.concat(F.lit("uid"), k.cast("string")).alias("uid"),
        F.when(k % 5 == 0, "Markers").when(k % 5 == 1, " markers").otherwise("EEG").alias("type"), F.when(k % 3 == 0, "string").otherwise("float32").alias("channel_format"),
        F.when(k % 4 == 0, 0.0).otherwise(500.0).alias("nominal_srate"), "s_suppkey",
    )


KEY = "case when source_id <> '' then source_id || '|' || name else uid end"


@query(f"with {STREAMS} select s_suppkey, {KEY} as stream_key from st")
def p1_stream_key(spark, d):
    return st(spark, d).select("s_suppkey", s.stream_key().alias("stream_key"))


@query(f"with {STREAMS} select a.k as stream_key, a.uid as uid_a, b.uid as uid_b from (select {KEY} as k, uid from st where s_suppkey % 2 = 0) a join (select {KEY} as k, uid from st where s_suppkey % 3 = 0) b on a.k = b.k")
def p2_match_streams(spark, d):
    x = st(spark, d)
    return s.match_streams(x.where("s_suppkey % 2 = 0"), x.where("s_suppkey % 3 = 0"))


@query(f"with {STREAMS} select s_suppkey, channel_format = 'string' or lower(type) in ('marker', 'markers') as is_marker from st")
def p3_classify(spark, d):
    return s.classify(st(spark, d)).select("s_suppkey", "is_marker")


@query(f"""with {STREAMS}, k as (select *, channel_format = 'string' or lower(type) in ('marker', 'markers') as dflt from st)
select s_suppkey, case when channel_format <> 'string' and (nominal_srate = 0 or dflt) and s_suppkey % 2 = 0 then s_suppkey % 4 = 0 else dflt end as is_marker from k""")
def p4_classify_overrides(spark, d):
    x = st(spark, d).withColumn("stream_key", F.col("uid"))
    o = x.where("s_suppkey % 2 = 0").select("stream_key", (F.col("s_suppkey") % 4 == 0).alias("as_marker"))
    return s.classify(x, o).select("s_suppkey", "is_marker")


CH = """ch as (select cast(c_nationkey as varchar) as stream_key, c_custkey as channel, case when c_custkey % 6 = 0 then '' else c_name end as label,
  case when c_custkey % 3 = 0 then '' else 'microvolts' end as unit, case when c_custkey % 4 = 0 then '' when c_custkey % 4 = 1 then 'EOG' else 'EEG' end as type,
  case when c_custkey % 5 < 2 then c_custkey * 1.5 end as x, case when c_custkey % 5 = 3 then 2.5 end as y from customer)"""


def ch(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.col("c_nationkey").cast("string").alias("stream_key"), k.alias("channel"), F.when(k % 6 == 0, "").otherwise(F.col("c_name")).alias("label"), F.when(k % 3 == 0, "").otherwise("microvolts").alias("unit"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "EOG").otherwise("EEG").alias("type"), F.when(k % 5 < 2, k * 1.5).alias("x"), F.when(k % 5 == 3, 2.5).alias("y"), F.lit(None).cast("double").alias("z"),
    )


@query(f"with {CH} select stream_key, channel, case when label = '' then 'ch ' || channel else label end as label, x is not null or y is not null as placed, case when x is not null or y is not null then cast(coalesce(x, 0) as double) end as x from ch")
def p5_normalise_channels(spark, d):
    return s.normalise_channels(ch(spark, d)).select("stream_key", "channel", "label", F.col("loc").isNotNull().alias("placed"), F.col("loc.x").alias("x"))


@query(f"with {CH} select channel from ch where (lower(label) like '%n_1%' or lower(label) like '%2%') and lower(label) not like '%22%'")
def p6_filter_channels(spark, d):
    return s.filter_channels(ch(spark, d), "N_1, 2,-22").select("channel")


@query(f"with {CH} select channel, label from ch where channel < 16")
def p7_default_channels(spark, d):
    return s.default_channels(ch(spark, d)).select("channel", "label")


@query(f"with {STREAMS} select s_suppkey from st where s_suppkey % 10 = 3")
def p8_select_streams(spark, d):
    x = st(spark, d).withColumn("stream_key", F.col("uid"))
    return s.select_streams(x, x.where("s_suppkey % 10 = 3").select("stream_key")).select("s_suppkey")


@query(f"with {STREAMS} select uid as stream_key from st where s_suppkey % 9 = 4 and s_suppkey % 2 = 1")
def p9_missing_streams(spark, d):
    x = st(spark, d).withColumn("stream_key", F.col("uid"))
    return s.missing_streams(x.where("s_suppkey % 9 = 4").select("stream_key"), x.where("s_suppkey % 2 = 0"))


@query("select event_id from events where event_type in ('click', 'error')")
def p10_label_match(spark, d):
    return table(spark, d, "events").where(s.label_match(F.col("event_type"), "click | error | ")).select("event_id")


@query(f"with {EV}, e as (select *, max(t_us) over (partition by stream_key) - 150000 as edge from ev) select stream_key, seq from e where t_us <= edge and t_us >= edge - 5 * {DAY}")
def p11_slice_recent(spark, d):
    return s.slice_recent(ev(spark, d), 5 * 86_400).select("stream_key", "seq")


@query(f"with {EV} select stream_key, seq from ev where t_us >= (select max(t_us) from ev) - 2 * {DAY}")
def p14_slice_aligned(spark, d):
    return s.slice_aligned(ev(spark, d), 2 * 86_400).select("stream_key", "seq")


@query(f"with {EV}, c as (select stream_key, max(t_us) as seen_us, arg_max(label, (t_us, label)) as name from ev where lower(label) <> 'error' group by stream_key) select * from c where seen_us >= (select max(t_us) from ev) - {DAY}")
def s10_catalogue(spark, d):
    e = ev(spark, d)
    a = e.select("stream_key", F.col("t_us").alias("seen_us"), F.col("label").alias("name"), F.col("label").alias("type"), F.lit("id").alias("source_id"))
    return s.catalogue(a, e.agg(F.max("t_us")).scalar(), DAY, beacon_type="error")


@query("select event_id, 'sub-' || user_id || '/ses-' || event_type || '/{task}_' || strftime(ts, '%Y-%m-%d') as path from events")
def s8_resolve_template(spark, d):
    e = table(spark, d, "events")
    values = {"subject": F.col("user_id").cast("string"), "session": F.col("event_type"), "date": F.date_format("ts", "yyyy-MM-dd")}
    return e.select("event_id", s.resolve_template("sub-{subject}/ses-{session}/{task}_{date}", values).alias("path"))


@query(f"""with k as ({DT_SQL.replace('select stream_key, seq,', 'select stream_key, seq, t_us, label,')})
select stream_key, seq, printf('%.6f', t_us / 1e6) as time, coalesce(printf('%.6f', dt_us / 1e6), '') as dt, coalesce(printf('%.6f', dt_same_us / 1e6), '') as dt_same, '"' || replace(label, '"', '""') || '"' as value from k""")
def s9_marker_lines(spark, d):
    return recording.marker_lines(ev(spark, d)).drop("t_us")


@query(f"with {EV} select stream_key, t_us - (seq % 1000) as collected_us, seq % 1000 as offset_us from ev")
def s4_clock_offsets(spark, d):
    return recording.clock_offsets(ev(spark, d).withColumn("offset_us", F.col("seq") % 1000))


@query(f"with {EV} select stream_key, seq, t_us, value from ev")
def s3_record(spark, d):
    folder = recording.fresh_folder(spark, "recording")
    recording.record(events(spark, d).select("stream_key", "seq", "t_us", "value"), folder)
    return recording.read_recording(spark, folder).select("stream_key", "seq", "t_us", "value")


SUMMARY = f"with {EV} select stream_key, arg_min(t_us, seq) as first_us, arg_max(t_us, seq) as last_us, count(*) as n from ev group by stream_key"


@query(SUMMARY)
def s5_recording_summary(spark, d):
    return recording.recording_summary(ev(spark, d))


@query(f"with {CH} select stream_key, case when type = '' then '(none)' else type end as type, count(*) as n from ch group by all")
def i1_type_counts(spark, d):
    return m.type_counts(ch(spark, d))


@query(f"with {CH} select stream_key, sum(case when x is not null or y is not null then 1 else 0 end)::bigint as placed, count(*) as n from ch group by stream_key")
def i2_position_counts(spark, d):
    return m.position_counts(s.normalise_channels(ch(spark, d)))


@query(f"with {CH} select stream_key, arg_min(unit, channel) as unit from ch where unit <> '' group by stream_key")
def i3_stream_unit(spark, d):
    return m.stream_unit(ch(spark, d))


