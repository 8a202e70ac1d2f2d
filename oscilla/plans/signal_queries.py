"""Queries over sample signals, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from oscilla.operators import condition as c
from oscilla.operators import decimate as dm
from oscilla.operators import streams as s
from oscilla.operators import timebase as tb
from oscilla.sources.views import DENSE, EV, HOUR, dense, events

QUERIES, ORACLE = {}, {}
DAY = 24 * HOUR


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def ev(spark, d):
    return events(spark, d).select("stream_key", "seq", "t_us", "value")


# Closed bins of the dense signal.
BINS = f"{DENSE}, bins as (select stream_key, 0 as channel, idx // 32 as bin, min(value) as lo, max(value) as hi from dense group by all having count(*) = 32)"


@query(f"with {BINS} select * from bins")
def d1_minmax(spark, d):
    return dm.minmax(dense(spark, d), 32)


@query(f"with {BINS} select * from bins")
def d4_bin_width(spark, d):
    return dm.minmax(dense(spark, d), dm.bin_width(16.0, 60, 30))


@query(f"with {BINS} select * from bins")
def d1_minmax_chunks(spark, d):
    return dm.minmax_chunks(c.to_chunks(dense(spark, d), 256), 32, 256)


@query(f"with {BINS} select *, 1000000 * cast(stream_key as bigint) + cast(round((bin * 32 + 16) * 2000.0) as bigint) as old_us from bins")
def d2_bin_times(spark, d):
    anchors = dense(spark, d).select("stream_key").distinct().withColumn("t0_us", F.col("stream_key").cast("long") * 1_000_000)
    return dm.bin_times(dm.minmax(dense(spark, d), 32), anchors, 32, 2000.0)


@query(f"with {BINS} select * from bins where bin < 15 qualify bin > max(bin) over (partition by stream_key) - 4")
def d3_bin_tail(spark, d):
    return dm.bin_tail(dm.minmax(dense(spark, d), 32), 4, 15)


@query(f"with {DENSE}, n as (select *, count(*) over (partition by stream_key) > 600 as binned from dense) select stream_key, 0 as channel, binned, idx // 32 as pos, min(value) as lo, max(value) as hi from n where binned group by all having count(*) = 32 union all select stream_key, 0, binned, idx, value, value from n where not binned")
def d5_view(spark, d):
    return dm.view(dense(spark, d), 32, px=200, budget=500)


RASTER = f"""with {BINS}, b as (select *, (bin * 32 + 16) * 1.0 as t from bins), cols as (select distinct stream_key, unnest(range(50)) as px from b),
j as (select cols.stream_key, px, (hi - lo) / 1000.0 as cell, row_number() over (partition by cols.stream_key, px order by abs(b.t - (px + 0.5) * 10.0), b.t) as r from cols join b on b.stream_key = cols.stream_key)
select stream_key, 0 as channel, px, round(cell, 6) as cell from j where r = 1"""


@query(RASTER)
def d6_raster(spark, d):
    bins = dm.minmax(dense(spark, d), 32).withColumn("t", (F.col("bin") * 32 + 16).cast("double"))
    return dm.raster(bins, 0.0, 500.0, 50, 1000.0).withColumn("cell", F.round("cell", 6)).withColumn("px", F.col("px").cast("long"))


@query(f"with {BINS} select stream_key, channel, bin // 4 as bin, min(lo) as lo, max(hi) as hi from bins group by all having count(*) = 4")
def d7_pyramid(spark, d):
    return dm.minmax_pyramid(dm.minmax(dense(spark, d), 32), 4)


@query(f"with {DENSE}, r as (select *, row_number() over (partition by stream_key order by value) - 1 as k, count(*) over (partition by stream_key) as n from dense), a as (select stream_key, 0.5 * (max(case when k = cast(floor(0.9 * n) as bigint) then value end) - max(case when k = cast(floor(0.1 * n) as bigint) then value end)) as amp from r group by stream_key) select stream_key, 0 as channel, round(least(greatest(50000 * 0.4 / greatest(amp, 1e-3), 0.01), 100.0), 6) as gain from a")
def f8_auto_gain(spark, d):
    return dm.auto_gain(dense(spark, d), 50_000.0).withColumn("gain", F.round("gain", 6))


@query(f"with {BINS}, r as (select *, 0.5 * (hi - lo) as half, row_number() over (partition by stream_key order by 0.5 * (hi - lo)) - 1 as k, count(*) over (partition by stream_key) as n from bins) select stream_key, channel, round(least(greatest(50000 * 0.4 / greatest(half, 1e-3), 0.01), 100.0), 6) as gain from r where k = least(n - 1, cast(floor(0.8 * n) as bigint))")
def f8_auto_gain_bins(spark, d):
    return dm.auto_gain_bins(dm.minmax(dense(spark, d), 32), 50_000.0).withColumn("gain", F.round("gain", 6))


@query(f"with {DENSE} select stream_key, idx, value from dense qualify idx > max(idx) over (partition by stream_key) - 100")
def p12_tail(spark, d):
    return s.tail(dense(spark, d), 100).select("stream_key", "idx", "value")


@query(f"with {DENSE} select stream_key, idx, value from dense where idx < cast(stream_key as bigint) % 50")
def p13_as_of(spark, d):
    heads = dense(spark, d).select("stream_key").distinct().withColumn("head", F.col("stream_key").cast("long") % 50)
    return s.as_of(dense(spark, d), heads).select("stream_key", "idx", "value")


@query(f"with {DENSE} select stream_key, idx, round(value * case when cast(stream_key as bigint) % 2 = 0 then 2.0 else 1.0 end / 500.0, 6) as scaled from dense")
def p16_apply_gain(spark, d):
    gains = dense(spark, d).select("stream_key").distinct().where("cast(stream_key as bigint) % 2 = 0").withColumn("gain", F.lit(2.0))
    return s.apply_gain(dense(spark, d), gains, 500.0).select("stream_key", "idx", F.round("scaled", 6).alias("scaled"))


# Time axes of the event streams: an hour is the sample step, more than a day without events is a dropout.
GAPS = f"""{EV}, steps as (select *, t_us - lag(t_us) over (partition by stream_key order by t_us, seq) - {HOUR} as gap_us from ev),
g0 as (select stream_key, t_us as resume_real_us, gap_us from steps where gap_us > {DAY}),
gaps as (select stream_key, row_number() over w as gap_no, resume_real_us - sum(gap_us) over w as old_us, gap_us, sum(gap_us) over w as cum_us, resume_real_us from g0 window w as (partition by stream_key order by resume_real_us))"""
GAP_ROWS = "select stream_key, cast(gap_no as bigint) as gap_no, cast(old_us as bigint) as old_us, gap_us, cast(cum_us as bigint) as cum_us, resume_real_us from gaps"


def gaps(spark, d):
    return tb.detect_gaps(ev(spark, d), HOUR, DAY)


@query(f"with {GAPS} {GAP_ROWS}")
def t4_t8_gaps(spark, d):
    return gaps(spark, d).withColumn("gap_no", F.col("gap_no").cast("long"))


@query(f"with {GAPS} select e.stream_key, e.seq, e.t_us + coalesce(cast((select sum(g.gap_us) from gaps g where g.stream_key = e.stream_key and g.old_us <= e.t_us) as bigint), 0) as real_us from ev e")
def t5_t7_real_time(spark, d):
    return tb.real_time(ev(spark, d), gaps(spark, d), "t_us").select("stream_key", "seq", "real_us")


OLD = f"""with {GAPS}, probe as (select stream_key, seq, t_us - 7200000000 as t_us from ev),
off as (select p.*, coalesce(cast((select sum(g.gap_us) from gaps g where g.stream_key = p.stream_key and g.resume_real_us <= p.t_us) as bigint), 0) as o,
 (select max(g.old_us) from gaps g where g.stream_key = p.stream_key and g.resume_real_us - g.gap_us <= p.t_us and p.t_us < g.resume_real_us) as held from probe p)
"""


def probe(spark, d):
    return ev(spark, d).withColumn("t_us", F.col("t_us") - 2 * HOUR)


@query(OLD + "select stream_key, seq, cast(coalesce(held, t_us - o) as bigint) as old_us from off")
def t6_old_frame_clamp(spark, d):
    return tb.old_frame_time(probe(spark, d), gaps(spark, d)).select("stream_key", "seq", "old_us")


@query(OLD + "select stream_key, seq, t_us - o as old_us from off")
def t6_old_frame_code(spark, d):
    return tb.old_frame_time(probe(spark, d), gaps(spark, d), "code").select("stream_key", "seq", "old_us")


@query(OLD + "select stream_key, seq, case when held is null then t_us - o end as old_us from off")
def t6_old_frame_drop(spark, d):
    return tb.old_frame_time(probe(spark, d), gaps(spark, d), "drop").select("stream_key", "seq", "old_us")


@query(f"with {GAPS}, z as (select stream_key, min(t_us) as t0 from ev group by stream_key), b as (select e.stream_key, e.seq // 32 as bin, z.t0 + cast(round(((e.seq // 32) * 32 + 16) * {HOUR / 16}) as bigint) as old_us from ev e join z using (stream_key)) select distinct stream_key, bin, old_us + coalesce(cast((select sum(g.gap_us) from gaps g where g.stream_key = b.stream_key and g.old_us <= b.old_us) as bigint), 0) as real_us from b")
def d2_bin_times_gaps(spark, d):
    """Bins of sequence numbers, with their centres put through the dropouts."""
    e = ev(spark, d)
    bins = e.select("stream_key", F.expr("seq div 32").alias("bin")).distinct()
    anchors = e.groupBy("stream_key").agg(F.min("t_us").alias("t0_us"))
    return tb.real_time(dm.bin_times(bins, anchors, 32, HOUR / 16), gaps(spark, d)).select("stream_key", "bin", "real_us")


#: Two weeks of the events' month.
VIEW = (1704499200000000, 1705708800000000)


@query(f"""with {GAPS}, hd as (select stream_key, max(t_us) as m, max(t_us) + 100000 * (cast(stream_key as bigint) % 3) as edge from ev group by stream_key),
iv as (select stream_key, resume_real_us - gap_us as a, resume_real_us as b from gaps union all select stream_key, m, edge from hd where edge - m > 50000)
select stream_key, greatest(a, {VIEW[0]}) as start_us, least(b, {VIEW[1]}) as end_us from iv where least(b, {VIEW[1]}) > greatest(a, {VIEW[0]})""")
def t9_view_and_edge(spark, d):
    newest = F.max("t_us")
    edge = ev(spark, d).groupBy("stream_key").agg(newest.alias("newest_us"), (newest + 100_000 * (F.col("stream_key").cast("long") % 3)).alias("edge_us"))
    return tb.missing_intervals(gaps(spark, d), -1, 0, VIEW, edge)


@query(f"""with {GAPS}, iv as (select stream_key, resume_real_us - gap_us as a, resume_real_us + {HOUR} as b from gaps), n as (select *, case when a - max(b) over (partition by stream_key order by a, b rows between unbounded preceding and 1 preceding) <= {2 * DAY} then 0 else 1 end as new from iv),
i as (select *, sum(new) over (partition by stream_key order by a, b rows unbounded preceding) as island from n) select stream_key, min(a) as start_us, max(b) as end_us from i group by stream_key, island""")
def t9_missing_intervals(spark, d):
    return tb.missing_intervals(gaps(spark, d), 2 * DAY, HOUR)


@query(f"with {GAPS} select stream_key, count(*) as n from gaps group by stream_key")
def t14_gap_counts(spark, d):
    return tb.gap_counts(gaps(spark, d))


@query(f"with {EV}, n as (select max(t_us) as now from ev) select stream_key, now - max(t_us) as stale_us, now - max(t_us) > 500000 as late, now - max(t_us) > 1000000 as stale from ev, n group by stream_key, now")
def t11_staleness(spark, d):
    return tb.staleness(ev(spark, d))


ANCHOR = f"with {EV}, ck as (select stream_key, row_number() over (partition by stream_key order by t_us, seq) - 1 as k, t_us, seq from ev)"


@query(ANCHOR + f" select stream_key, t_us + 500 - 4 * {HOUR} as t0_us from ck where k = 4")
def t1_anchor(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("stream_key").orderBy("t_us", "seq")) - 1
    chunks = ev(spark, d).withColumn("k", k).where("k % 5 = 4").select("stream_key", (F.col("k") / 5).cast("long").alias("chunk_id"), F.col("k").alias("last_idx"), F.col("t_us").alias("last_us"), F.lit(500).alias("offset_us"))
    return tb.anchor(chunks, float(HOUR))


@query(f"with {EV}, z as (select *, min(t_us) over (partition by stream_key) as t0 from ev) select stream_key, seq, cast(round((t_us - t0) / {HOUR}.0) as bigint) as idx, t0 + cast(round((t_us - t0) / {HOUR}.0) as bigint) * {HOUR} as grid_us from z")
def t2_index_and_time(spark, d):
    e = ev(spark, d)
    z = e.join(e.groupBy("stream_key").agg(F.min("t_us").alias("t0")), "stream_key").withColumn("idx", tb.time_to_idx(F.col("t_us"), F.col("t0"), float(HOUR)))
    return z.select("stream_key", "seq", "idx", tb.idx_to_time(F.col("idx"), F.col("t0"), float(HOUR)).alias("grid_us"))


@query(f"with {EV}, o as (select stream_key, t_us as collected_us, seq % 1000 as offset_us from ev where seq % 9 = 0) select e.stream_key, e.seq, e.t_us + coalesce((select arg_max(o.offset_us, o.collected_us) from o where o.stream_key = e.stream_key and o.collected_us <= e.t_us), (select arg_min(o.offset_us, o.collected_us) from o where o.stream_key = e.stream_key), 0) as local_us from ev e")
def t3_clock_offset_latest(spark, d):
    o = ev(spark, d).where("seq % 9 = 0").select("stream_key", F.col("t_us").alias("collected_us"), (F.col("seq") % 1000).alias("offset_us"))
    return tb.apply_clock_offset(ev(spark, d), o).select("stream_key", "seq", "local_us")


@query(f"with {EV}, o as (select stream_key, arg_min(seq % 1000, t_us) as f from ev where seq % 9 = 0 group by stream_key) select ev.stream_key, seq, t_us + coalesce(f, 0) as local_us from ev left join o on o.stream_key = ev.stream_key")
def t3_clock_offset_first(spark, d):
    o = ev(spark, d).where("seq % 9 = 0").select("stream_key", F.col("t_us").alias("collected_us"), (F.col("seq") % 1000).alias("offset_us"))
    return tb.apply_clock_offset(ev(spark, d), o, "first").select("stream_key", "seq", "local_us")


HELD = f"""{EV}, sp as (select stream_key, min(t_us) as t0, max(t_us) as t1 from ev group by stream_key),
grid as (select stream_key, unnest(range((t1 - t0) // {HOUR} + 1)) as idx, t0 from sp),
held as (select g.stream_key, g.idx, g.t0 + g.idx * {HOUR} as t_us, e.value from grid g asof join (select stream_key, t_us, arg_max(value, seq) as value from ev group by all) e on g.stream_key = e.stream_key and g.t0 + g.idx * {HOUR} >= e.t_us)"""


def held(spark, d):
    return tb.sample_and_hold(ev(spark, d).withColumn("channel", F.lit(0)), HOUR)


def held_chunks(spark, d, size):
    return tb.hold_chunks(ev(spark, d).withColumn("channel", F.lit(0)), HOUR, size)


@query(f"with {HELD} select stream_key, 0 as channel, idx, t_us, value from held")
def t10_sample_and_hold(spark, d):
    return held(spark, d)


MULTI = f"""{EV}, sp as (select stream_key, min(t_us) as t0, max(t_us) as t1 from ev group by stream_key), ln as (select distinct stream_key, channel from ev),
grid as (select l.stream_key, l.channel, unnest(range((t1 - t0) // {HOUR} + 1)) as idx, t0 from ln l join sp using (stream_key)),
multi as (select g.stream_key, g.channel, g.idx, e.value from grid g asof left join (select stream_key, channel, t_us, arg_max(value, seq) as value from ev group by all) e on g.stream_key = e.stream_key and g.channel = e.channel and g.t0 + g.idx * {HOUR} >= e.t_us)"""


def multi(spark, d):
    return tb.hold_chunks(events(spark, d), HOUR, 128)


@query(f"with {MULTI} select stream_key, channel, idx, round(value - avg(case when channel <> 'error' then value end) over (partition by stream_key, idx), 6) + 0.0 as value from multi")
def f1_common_average(spark, d):
    kinds = events(spark, d).select("stream_key", "channel").distinct().withColumn("type", F.when(F.col("channel") == "error", "EOG").otherwise(" eeg"))
    return c.to_samples(c.common_average_chunks(multi(spark, d), 128, kinds)).withColumn("value", F.round("value", 6) + 0.0)


def dense_channels(spark, d):
    """Two channels of each supplier's prices, the second one longer by ten samples, and a third that begins late."""
    from oscilla.sources.views import dense

    idx, value = F.col("idx"), F.col("value")
    part = lambda name, cond, v: F.when(cond, F.struct(F.lit(name).alias("channel"), v.alias("value")))
    # one pass: three branches with bounds of their own on idx are three windows over the table
    parts = F.array(part("a", idx < 490, value), part("b", idx < 500, value / 3), part("c", (idx >= 70) & (idx < 500), F.lit(1.0) * idx))
    return dense(spark, d).where("idx < 500").select("stream_key", "idx", F.explode(F.array_compact(parts)).alias("p")).select("stream_key", "p.channel", "idx", "p.value")


THREE = f"{DENSE}, three as (select stream_key, 'a' as channel, idx, value from dense where idx < 490 union all select stream_key, 'b', idx, value / 3 from dense where idx < 500 union all select stream_key, 'c', idx, 1.0::double * idx from dense where idx >= 70 and idx < 500)"


@query(f"with {THREE} select stream_key, channel, idx, round(value - avg(case when channel <> 'c' then value end) over (partition by stream_key, idx), 6) + 0.0 as value from three")
def f1_average_chunks(spark, d):
    m = dense_channels(spark, d)
    kinds = m.select("stream_key", "channel").distinct().withColumn("type", F.when(F.col("channel") == "c", "EOG").otherwise("EEG "))
    return c.to_samples(c.common_average_chunks(c.to_chunks(m, 64), 64, kinds)).withColumn("value", F.round("value", 6) + 0.0)


@query(f"with {THREE} select stream_key, channel, idx, round(value - coalesce(max(case when channel = 'c' then value end) over (partition by stream_key, idx), 0.0), 6) + 0.0 as value from three")
def f2_reference_chunks(spark, d):
    return c.to_samples(c.channel_reference_chunks(c.to_chunks(dense_channels(spark, d), 64), 64, "c")).withColumn("value", F.round("value", 6) + 0.0)


@query(f"with {MULTI} select stream_key, channel, idx, round(value - coalesce(max(case when channel = 'click' then value end) over (partition by stream_key, idx), 0.0), 6) + 0.0 as value from multi")
def f2_channel_reference(spark, d):
    return c.to_samples(c.channel_reference_chunks(multi(spark, d), 128, "click")).withColumn("value", F.round("value", 6) + 0.0)


def _num(x: float) -> str:
    return f"({x!r}::double)"


def _chain_sql(high: bool, stages: list[tuple[float, ...]]) -> str:
    """The chain as a recursion over the held grid: one row a sample, with its state."""
    r = math.exp(-2 * math.pi * 0.02)
    hp = f"h.value - p.x1 + {_num(r)} * p.y1" if high else "h.value"
    cols, y = ["h.value as x1", f"{hp} as y1"], f"({hp})"
    for k, (b0, b1, b2, a1, a2) in enumerate(stages):
        out = f"({_num(b0)} * {y} + p.z{k}1)"
        cols += [f"{_num(b1)} * {y} - {_num(a1)} * {out} + p.z{k}2 as z{k}1", f"{_num(b2)} * {y} - {_num(a2)} * {out} as z{k}2"]
        y = out
    first_y, z0 = ("0.0::double" if high else "value"), []
    fy = first_y
    for k, (b0, b1, b2, a1, a2) in enumerate(stages):
        out = f"({_num(b0)} * {fy})"
        z0 += [f"{_num(b1)} * {fy} - {_num(a1)} * {out} as z{k}1", f"{_num(b2)} * {fy} - {_num(a2)} * {out} as z{k}2"]
        fy = out
    return f"""with recursive {HELD}, f as (select stream_key, idx, value as x1, {first_y} as y1{''.join(', ' + z for z in z0)}, {fy} as y from held where idx = 0
 union all select h.stream_key, h.idx, {', '.join(cols)}, {y} as y from f p join held h on h.stream_key = p.stream_key and h.idx = p.idx + 1)
select stream_key, 0 as channel, idx, round(y, 6) + 0.0 as value from f"""


def filtered(spark, d, options):
    out = c.to_samples(c.condition(held_chunks(spark, d, 128), options))
    return out.withColumn("value", F.round("value", 6) + 0.0)


#: The held grid as a signal of one sample a second.
F3, F4, F5 = c.Options(1.0, 0.02), c.Options(1.0, None, 0.2), c.Options(1.0, None, None, 0.1)
F6 = c.Options(1.0, 0.02, 0.2, 0.1)


@query(_chain_sql(True, []))
def f3_highpass(spark, d):
    return filtered(spark, d, F3)


@query(_chain_sql(False, [c.biquad("notch", 0.2, 1.0, 30.0)]))
def f4_notch(spark, d):
    return filtered(spark, d, F4)


@query(_chain_sql(False, [c.biquad("low", 0.1, 1.0, 0.7071)]))
def f5_lowpass(spark, d):
    return filtered(spark, d, F5)


@query(_chain_sql(True, [c.biquad("notch", 0.2, 1.0, 30.0), c.biquad("low", 0.1, 1.0, 0.7071)]))
def f6_chain(spark, d):
    return filtered(spark, d, F6)


@query(_chain_sql(True, []))
def p15_pick_signal(spark, d):
    """The conditioned signal, as a stage is on."""
    raw = held_chunks(spark, d, 128)
    return c.to_samples(s.pick_signal(raw, c.condition(raw, F3), high=True, notch=False)).withColumn("value", F.round("value", 6) + 0.0)


F7 = _chain_sql(True, []).replace("from held where idx = 0", "from held where idx % 256 = 0").replace("h.idx = p.idx + 1)", "h.idx = p.idx + 1 and h.idx % 256 <> 0)")


@query(F7)
def f7_segments(spark, d):
    chunks = held_chunks(spark, d, 128).withColumn("segment", F.expr("chunk_id div 2"))
    return c.to_samples(c.condition(chunks, F3)).withColumn("value", F.round("value", 6) + 0.0)


RATE = f"""with recursive {EV}, k as (select stream_key, t_us, row_number() over (partition by stream_key order by t_us, seq) - 1 as k from ev), r0 as (select stream_key, k, 1 * 1e6 / (t_us - lag(t_us) over (partition by stream_key order by k)) as r, t_us - lag(t_us) over (partition by stream_key order by k) as dt from k),
r as (select stream_key, k as chunk_id, r, row_number() over (partition by stream_key order by k) as i from r0 where dt > 1), y as (select stream_key, chunk_id, i, r as rate from r where i = 1 union all select r.stream_key, r.chunk_id, r.i, (1 - 0.1::double) * y.rate + 0.1::double * r.r from y join r on r.stream_key = y.stream_key and r.i = y.i + 1)"""


def rates(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("stream_key").orderBy("t_us", "seq")) - 1
    return c.measured_rate(ev(spark, d).select("stream_key", k.cast("long").alias("chunk_id"), "t_us", F.lit(1).alias("n")))


@query(RATE + " select stream_key, chunk_id, round(rate, 9) as rate from y")
def t12_measured_rate(spark, d):
    return rates(spark, d).withColumn("rate", F.round("rate", 9))


@query(RATE + ", l as (select stream_key, arg_max(rate, chunk_id) as m from y group by stream_key) select stream_key, round(abs(m - 0.00005) / 0.00005 * 100, 3) as deviation_percent, abs(m - 0.00005) / 0.00005 * 100 > 20 as off from l")
def t13_rate_health(spark, d):
    last = rates(spark, d).groupBy("stream_key").agg(F.max_by("rate", "chunk_id").alias("measured")).withColumn("nominal", F.lit(0.00005))
    return tb.rate_health(last, 20.0).select("stream_key", F.round("deviation_percent", 3).alias("deviation_percent"), "off")
