"""Queries over spectra, epochs and recordings, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from oscilla.operators import condition as c
from oscilla.operators import events as e
from oscilla.operators import reconcile as r
from oscilla.operators import spectral as q
from oscilla.operators import timebase
from oscilla.plans.signal_queries import GAPS, HELD, gaps, held, held_chunks
from oscilla.sources import recording
from oscilla.sources.views import ARR, EV, HOUR, STEP_US, TRIALS, arrivals, events, trials

QUERIES, ORACLE = {}, {}
PI = repr(math.pi)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def psd_sql(windows: str, keys: str, n: int, fs: float) -> str:
    """CTEs ``w`` (keys, j, x windowed) and ``psd`` (keys, k, power) of a table with keys and list v of n samples, by the plain Fourier sum."""
    return f"""hann as (select j, 0.5::double * (1 - cos(2 * {PI} * j / {n - 1})) as h from (select unnest(range({n})) as j)), norm as (select 2 / ({fs}::double * sum(h * h)) as s from hann),
w as (select {keys}, j, (v[j + 1] - list_avg(v)) * h as x from {windows}, hann),
psd as (select {keys}, k, (power(sum(x * cos(2 * {PI} * k * j / {n})), 2) + power(sum(x * sin(2 * {PI} * k * j / {n})), 2)) * max(s) * case when k in (0, {n // 2}) then 0.5 else 1 end as power
  from w, (select unnest(range({n // 2 + 1})) as k), norm group by {keys}, k)"""


@query(f"with {TRIALS}, {psd_sql('trials', 'trial', 64, 64.0)} select trial, cast(k as int) as k, round(power, 9) as power, k * 1.0::double as hz, round(10 * log10(power + 1e-12), 4) as db from psd")
def q1_q3_psd(spark, d):
    p = trials(spark, d).select("trial", F.posexplode(q.psd("values", 64.0)).alias("k", "power"))
    return p.select("trial", "k", F.round("power", 9).alias("power"), q.psd_freq(F.col("k"), 64.0, 64).alias("hz"), F.round(q.to_db(F.col("power")), 4).alias("db"))


LAST = f"{HELD}, lastn as (select stream_key, list(value order by idx) as v from (select *, max(idx) over (partition by stream_key) as m from held) where idx > m - 128 group by stream_key having count(*) = 128)"


@query(f"with {LAST}, {psd_sql('lastn', 'stream_key', 128, 1.0)} select stream_key, 0 as channel, cast(k as int) as k, round(power, 6) as power from psd")
def q4_spectrum(spark, d):
    return q.spectrum(held(spark, d), 128, 1.0).select("stream_key", "channel", "k", F.round("power", 6).alias("power"))


@query(f"with {LAST}, {psd_sql('lastn', 'stream_key', 128, 1.0)} select stream_key, cast(k as int) as k, k / 128.0::double as hz from psd where k / 128.0 between 0.1 and 0.3")
def q8_band(spark, d):
    return q.band(q.spectrum(held(spark, d), 128, 1.0), 0.1, 0.3, 0.5).select("stream_key", "k", "hz")


FIT = f"with {LAST}, {psd_sql('lastn', 'stream_key', 128, 1.0)}, db as (select stream_key, k, 10 * log10(power + 1e-12) as db from psd where k >= 1), pk as (select stream_key, max(db) as p from db group by stream_key having max(db) > -90)"


@query(FIT + " select db.stream_key, round(least(max(k) / 128.0::double * 1.3, 0.5::double), 6) as fit_hz from db join pk on pk.stream_key = db.stream_key where db > p - 45 group by db.stream_key")
def q9_fit_hz(spark, d):
    return q.fit_hz_spectrum(q.spectrum(held(spark, d), 128, 1.0), 0.5).select("stream_key", F.round("fit_hz", 6).alias("fit_hz"))


NFFT, HOP = 64, 32
WINDOWS = f"""{HELD}, sig as (select stream_key, list(value order by idx) as v, count(*) as n from held group by stream_key),
win as (select stream_key, s + {NFFT} as end_idx, v[s + 1 : s + {NFFT}] as v from (select *, unnest(range(0, n - {NFFT} + 1, {HOP})) as s from sig where n >= {NFFT}))"""


def columns(spark, d):
    return q.stft(held_chunks(spark, d, 128), NFFT, HOP, 1.0)


@query(f"with {WINDOWS}, {psd_sql('win', 'stream_key, end_idx', NFFT, 1.0)} select stream_key, end_idx, cast(k as int) as k, round(power, 4) as power from psd")
def q5_stft(spark, d):
    return columns(spark, d).select("stream_key", "end_idx", F.posexplode("power").alias("k", "power")).select("stream_key", "end_idx", "k", F.round("power", 4).alias("power"))


#: Of the spectrogram through dropouts: a sample a second, and dropouts of a few seconds.
NF, NH = 32, 16


def through_gaps_sql(table: str) -> str:
    """CTEs after ``table`` (arrivals) and the cells of their spectrogram: stream_key, col, end_idx, t_us, k, power."""
    segments = SEGMENTS.replace("{arr}", table)
    return f"""{segments}, {psd_sql('win', 'stream_key, end_idx', NF, 1.0)}
select c.stream_key, col, c.end_idx, t_us, cast(k as int) as k, round(power, 2) as power from cells c left join psd on psd.stream_key = c.stream_key and psd.end_idx = c.end_idx"""


SEGMENTS = f"""stepped as (select *, lag(t_us) over (partition by stream_key order by idx) as before from {{arr}}),
gap as (select stream_key, idx as g, t_us - before - {STEP_US} as len, row_number() over (partition by stream_key order by idx) as no from stepped where t_us - before > {STEP_US} + 250000),
size as (select stream_key, count(*) as n, min(t_us) as t0 from {{arr}} group by stream_key),
seg as (select *, coalesce(lead(g) over (partition by stream_key order by no) - 1, n) as upto from (select stream_key, 0 as no, 0 as g, 0 as len, n, t0 from size union all select gap.stream_key, no, g, len, n, t0 from gap join size on size.stream_key = gap.stream_key)),
real as (select stream_key, no, unnest(range(g + {NF}, upto + 1, {NH})) as end_idx from seg),
blank as (select stream_key, no, unnest(range(1, cast(floor((len + {NF * STEP_US}) / {NH * STEP_US}.0 + 0.5) as bigint) + 1)) as b from seg where no > 0),
timed as (select r.stream_key, r.no, 1 as kind, end_idx as o, end_idx, a.t_us + {STEP_US} as at_us from real r join {{arr}} a on a.stream_key = r.stream_key and a.idx = r.end_idx - 1
  union all select stream_key, no, 0, b, null, null from blank),
line as (select *, row_number() over w - 1 as col, last_value(at_us ignore nulls) over w as newest, coalesce(sum(1 - kind) over w, 0) as blanks from timed window w as (partition by stream_key order by no, kind, o rows between unbounded preceding and current row)),
cells as (select l.stream_key, col, end_idx, coalesce(at_us, coalesce(newest, t0) + (blanks - coalesce(max(case when kind = 1 then blanks end) over (partition by l.stream_key order by col rows between unbounded preceding and current row), 0)) * {NH * STEP_US}) as t_us from line l join size on size.stream_key = l.stream_key),
win as (select c.stream_key, end_idx, list(a.value / 1000 order by a.idx) as v from cells c join {{arr}} a on a.stream_key = c.stream_key and a.idx >= end_idx - {NF} and a.idx < end_idx group by c.stream_key, end_idx)"""


def _stored(df, name: str):
    """df, written to the shared folder and read from it."""
    folder = recording.fresh_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@query(f"with {ARR}, {through_gaps_sql('arr')}")
def q7_stft_gaps(spark, d):
    """Blanks are rows without a bin."""
    own = arrivals(spark, d).withColumn("seq", F.col("idx")).withColumn("value", F.col("value") / 1000)
    # what several branches need is worked out once
    own = _stored(own.select("stream_key", "channel", "idx", "seq", "t_us", "value"), "arrivals")
    anchors = _stored(own.groupBy("stream_key").agg(F.min("t_us").alias("t0_us")), "anchors")
    chunks, gaps_ = _stored(c.to_chunks(own, 128), "chunks"), _stored(timebase.detect_gaps(own, STEP_US), "gaps")
    out = q.stft_through_gaps(chunks, anchors, gaps_, NF, NH, STEP_US, 128)
    return out.select("stream_key", "col", "end_idx", "t_us", F.posexplode_outer("power").alias("k", "power")).withColumn("power", F.round("power", 2))


WIDE = q.stft_hop(0.001, NFFT)


@query(f"""with {HELD}, sig as (select stream_key, count(*) as n from held group by stream_key) select stream_key, unnest(range(0, n - {NFFT} + 1, 30)) + {NFFT} as end_idx from sig where n >= {NFFT}""")
def q6_hop(spark, d):
    return q.stft(held_chunks(spark, d, 128), NFFT, WIDE, 1000.0).select("stream_key", "end_idx")


@query(f"""with {WINDOWS}, {psd_sql('win', 'stream_key, end_idx', NFFT, 1.0)}, db as (select stream_key, end_idx, k, 10 * log10(power + 1e-12) as db from psd), pk as (select stream_key, max(db) as p from db group by stream_key having max(db) > -120),
lit as (select db.stream_key, end_idx, count(*) filter (where db > p - 45) as n, max(k) filter (where db > p - 45) as top from db join pk on pk.stream_key = db.stream_key group by all),
sh as (select stream_key, count(*) as cols, count(*) filter (where n > 8) as wides, max(top) as every_, max(top) filter (where n <= 8) as narrow from lit group by stream_key)
select stream_key, round(least(0.5::double * coalesce(case when wides * 5 < cols then narrow else every_ end, 0) / 32 * 1.2, 0.5::double), 6) as fit_hz from sh""")
def q10_fit_hz_stft(spark, d):
    cells = columns(spark, d).select("stream_key", F.col("end_idx").alias("col"), F.posexplode("power").alias("k", "power"))
    return q.fit_hz_stft(cells, NFFT // 2 + 1, 0.5).select("stream_key", F.round("fit_hz", 6).alias("fit_hz"))


# Epochs around purchases on the held grid; 6 samples before and 18 after.
PRE, POST = e.epoch_shape(6000, 18000, 1.0)
CHUNK = 128
EPOCHS = f"""{HELD}, tr as (select e.stream_key, e.seq as event, cast(round((e.t_us - sp.t0) / {HOUR}.0) as bigint) as idx, sp.t0, sp.t1 from ev e join sp on sp.stream_key = e.stream_key where e.label in ('purchase', 'login')),
ok as (select * from tr where idx >= {PRE} and idx + {POST} <= (t1 - t0) // {HOUR} + 1),
ep as (select o.stream_key, o.event, cast(h.idx - o.idx + {PRE} as int) as bin, h.value as v from ok o join held h on h.stream_key = o.stream_key and h.idx between o.idx - {PRE} and o.idx + {POST} - 1)"""
BASED = f"{EPOCHS}, bs as (select *, v - avg(case when bin < {PRE} then v end) over (partition by stream_key, event) as b from ep)"


def index(spark, d):
    ev = events(spark, d)
    anchors = ev.groupBy("stream_key").agg(F.min("t_us").alias("t0_us"))
    return e.event_index(e.triggers(ev.select("stream_key", "seq", "t_us", "label"), "purchase | login"), anchors, None, float(HOUR))


def cut(spark, d):
    return e.epochs(held_chunks(spark, d, CHUNK), index(spark, d), PRE, POST, CHUNK)


def cells(ep):
    return ep.select("stream_key", "channel", "event", F.posexplode("values").alias("bin", "v"))


@query(f"with {EPOCHS} select stream_key, event as seq, idx from tr")
def e1_e2_event_index(spark, d):
    return index(spark, d).select("stream_key", "seq", "idx")


GAP_INDEX = f"""{GAPS}, tr as (select stream_key, seq, t_us, min(t_us) over (partition by stream_key) as t0, label from ev),
pl as (select t.*, coalesce(cast((select sum(g.gap_us) from gaps g where g.stream_key = t.stream_key and g.resume_real_us <= t.t_us - {2 * HOUR}) as bigint), 0) as o,
  (select max(g.old_us) from gaps g where g.stream_key = t.stream_key and g.resume_real_us - g.gap_us <= t.t_us - {2 * HOUR} and t.t_us - {2 * HOUR} < g.resume_real_us) as held from tr t where label in ('purchase', 'login'))"""


@query(f"with {GAP_INDEX} select stream_key, seq, cast(round((coalesce(held, t_us - {2 * HOUR} - o) - t0) / {HOUR}.0) as bigint) as idx from pl")
def e2_event_index_gaps(spark, d):
    """Triggers two hours early, so that some lie within dropouts."""
    ev = events(spark, d)
    anchors = ev.groupBy("stream_key").agg(F.min("t_us").alias("t0_us"))
    trig = e.triggers(ev.select("stream_key", "seq", "t_us", "label"), "purchase | login").withColumn("t_us", F.col("t_us") - 2 * HOUR)
    return e.event_index(trig, anchors, gaps(spark, d), float(HOUR)).select("stream_key", "seq", "idx")


@query(f"with {EPOCHS} select stream_key, event, count(*) as n, min((bin - {PRE}) * 1000.0::double) as first_ms, max((bin - {PRE}) * 1000.0::double) as last_ms from ep group by all")
def e3_epoch_shape(spark, d):
    return cells(cut(spark, d)).withColumn("ms", e.epoch_axis(F.col("bin"), PRE, 1000.0)).groupBy("stream_key", "event").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


@query(f"with {EPOCHS} select * from ep")
def e4_epochs(spark, d):
    return cells(cut(spark, d)).select("stream_key", "event", "bin", "v")


@query(f"with {BASED} select stream_key, event, bin, round(b, 6) + 0.0 as v from bs")
def e5_baseline(spark, d):
    return cells(e.baseline(cut(spark, d), PRE)).select("stream_key", "event", "bin", (F.round("v", 6) + 0.0).alias("v"))


@query(f"with {BASED} select 0 as channel, bin, round(avg(b), 6) + 0.0 as mean, count(*) as n from bs group by bin")
def e6_erp(spark, d):
    return e.erp(e.baseline(cut(spark, d), PRE)).withColumn("mean", F.round("mean", 6) + 0.0)


@query(f"with {TRIALS} select label as channel, cast(j as int) as bin, round(avg(v[j + 1]), 6) + 0.0 as mean, count(*) as n from trials, (select unnest(range(64)) as j) where label < 4 group by all")
def e7_erp_channels(spark, d):
    ep = trials(spark, d).select(F.lit("t").alias("stream_key"), F.col("label").alias("channel"), F.col("trial").alias("event"), "values")
    return e.erp(ep, 4).withColumn("mean", F.round("mean", 6) + 0.0)


@query(f"with {EPOCHS}, x as (select distinct stream_key, event from ep), t as (select stream_key, event from x qualify row_number() over (order by event desc, stream_key) <= 60) select ep.* from ep join t using (stream_key, event)")
def e8_recent_epochs(spark, d):
    return cells(e.recent_epochs(cut(spark, d), 60)).select("stream_key", "event", "bin", "v")


@query(f"with {BASED}, k as (select abs(b) as a, row_number() over (order by abs(b)) - 1 as k, count(*) over () as n from bs) select 0 as channel, round(greatest(a * 1.2, 1e-3), 6) as half from k where k = cast(floor(0.95 * (n - 1)) as bigint)")
def e9_robust_range(spark, d):
    return e.robust_range(cells(e.baseline(cut(spark, d), PRE))).withColumn("half", F.round("half", 6))


@query(f"with {BASED}, a as (select bin, avg(b) as m from bs group by bin) select 0 as channel, list(round(m, 5) + 0.0 order by bin) as row from a")
def e10_erp_matrix(spark, d):
    m = e.erp_matrix(e.erp(e.baseline(cut(spark, d), PRE)))
    return m.select("channel", F.transform("row", lambda x: F.round(x, 5) + 0.0).alias("row"))


@query(f"with {EPOCHS} select stream_key, event, list(v order by bin) as row from ep group by all")
def e11_trial_matrix(spark, d):
    return e.trial_matrix(cut(spark, d), 0)


# Two recordings of the events: b lacks some, and some of its values and stamps differ.
AB = f"{EV}, a as (select stream_key, seq, t_us, value from ev where seq % 997 <> 0 and cast(stream_key as int) % 50 <> 3), b as (select stream_key, seq, case when seq % 401 = 0 then t_us - 40000000000 else t_us end as t_us, case when seq % 307 = 0 then value + 1 else value end as value from ev where seq % 991 <> 0 and cast(stream_key as int) % 50 <> 7)"


def ab(spark, d):
    ev = events(spark, d).select("stream_key", "seq", "t_us", "value")
    user, s = F.col("stream_key").cast("int"), F.col("seq")
    a = ev.where((s % 997 != 0) & (user % 50 != 3))
    b = ev.where((s % 991 != 0) & (user % 50 != 7))
    return a, b.select("stream_key", "seq", F.when(s % 401 == 0, F.col("t_us") - 40_000_000_000).otherwise(F.col("t_us")).alias("t_us"), F.when(s % 307 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("value"))


@query(f"with {AB}, x as (select distinct stream_key from a), y as (select distinct stream_key from b) select coalesce(x.stream_key, y.stream_key) as stream_key, case when x.stream_key is null then 'b' else 'a' end as side from x full join y on x.stream_key = y.stream_key where x.stream_key is null or y.stream_key is null")
def r1_stream_diff(spark, d):
    return r.stream_diff(*ab(spark, d))


TAGS = """pl as (select event_type, cast(user_id as varchar) as file, event_id % 3 as sid, row_number() over (partition by user_id order by event_id) as k, row_number() over (partition by user_id, event_id % 3 order by event_id) as a, row_number() over (partition by user_id, event_id % 3 order by event_id desc) as z from events),
tn as (select file, sid, case when k = 1 then 1 when a = 1 then 2 when z = 1 then 6 when event_type = 'click' then 3 when event_type = 'view' then 4 else 5 end as tag from pl), tg as (select file, case when tag not in (1, 5) then sid end as stream_id, tag from tn)"""


def tags(spark, d):
    """Events stand for the chunks of a file a user: the first is its header, the first and last of a stream are that one's header and footer."""
    from pyspark.sql import Window

    ev, s = events(spark, d), F.col("seq")
    ev = ev.withColumn("sid", s % 3)
    place = lambda keys, order: F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    tag = F.when(place(["stream_key"], s) == 1, 1).when(place(["stream_key", "sid"], s) == 1, 2).when(place(["stream_key", "sid"], s.desc()) == 1, 6)
    ev = ev.withColumn("tag", tag.when(F.col("label") == "click", 3).when(F.col("label") == "view", 4).otherwise(5))
    return ev.select(F.col("stream_key").alias("file"), F.when(~F.col("tag").isin(1, 5), F.col("sid")).alias("stream_id"), "tag")


@query(f"with {TAGS} select file, stream_id, tag, count(*) as n from tg group by all")
def s7_chunk_inventory(spark, d):
    return r.chunk_inventory(tags(spark, d))


@query(f"with {TAGS}, h as (select file, count(*) filter (where tag = 1) as heads from tg group by file), p as (select file, stream_id, count(*) filter (where tag = 2) as a, count(*) filter (where tag = 3) as b, count(*) filter (where tag = 4) as c, count(*) filter (where tag = 6) as e from tg where stream_id is not null group by all) select p.file, stream_id, heads = 1 and a = 1 and e = 1 and c >= 1 and b >= 1 as ok from p join h on p.file = h.file")
def r2_check_structure(spark, d):
    return r.check_structure(r.chunk_inventory(tags(spark, d)))


@query("with a as (select c_custkey, c_name, c_nationkey from customer), b as (select c_custkey, case when c_custkey % 4 = 0 then lower(c_name) else c_name end as c_name, case when c_custkey % 6 = 0 then null else c_nationkey end as c_nationkey from customer where c_custkey <> 9), j as (select coalesce(a.c_custkey, b.c_custkey) as c_custkey, a.c_name as an, b.c_name as bn, a.c_nationkey as ar, b.c_nationkey as br from a full join b on a.c_custkey = b.c_custkey) select c_custkey, 'c_name' as field from j where an is distinct from bn union all select c_custkey, 'c_nationkey' from j where ar is distinct from br")
def r3_metadata_diff(spark, d):
    n = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    k = F.col("c_custkey")
    b = n.where(k != 9).select("c_custkey", F.when(k % 4 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("c_name"), F.when(k % 6 != 0, F.col("c_nationkey")).alias("c_nationkey"))
    return r.metadata_diff(n, b, ["c_custkey"])


@query(f"""with {AB}, c as (select stream_key, case when seq % 13 = 0 then seq + 10000000 else seq end as seq, t_us from a), sc as (select stream_key, t_us, lead(t_us) over (partition by stream_key order by seq) as next_us from c), sa as (select stream_key, t_us, lead(t_us) over (partition by stream_key order by seq) as next_us from a) select distinct sc.* from sc where next_us < t_us and (stream_key, t_us, next_us) not in (select stream_key, t_us, next_us from sa where next_us < t_us) and (stream_key, t_us) in (select stream_key, t_us from a) and (stream_key, next_us) in (select stream_key, t_us from a)""")
def r4_backsteps(spark, d):
    a, _ = ab(spark, d)
    late = a.withColumn("seq", F.when(F.col("seq") % 13 == 0, F.col("seq") + 10_000_000).otherwise(F.col("seq")))
    return r.backsteps(late, a).distinct()


@query(f"with {EV}, x as (select stream_key, seq, case when seq % 100 = 7 then 'nan'::double when seq % 100 = 9 then '-inf'::double else value end as value from ev) select stream_key, seq from x where isnan(value) or isinf(value)")
def r5_nonfinite(spark, d):
    ev = events(spark, d)
    s = F.col("seq") % 100
    return r.nonfinite(ev.withColumn("value", F.when(s == 7, float("nan")).when(s == 9, float("-inf")).otherwise(F.col("value")))).select("stream_key", "seq")


DAYS = 3 * 24 * HOUR
WIN = f"""{AB}, sa as (select stream_key, arg_min(t_us, seq) as f, arg_max(t_us, seq) as l from a group by stream_key), sb as (select stream_key, arg_min(t_us, seq) as f, arg_max(t_us, seq) as l from b group by stream_key),
ov as (select stream_key, greatest(sa.f, sb.f) + 50000 as lo, least(sa.l, sb.l) - 50000 as hi, least(sa.f, sb.f) as f, greatest(sa.l, sb.l) as l from sa join sb using (stream_key)),
win as (select stream_key, cast(c as int) as cycle, lo + c * ((hi - lo) // 4) as from_us, least(lo + c * ((hi - lo) // 4) + {DAYS}, lo + (c + 1) * ((hi - lo) // 4)) as to_us from ov, (select unnest(range(4)) as c) where hi - lo >= {DAYS} union all select stream_key, 0, f, l from ov where hi - lo < {DAYS})"""


def windows(spark, d):
    return r.comparison_windows(*ab(spark, d), DAYS, 4)


@query(f"with {WIN} select * from win")
def r7_comparison_windows(spark, d):
    return windows(spark, d)


@query(f"""with {WIN}, ca as (select w.stream_key, cycle, count(*) as n from win w join a on a.stream_key = w.stream_key and a.t_us between from_us and to_us group by all), cb as (select w.stream_key, cycle, count(*) as n from win w join b on b.stream_key = w.stream_key and b.t_us between from_us and to_us group by all),
fa as (select stream_key, t_us, arg_min(value, seq) as v from a group by all), fb as (select stream_key, t_us, arg_min(value, seq) as v from b group by all),
m as (select w.stream_key, cycle, count(*) as common, count(*) filter (where fa.v is distinct from fb.v) as unequal from win w join fa on fa.stream_key = w.stream_key and fa.t_us between from_us and to_us join fb on fb.stream_key = fa.stream_key and fb.t_us = fa.t_us group by all)
select win.stream_key, win.cycle, coalesce(ca.n, 0) as n_a, coalesce(cb.n, 0) as n_b, coalesce(common, 0) as common, coalesce(unequal, 0) as unequal,
 case when coalesce(ca.n, 0) + coalesce(cb.n, 0) = 0 then false else coalesce(ca.n, 0) + coalesce(cb.n, 0) - 2 * coalesce(common, 0) <= 1 and coalesce(common, 0) > 0 and coalesce(unequal, 0) = 0 end as ok
from win left join ca using (stream_key, cycle) left join cb using (stream_key, cycle) left join m using (stream_key, cycle)""")
def r6_compare_windows(spark, d):
    return r.compare_windows(*ab(spark, d), windows(spark, d), edge=1)


@query(f"with {AB}, f as (select stream_key, arg_min(t_us, seq) as f from a group by stream_key) select max(f) - min(f) as spread_us, max(f) - min(f) > {DAYS} as too_wide from f")
def r8_start_spread(spark, d):
    return r.start_spread(ab(spark, d)[0], DAYS)

