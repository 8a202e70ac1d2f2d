"""Streaming forms: file or Kafka sources, recording, closed bins, rates, and filters that keep their state between batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from oscilla.operators.condition import Chain, Options
from oscilla.operators.markers import marker_text
from oscilla.operators.spectral import power
from oscilla.streaming.ordered import LATE, Grouped, by_group, in_order


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """Samples as they arrive: a micro-batch is a chunk. fmt "kafka" takes its options instead of a path."""
    reader = spark.readStream.format(fmt).options(**options)
    return reader.load() if fmt == "kafka" else reader.schema(schema).load(path)


def read_markers(spark: SparkSession, path: str, schema: str, parts: list[str], **options) -> DataFrame:
    """Marker events with their parts joined into ``label``; those without time are dropped."""
    return read_stream(spark, path, schema, **options).where("t_us is not null").withColumn("label", marker_text(parts))


def record_stream(samples: DataFrame, path: str, checkpoint: str):
    """Appends raw samples, a file a task and batch however many streams there are; the checkpoint makes each batch count once."""
    return samples.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _with_state(samples: DataFrame, keys: list[str], order: list[str], step, out: str, state: str) -> DataFrame:
    """step(pdf in order, state or None) -> (rows out, state) for each key's rows of a batch; one small state a key."""
    call = Grouped(T.StructType([samples.schema[k] for k in keys]), samples.columns, order, step)
    return by_group(samples, keys, call, out, state, GroupStateTimeout.NoTimeout)


def _stream(samples: DataFrame, keys: list[str], time: str, order: list[str], step, out: str, state: str, late: str | None) -> DataFrame:
    """With ``late``, rows in order of event time behind a watermark; without, as they come, and a row that comes before one of an earlier batch is an error."""
    if late is not None:
        return in_order(samples, keys, time, order, lambda rows, held: step(rows.rename(columns={"at_us": time}), held), out, state, late)

    def checked(rows, held):
        newest, own = held[-1] if held else None, tuple(held[:-1]) if held else None
        if newest is not None and int(rows[time].iloc[0]) < newest:
            raise ValueError(f"a row of {time} {int(rows[time].iloc[0])} came after one of {newest}: give late=...")
        told, now = step(rows, own)
        return told, (*now, int(rows[time].iloc[-1]))

    return _with_state(samples, keys, [time, *order], checked, out, f"{state}, newest long")


def closed_bins_stream(samples: DataFrame, width: int, behind: int = 1024) -> DataFrame:
    """(stream_key, channel, bin, lo, hi) of bins as they close, in append mode, in whatever order samples come.

    The state are the bins that are open; those more than ``behind`` bins before the newest are given up, and samples for them are passed over.
    """

    def step(pdf, state):
        held = {b: (lo, hi, n) for b, lo, hi, n in zip(*state[:4], strict=True)} if state else {}
        top, out = state[4] if state else -1, []
        good = pdf.assign(bin=pdf["idx"] // width).groupby("bin")["value"].agg(["min", "max", "size"])
        for b, lo, hi, n in zip(good.index.tolist(), good["min"].tolist(), good["max"].tolist(), good["size"].tolist(), strict=True):
            if b <= top - behind:
                continue
            lo0, hi0, n0 = held.pop(b, (None, None, 0))
            lo, hi = (np.fmin(lo0, lo), np.fmax(hi0, hi)) if lo0 is not None else (lo, hi)
            n += n0
            if n >= width:
                out.append((b, None if np.isnan(lo) else float(lo), None if np.isnan(hi) else float(hi)))
            else:
                held[b] = (None if np.isnan(lo) else float(lo), None if np.isnan(hi) else float(hi), n)
        top = max([top, *good.index.tolist()])
        live = sorted((b, *x) for b, x in held.items() if b > top - behind)
        return pd.DataFrame(out, columns=["bin", "lo", "hi"]).astype({"lo": float, "hi": float}), (*([r[i] for r in live] for i in range(4)), int(top))

    return _with_state(samples, ["stream_key", "channel"], ["idx"], step, "bin long, lo double, hi double", "bins array<long>, lo array<double>, hi array<double>, n array<long>, top long")


def gaps_stream(samples: DataFrame, dt_us: int, min_gap_us: int = 250_000, late: str | None = None) -> DataFrame:
    """The dropouts of detect_gaps() as samples (stream_key, seq, t_us) arrive; the state is the last stamp and what has been counted. late: see _stream()."""

    def step(pdf, state):
        last, number, total = state or (None, 0, 0)
        out = []
        t = pdf["t_us"].to_numpy()
        steps = np.diff(t, prepend=t[0] if last is None else last) - dt_us
        for i in np.flatnonzero(steps > min_gap_us).tolist():
            number, total = number + 1, total + int(steps[i])
            out.append((number, int(t[i]) - total, int(steps[i]), total, int(t[i])))
        return pd.DataFrame(out, columns=["gap_no", "old_us", "gap_us", "cum_us", "resume_real_us"]), (int(t[-1]), number, total)

    return _stream(samples, ["stream_key"], "t_us", ["seq"], step, "gap_no long, old_us long, gap_us long, cum_us long, resume_real_us long", "last long, number long, total long", late)


def measured_rate_stream(chunks: DataFrame, alpha: float = 0.1, late: str | None = None) -> DataFrame:
    """The moving average of measured_rate() as chunks (stream_key, chunk_id, t_us, n) arrive. late: see _stream(); without it, chunks come in order of chunk_id."""

    def step(pdf, state):
        last, rate = state or (None, None)
        out = []
        for k, t, n in zip(pdf["chunk_id"], pdf["t_us"], pdf["n"], strict=True):
            if last is not None and t - last > 1:
                r = n * 1e6 / (t - last)
                rate = r if rate is None else (1 - alpha) * rate + alpha * r
                out.append((k, rate))
            last = int(t)
        return pd.DataFrame(out, columns=["chunk_id", "rate"]), (last, rate)

    return _stream(chunks, ["stream_key"], "chunk_id" if late is None else "t_us", [] if late is None else ["chunk_id"], step, "chunk_id long, rate double", "last long, rate double", late)


def hold_runs_stream(samples: DataFrame, step_us: int, late: str | None = None, points: int = 1 << 16) -> DataFrame:
    """(stream_key, channel, first, last, t0_us, value): runs of up to ``points`` grid points of one value, as samples settle them; a pause is a few rows, however long it is."""

    def step(pdf, state):
        t0, done, value = state or (int(pdf["t_us"].iloc[0]), -1, None)
        t, values = pdf["t_us"].to_numpy(), pdf["value"].to_numpy(float)
        # the last point that each sample leaves to the one before it; what begins at the sample itself is its own
        ends = np.append(done, np.maximum(-(-(t - t0) // step_us) - 1, done))
        held = np.append(np.nan if value is None else value, values[:-1])
        out = [(a, min(a + points, e + 1) - 1, t0, v) for s, e, v in zip(ends[:-1].tolist(), ends[1:].tolist(), held.tolist(), strict=True) for a in range(s + 1, e + 1, points)]
        return pd.DataFrame(out, columns=["first", "last", "t0_us", "value"]), (t0, int(ends[-1]), float(values[-1]))

    return _stream(samples, ["stream_key", "channel"], "t_us", ["seq"], step, "first long, last long, t0_us long, value double", "t0 long, done long, value double", late)


def hold_stream(samples: DataFrame, step_us: int, late: str | None = None) -> DataFrame:
    """(stream_key, channel, idx, t_us, value): the grid points of sample_and_hold() that each batch settles: those before the newest sample, as later ones may still change.

    The grid of a channel begins at its own first sample; samples have t_us, seq, value. Runs are unrolled a part at a time, so a pause of any length takes no memory. late: see _stream().
    """
    runs = hold_runs_stream(samples, step_us, late)
    return runs.select("stream_key", "channel", "t0_us", "value", F.explode(F.sequence("first", "last")).alias("idx")).select("stream_key", "channel", "idx", (F.col("t0_us") + F.col("idx") * step_us).alias("t_us"), "value")


def spectrogram_stream(samples: DataFrame, nfft: int, hop: int, dt_us: int, min_gap_us: int = 250_000, late: str = LATE) -> DataFrame:
    """(stream_key, channel, col, end_idx, t_us, power): the columns of stft_through_gaps() as samples (stream_key, channel, idx, t_us, value) arrive, each once the sample after its window is there.

    The state are the last nfft samples, the end of the next window, and the time of the newest column. Samples of a channel have idx without holes.
    """

    def step(pdf, state):
        tail, head, end, last_t, newest, col = state or ([], int(pdf["idx"].iloc[0]), nfft, None, int(pdf["at_us"].iloc[0]), 0)
        t, n = pdf["at_us"].to_numpy(), len(pdf)
        x = np.concatenate([np.asarray(tail, float), pdf["value"].to_numpy(float)])
        base = head - len(tail)
        # stamps by index: of the sample before these, and of these
        steps = np.diff(t, prepend=t[0] - dt_us if last_t is None else last_t) - dt_us
        jumps = [(head + int(i), int(steps[i])) for i in np.flatnonzero(steps > min_gap_us)]
        out, at = [], head + n
        for gap_at, gap in [*jumps, (None, 0)]:
            # whether a window ends right at a gap shows with the next sample only
            upto = (at if gap_at is None else gap_at) - 1
            ends = np.arange(end, upto + 1, hop)
            if len(ends):
                windows = np.lib.stride_tricks.sliding_window_view(x, nfft)[ends - nfft - base]
                # the time just after a window's last sample
                stamps = np.array([(t[e - 1 - head] if e > head else last_t) + dt_us for e in ends.tolist()])
                for e, s, p in zip(ends.tolist(), stamps.tolist(), power(windows, 1e6 / dt_us), strict=True):
                    out.append((col, e, s, p.tolist()))
                    col, newest = col + 1, s
                end = int(ends[-1]) + hop
            if gap_at is not None:
                # blanks are told at once: that the gap is there is known when its first sample is
                for _ in range(int((gap + nfft * dt_us) / (hop * dt_us) + 0.5)):
                    newest += hop * dt_us
                    out.append((col, None, newest, None))
                    col += 1
                end = gap_at + nfft
        keep = x[max(0, len(x) - nfft) :]
        told = pd.DataFrame(out, columns=["col", "end_idx", "t_us", "power"]).astype({"end_idx": "Int64"})
        return told, (keep.tolist(), int(at), int(end), int(t[-1]), int(newest), int(col))

    own = samples.select("stream_key", "channel", "idx", "t_us", "value")
    return in_order(own, ["stream_key", "channel"], "t_us", ["idx"], step, "col long, end_idx long, t_us long, power array<double>", "tail array<double>, head long, next_end long, last_us long, newest_us long, col long", late)


def real_time_stream(rows: DataFrame, gaps: DataFrame, late: str = LATE) -> DataFrame:
    """rows (stream_key, old_us, seq) with real_us: real_time() against a table of gaps (stream_key, old_us, gap_us) that grows as rows come.

    Gaps and rows of a stream are taken in order of gapless time; so gaps that all waiting rows have passed are folded into one sum,
    which is the state beside the rows and gaps that wait.
    """

    def step(pdf, state):
        total = np.cumsum(pdf["gap_us"].to_numpy()) + (state[0] if state else 0)
        told = pdf.assign(real_us=pdf["at_us"] + total, old_us=pdf["at_us"])[pdf["is_row"].astype(bool).to_numpy()]
        return told[["old_us", "seq", "real_us"]], (int(total[-1]),)

    both = rows.select("stream_key", "old_us", "seq", F.lit(0).cast("long").alias("gap_us"), F.lit(1).alias("is_row")).unionByName(gaps.select("stream_key", "old_us", F.lit(0).cast("long").alias("seq"), "gap_us", F.lit(0).alias("is_row")))
    return in_order(both, ["stream_key"], "old_us", ["is_row", "seq"], step, "old_us long, seq long, real_us long", "total long", late)


def markers_stream(markers: DataFrame, keep: int = 20_000, late: str = LATE) -> DataFrame:
    """(stream_key, seq, t_us, label): markers (stream_key, t_us, label) with lifetime numbers from 1, by time.

    The state is a ring of the newest ``keep`` of a stream, the first time and the lifetime count; numbers go on after eviction. retained() reads it.
    """

    def step(pdf, state):
        times, labels, n, first = state or ([], [], 0, int(pdf["at_us"].iloc[0]))
        seq = np.arange(n + 1, n + 1 + len(pdf))
        told = pd.DataFrame({"seq": seq, "t_us": pdf["at_us"].to_numpy(), "label": pdf["label"].to_numpy()})
        times, labels = [*times, *pdf["at_us"].tolist()][-keep:], [*labels, *pdf["label"].tolist()][-keep:]
        return told, (times, labels, int(seq[-1]), first)

    return in_order(markers.select("stream_key", "t_us", "label"), ["stream_key"], "t_us", ["label"], step, "seq long, t_us long, label string", "times array<long>, labels array<string>, n long, first_us long", late)


def retained(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(stream_key, seq, t_us, label) of the rings that a query over markers_stream() holds in its checkpoint."""
    rings = spark.read.format("statestore").option("path", checkpoint).load().select(F.explode("value.groupState.kept").alias("ring")).select("ring.*")
    own = rings.select("stream_key", "n", F.size("times").alias("held"), F.posexplode(F.arrays_zip("times", "labels")).alias("k", "m"))
    return own.select("stream_key", (F.col("n") - F.col("held") + F.col("k") + 1).alias("seq"), F.col("m.times").alias("t_us"), F.col("m.labels").alias("label"))


#: States of a stream by the microseconds of silence after which it is in them.
SILENCE = {"late": 500_000, "stale": 1_000_000, "gone": 5_000_000}


def presence_stream(announcements: DataFrame, late: str = LATE, beacon_type: str = "control", beacon_prefix: str = "__") -> DataFrame:
    """(stream_key, name, state, t_us): change rows of the catalogue: ``there`` when a stream is first seen or comes back, then late, stale and gone as its silence lasts.

    announcements: stream_key, name, type, source_id, t_us; beacons (by type or id prefix) are hidden. Time is that of events, so what follows from
    silence is told when the watermark, which any stream moves on, has passed it. The state of a stream that is gone holds no more than its last time.
    """

    def changes(name, last, known, upto):
        return [(name, state, last + us) for state, us in SILENCE.items() if us > known and last + us <= upto]

    def step(pdf, state):
        name, last, known = state or (None, None, None)
        out = []
        for t, own in zip(pdf["at_us"].tolist(), pdf["name"].tolist(), strict=True):
            if last is not None:
                told = changes(name, last, known, t - 1)
                out += told
                known = max([known, *(SILENCE[x[1]] for x in told)])
            if last is None or known > 0:
                out.append((own, "there", t))
            name, last, known = own, t, 0
        return pd.DataFrame(out, columns=["name", "state", "t_us"]), (name, int(last), int(known))

    def tick(state, mark):
        name, last, known = state
        told = changes(name, last, known, mark)
        known = max([known, *(SILENCE[x[1]] for x in told)])
        after = [last + us for us in SILENCE.values() if us > known]
        return pd.DataFrame(told, columns=["name", "state", "t_us"]), (name, last, int(known)), after[0] if after else None

    shown = announcements.where((F.lower(F.coalesce("type", F.lit(""))) != beacon_type) & ~F.coalesce("source_id", F.lit("")).startswith(beacon_prefix))
    return in_order(shown.select("stream_key", "t_us", "name"), ["stream_key"], "t_us", ["name"], step, "name string, state string, t_us long", "name string, last_us long, known long", late, tick)


def marker_rate_stream(markers: DataFrame) -> DataFrame:
    """Events a second in sliding windows of 5 s every second; late events are waited for as long as LATE. markers have ts."""
    return markers.withWatermark("ts", LATE).groupBy("stream_key", F.window("ts", "5 seconds", "1 second")).agg((F.count("*") / 5).alias("rate"))


def filter_stream(samples: DataFrame, options: Options) -> DataFrame:
    """The filter chain with six numbers of state a (stream_key, channel); samples of a batch are taken in order of idx."""
    chain = Chain(options)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("idx")
        x = pdf["value"].to_numpy(float)
        y, end = chain.run(x, np.array(state.get[0] if state.exists else [x[0], 0, 0, 0, 0, 0], float))
        state.update((end.tolist(),))
        yield pdf.assign(value=y)[["stream_key", "channel", "idx", "value"]]

    return samples.groupBy("stream_key", "channel").applyInPandasWithState(run, "stream_key string, channel int, idx long, value double", "s array<double>", "append", GroupStateTimeout.NoTimeout)


def epochs_stream(samples: DataFrame, indexed: DataFrame, pre: int, post: int, late: str = LATE, after_us: int | None = None) -> DataFrame:
    """(stream_key, channel, event, values): the rows of epochs(), each as soon as its whole window is there; baseline() and erp() take them.

    samples: stream_key, channel, idx, t_us, value; indexed: stream_key, seq, idx, t_us. An event waits until its stream has come to the end of
    its window, however long that takes; then it has an epoch on each channel that has all samples, and none on others. Events whose window begins before the
    first sample (index 0), or that are at or before ``after_us``, have none. The state are events that wait and samples that these or a later event can need.
    """

    def step(pdf, state):
        channels, idx, values, events, places, head = state or ([], [], [], [], [], -1)
        new = pdf[pdf["is_event"] == 0]
        own = pd.DataFrame({"channel": [*channels, *new["channel"].tolist()], "idx": [*idx, *new["idx"].tolist()], "value": [*values, *new["value"].tolist()]})
        head = max([head, *new["idx"].tolist()])
        marks = pdf[(pdf["is_event"] == 1) & (pdf["idx"] >= pre)]
        waiting = [*zip(events, places, strict=True), *zip(marks["event"].tolist(), marks["idx"].tolist(), strict=True)]
        ready = [x for x in waiting if x[1] + post - 1 <= head]
        waiting = [x for x in waiting if x[1] + post - 1 > head]
        out = []
        if ready and len(own):
            for channel, rows in own.drop_duplicates(["channel", "idx"], keep="last").sort_values("idx").groupby("channel"):
                at, v = rows["idx"].to_numpy(), rows["value"].to_numpy(float)
                for event, place in ready:
                    i, j = np.searchsorted(at, [place - pre, place + post])
                    if j - i == pre + post:
                        out.append((channel, event, v[i:j].tolist()))
        need = min([head - pre - post, *(p - pre for _, p in waiting)])
        own = own[own["idx"] >= need]
        return pd.DataFrame(out, columns=["channel", "event", "values"]), (own["channel"].tolist(), own["idx"].tolist(), own["value"].tolist(), [e for e, _ in waiting], [p for _, p in waiting], int(head))

    s = samples.select("stream_key", "t_us", F.col("channel").cast("long").alias("channel"), "idx", "value", F.lit(0).alias("is_event"), F.lit(0).cast("long").alias("event"))
    e = indexed.select("stream_key", "t_us", F.lit(-1).cast("long").alias("channel"), "idx", F.lit(0.0).alias("value"), F.lit(1).alias("is_event"), F.col("seq").cast("long").alias("event"))
    e = e if after_us is None else e.where(F.col("t_us") > after_us)
    return in_order(s.unionByName(e), ["stream_key"], "t_us", ["is_event", "channel", "idx", "event"], step, "channel long, event long, values array<double>", "channels array<long>, idx array<long>, values array<double>, events array<long>, places array<long>, head long", late)
