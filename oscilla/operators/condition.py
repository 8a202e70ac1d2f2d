"""Re-referencing and recursive filters that run in parallel over time.

The chain high-pass, notch, low-pass is linear in a state of six numbers. Each run of chunks gives the state that it ends
in when it begins from zero; those states are folded along each channel (six numbers a run), and each run is then filtered
from its true start. chunks: stream_key, channel, chunk_id, start_idx, values ARRAY<DOUBLE>.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timebase import previous


@dataclass(frozen=True)
class Options:
    fs: float
    high: float | None = 0.5
    notch: float | None = None
    low: float | None = None
    q: float = 30.0

    def __post_init__(self):
        if any(x is not None and x <= 0 for x in (self.fs, self.high, self.notch, self.low)):
            raise ValueError("frequencies must be above 0; None switches a stage off")


def biquad(kind: str, f: float | None, fs: float, q: float) -> tuple[float, ...]:
    """b0, b1, b2, a1, a2 of the audio cookbook's notch or low-pass; identity if off or a notch at Nyquist or above."""
    if f is None or (kind == "notch" and f >= fs / 2):
        return 1.0, 0.0, 0.0, 0.0, 0.0
    w = 2 * math.pi * (min(f, 0.45 * fs) if kind == "low" else f) / fs
    c, alpha = math.cos(w), math.sin(w) / (2 * q)
    b = (1.0, -2 * c, 1.0) if kind == "notch" else ((1 - c) / 2, 1 - c, (1 - c) / 2)
    return tuple(x / (1 + alpha) for x in (*b, -2 * c, 1 - alpha))


class Chain:
    """The chain as a linear system: state x1, y1 and the two biquads' z1, z2. Blocks of a signal are matrix products."""

    BLOCK = 128

    def __init__(self, o: Options):
        self.high = o.high is not None
        self.r = math.exp(-2 * math.pi * o.high / o.fs) if self.high else 0.0
        self.stages = biquad("notch", o.notch, o.fs, o.q), biquad("low", o.low, o.fs, 0.7071)
        # what a unit at each place of a block, and a unit of each state number, do to the block's output and to its end
        self.out_of_input, self.end_of_input = self.walk(np.eye(self.BLOCK), np.zeros((self.BLOCK, 6)))
        self.out_of_state, self.end_of_state = self.walk(np.zeros((6, self.BLOCK)), np.eye(6))
        self.step = self.walk(np.zeros((6, 1)), np.eye(6))[1].T
        self.powers = [np.eye(6)]
        for _ in range(self.BLOCK - 1):
            self.powers.append(self.powers[-1] @ self.step.T)

    def walk(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample by sample; rows of x are signals of one length, rows of state their states."""
        s = state.T.copy()
        out = np.empty_like(x)
        for i in range(x.shape[1]):
            v = x[:, i]
            if self.high:
                y = v - s[0] + self.r * s[1]
                s[0], s[1], v = v, y, y
            for k, (b0, b1, b2, a1, a2) in zip((2, 4), self.stages, strict=True):
                y = b0 * v + s[k]
                s[k], s[k + 1] = b1 * v - a1 * y + s[k + 1], b2 * v - a2 * y
                v = y
            out[:, i] = v
        return out, s.T

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and end state of one signal."""
        if not (np.isfinite(x).all() and np.isfinite(state).all()):
            return self.broken(x, np.asarray(state, float))
        whole = len(x) // self.BLOCK * self.BLOCK
        blocks, rest = x[:whole].reshape(-1, self.BLOCK), x[whole:]
        starts, now = np.empty((len(blocks), 6)), np.asarray(state, float)
        for i, own in enumerate(blocks @ self.end_of_input):
            starts[i] = now
            now = now @ self.end_of_state + own
        out = (blocks @ self.out_of_input + starts @ self.out_of_state).ravel()
        # of a block's first k places the output looks back only, and to an end k places on it is as if they were its last
        k = len(rest)
        last = rest @ self.out_of_input[:k, :k] + now @ self.out_of_state[:, :k]
        return np.concatenate((out, last)), now @ self.powers[k] + rest @ self.end_of_input[self.BLOCK - k :]


    def broken(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """run() for a signal or state that is not finite: by blocks up to there, as a product would carry it to earlier samples, and by samples until nothing but NaN can follow."""
        good = int(np.argmin(np.isfinite(x))) if np.isfinite(state).all() and len(x) else 0
        out = np.full_like(x, np.nan)
        if good:
            out[:good], state = self.run(x[:good], state)
        used = [*([1] if self.high else []), *range(2, 2 + 2 * len(self.stages))]
        for at in range(good, len(x), 8):
            if used and np.isnan(state[used]).all():
                return out, np.full(6, np.nan)
            own, state = self.walk(x[None, at : at + 8], state[None, :])
            out[at : at + 8], state = own[0], state[0]
        return out, state


def _signal(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A run's chunks in order, and their samples end to end."""
    table = table.sort_by("chunk_id")
    values = table["values"].combine_chunks()
    return table, values.flatten().to_numpy(zero_copy_only=False).astype(float)


def condition(chunks: DataFrame, options: Options, run: int = 64) -> DataFrame:
    """chunks with filtered values. Add a column ``segment`` to restart the state at each of its values (a switch, or a gap).

    A channel is worked on in runs of ``run`` chunk ids; one row a run (six numbers) is folded along a channel. The first
    sample of a channel (or segment) primes the state, so a constant offset doesn't ring in.
    """
    keys = ["stream_key", "channel", *(["segment"] if "segment" in chunks.columns else [])]
    types = {f.name: f.dataType.simpleString() for f in chunks.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    chain = Chain(options)
    # rows without a key have no place in a join; left out before it, both uses of the runs are one exchange
    known = chunks.dropna(subset=[*keys, "chunk_id"])
    runs = known.select(*keys, F.floor(F.col("chunk_id") / run).alias("run"), "chunk_id", "start_idx", "values")

    def ends(table: pa.Table) -> pa.Table:
        one, x = _signal(table)
        state = pa.array([chain.run(x, np.zeros(6))[1].tolist()], pa.list_(pa.float64()))
        return one.select([*keys, "run"])[:1].append_column("n", pa.array([len(x)], pa.int64())).append_column("first", pa.array(x[:1] if len(x) else [None], pa.float64())).append_column("state", state)

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("run")
        now, starts = None, []
        for n, first, state in zip(table["n"].to_pylist(), table["first"].to_pylist(), table["state"].to_pylist(), strict=True):
            if now is None and n:
                now = np.array([first, 0, 0, 0, 0, 0])
            starts.append((now if now is not None else np.zeros(6)).tolist())
            if n:
                now = np.linalg.matrix_power(chain.step, n) @ now + np.array(state)
        return table.select([*keys, "run"]).append_column("start", pa.array(starts, pa.list_(pa.float64())))

    def filtered(table: pa.Table) -> pa.Table:
        table, x = _signal(table)
        y = chain.run(x, np.array(table["start"][0].as_py()))[0]
        offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(table["values"]).to_numpy())))
        return table.select([*keys, "chunk_id", "start_idx"]).append_column("values", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(y)))

    tails = runs.groupBy(*keys, "run").applyInArrow(ends, f"{schema}, run long, n long, first double, state array<double>")
    begins = tails.groupBy(*keys).applyInArrow(fold, f"{schema}, run long, start array<double>")
    return runs.join(begins, [*keys, "run"]).groupBy(*keys, "run").applyInArrow(filtered, f"{schema}, chunk_id {types['chunk_id']}, start_idx long, values array<double>")


def highpass(chunks: DataFrame, fc: float, fs: float) -> DataFrame:
    return condition(chunks, Options(fs, fc))


def notch(chunks: DataFrame, f0: float, fs: float, q: float = 30.0) -> DataFrame:
    return condition(chunks, Options(fs, None, f0, None, q))


def lowpass(chunks: DataFrame, fc: float, fs: float) -> DataFrame:
    return condition(chunks, Options(fs, None, None, fc))


def to_chunks(samples: DataFrame, size: int) -> DataFrame:
    """Chunks of ``size`` samples on the index grid."""
    chunk = F.expr(f"idx div {size}")
    grouped = samples.groupBy("stream_key", "channel", chunk.alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("v"))
    return grouped.select("stream_key", "channel", "chunk_id", F.get("v", F.lit(0))["idx"].alias("start_idx"), F.transform("v", lambda x: x["value"]).alias("values"))


def to_samples(chunks: DataFrame) -> DataFrame:
    return chunks.select("stream_key", "channel", "start_idx", F.posexplode("values").alias("k", "value")).select("stream_key", "channel", (F.col("start_idx") + F.col("k")).alias("idx"), "value")


def common_average(samples: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """value less the mean over the EEG channels (type eeg or blank; all, if the stream has none) at the same index.

    Which channels count, and that a stream of one channel stays as it is, is decided once a stream. At an index where no
    channel that counts has a sample the value is null. channels: stream_key, channel, type; without it, or for a channel that
    is not in it, a channel counts.
    """
    counted = _kinds(samples.select("stream_key", "channel").distinct(), channels)
    marked = samples.join(counted, ["stream_key", "channel"])
    means = marked.groupBy("stream_key", "idx").agg(F.avg(F.when(F.col("counts"), F.col("value"))).alias("mean"))
    return marked.join(means, ["stream_key", "idx"]).select("stream_key", "channel", "idx", F.when(F.col("alone"), F.col("value")).otherwise(F.col("value") - F.col("mean")).alias("value"))


def channel_reference(samples: DataFrame, channel) -> DataFrame:
    """value less that of one channel at the same index; 0 is taken off where it has none."""
    ref = samples.where(F.col("channel") == channel).select("stream_key", "idx", F.col("value").alias("ref"))
    return samples.join(ref, ["stream_key", "idx"], "left").select("stream_key", "channel", "idx", (F.col("value") - F.coalesce("ref", F.lit(0.0))).alias("value"))


def _kinds(own: DataFrame, channels: DataFrame | None) -> DataFrame:
    """(stream_key, channel, many, alone, counts) of each channel of own: how many its stream has, whether it is its stream's only one and whether it counts for the mean."""
    if channels is None:
        own = own.withColumn("eeg", F.lit(True))
    else:
        kind = F.lower(F.trim(F.coalesce(F.col("type"), F.lit(""))))
        own = own.join(channels.select("stream_key", "channel", kind.isin("eeg", "").alias("eeg")), ["stream_key", "channel"], "left").withColumn("eeg", F.coalesce("eeg", F.lit(True)))
    streams = own.groupBy("stream_key").agg(F.max("eeg").alias("some"), F.count("*").alias("many"))
    return own.join(streams, "stream_key").select("stream_key", "channel", "many", (F.col("many") == 1).alias("alone"), (F.col("eeg") | ~F.col("some")).alias("counts"))


def _on_grid(chunk: int):
    """values with a null for each place of the chunk before its first sample."""
    return F.concat(F.array_repeat(F.lit(None).cast("double"), (F.col("start_idx") - F.col("chunk_id") * chunk).cast("int")), F.col("values"))


#: Arrays that one row of a first sum gathers.
GATHERED = 16


def common_average_chunks(chunks: DataFrame, chunk: int, channels: DataFrame | None = None) -> DataFrame:
    """common_average() on chunks of ``chunk`` samples (the first and last of a channel may be shorter): what is exchanged are arrays by (stream, chunk).

    Arrays of a chunk are added up element by element, GATHERED channels at a time and then these sums, so no row holds more
    than a few of them, however many channels there are. Where no channel that counts has a sample the value is null.
    """
    counted = _kinds(chunks.select("stream_key", "channel").distinct(), channels)
    marked = chunks.join(counted, ["stream_key", "channel"])
    pairs = F.transform(_on_grid(chunk), lambda v: F.struct(F.coalesce(v, F.lit(0.0)).alias("s"), v.isNotNull().cast("int").alias("n")))
    plus = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.struct((a["s"] + b["s"]).alias("s"), (a["n"] + b["n"]).alias("n")))
    added = lambda c: F.reduce(F.slice(c, 2, F.size(c)), F.get(c, F.lit(0)), lambda a, b: F.zip_with(a, b, plus)).alias("sums")
    own = marked.where("counts").select("stream_key", "chunk_id", F.pmod(F.xxhash64("channel"), F.ceil(F.col("many") / GATHERED)).alias("part"), pairs.alias("sums"))
    first = own.groupBy("stream_key", "chunk_id", "part").agg(F.collect_list("sums").alias("a")).select("stream_key", "chunk_id", added("a"))
    means = first.groupBy("stream_key", "chunk_id").agg(F.collect_list("sums").alias("a")).select("stream_key", "chunk_id", added("a"))
    means = means.select("stream_key", "chunk_id", F.transform("sums", lambda x: F.when(x["n"] > 0, x["s"] / x["n"])).alias("mean"))
    skip = (F.col("start_idx") - F.col("chunk_id") * chunk).cast("int")
    less = F.zip_with("values", F.slice(F.coalesce("mean", F.array().cast("array<double>")), skip + 1, F.size("values")), lambda v, m: v - m)
    return marked.join(means, ["stream_key", "chunk_id"], "left").select("stream_key", "channel", "chunk_id", "start_idx", F.when(F.col("alone"), F.col("values")).otherwise(less).alias("values"))


def channel_reference_chunks(chunks: DataFrame, chunk: int, channel) -> DataFrame:
    """channel_reference() on chunks of ``chunk`` samples (the first and last of a channel may be shorter), joined by (stream, chunk)."""
    ref = chunks.where(F.col("channel") == channel).select("stream_key", "chunk_id", _on_grid(chunk).alias("ref"))
    skip = (F.col("start_idx") - F.col("chunk_id") * chunk).cast("int")
    own = F.slice(F.coalesce("ref", F.array().cast("array<double>")), skip + 1, F.size("values"))
    # what the reference has beyond this chunk's end was cut off; what it lacks counts as 0
    return chunks.join(ref, ["stream_key", "chunk_id"], "left").select("stream_key", "channel", "chunk_id", "start_idx", F.zip_with("values", own, lambda v, r: v - F.coalesce(r, F.lit(0.0))).alias("values"))


def _averaged(x: np.ndarray, start: float, alpha: float, size: int = 256) -> np.ndarray:
    """y = (1 - alpha) y1 + alpha x from y = start, in blocks: each is one product with a triangle of powers."""
    lag = np.subtract.outer(np.arange(size), np.arange(size))
    weights, fade = np.where(lag >= 0, alpha * (1 - alpha) ** np.maximum(lag, 0), 0), (1 - alpha) ** np.arange(1, size + 1)
    out = np.empty(len(x))
    for at in range(0, len(x), size):
        n = min(size, len(x) - at)
        out[at : at + n] = weights[:n, :n] @ x[at : at + n] + fade[:n] * start
        start = out[at + n - 1]
    return out


def measured_rate(chunks: DataFrame, alpha: float = 0.1, piece: int = 4096) -> DataFrame:
    """(stream_key, chunk_id, rate): moving average of samples over time between chunks; the first rate begins it, steps of 1 us or less are passed over.

    Pieces of ``piece`` chunk ids are averaged from zero by tasks, what they end in is folded along a stream (two numbers a
    piece), and each piece then runs from its true start. chunks: stream_key, chunk_id, t_us, n.
    """
    stepped = previous(chunks, ["stream_key"], ["chunk_id"], ["t_us"], piece).withColumn("d", F.col("t_us") - F.col("__prev.t_us")).where("d > 1")
    r = stepped.select("stream_key", "chunk_id", (F.col("n") * 1e6 / F.col("d")).alias("r"), F.floor(F.col("chunk_id") / piece).alias("b"))

    def ends(table):
        x = table.sort_by("chunk_id")["r"].to_numpy()
        return pa.table({"stream_key": table["stream_key"][:1], "b": table["b"][:1], "first": x[:1], "keep": [(1 - alpha) ** len(x)], "end": _averaged(x, 0.0, alpha)[-1:]})

    def fold(table):
        table = table.sort_by("b")
        now, starts = table["first"][0].as_py(), []
        for keep, end in zip(table["keep"].to_pylist(), table["end"].to_pylist(), strict=True):
            starts.append(now)
            now = keep * now + end
        return table.select(["stream_key", "b"]).append_column("start", pa.array(starts, pa.float64()))

    def finished(table):
        table = table.sort_by("chunk_id")
        return table.select(["stream_key", "chunk_id"]).append_column("rate", pa.array(_averaged(table["r"].to_numpy(), table["start"][0].as_py(), alpha)))

    starts = r.groupBy("stream_key", "b").applyInArrow(ends, "stream_key string, b long, first double, keep double, end double").groupBy("stream_key").applyInArrow(fold, "stream_key string, b long, start double")
    return r.join(starts, ["stream_key", "b"]).groupBy("stream_key", "b").applyInArrow(finished, "stream_key string, chunk_id long, rate double")
