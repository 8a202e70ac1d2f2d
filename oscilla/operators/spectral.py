"""Power spectra, spectrograms and the band that holds a signal's energy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


#: Windows that are transformed at a time.
BLOCK = 4096
#: Beyond any index.
NO_LIMIT = 1 << 62


def power(x: np.ndarray, fs: float) -> np.ndarray:
    """One-sided power of each row: mean taken off, symmetric Hann window, DC and Nyquist not doubled."""
    n = x.shape[1]
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    p = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 * (2 / (fs * (w @ w)))
    p[:, [0, -1]] *= 0.5
    return p


def psd(values, fs: float):
    """ARRAY<DOUBLE> of n samples (n even) to the n/2+1 powers, a batch of rows at a time."""

    @pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(column), dtype=object)
        sizes = column.map(len)
        for n in sizes.unique():
            own = np.flatnonzero(sizes == n)
            if n >= 2:
                for i, p in zip(own, power(np.stack(column.iloc[own].to_list()).astype(float), fs), strict=True):
                    out.iloc[i] = p
        return out

    return run(values)


def psd_freq(k, fs: float, n: int):
    return k * (fs / n)


def to_db(p):
    return 10 * F.log10(p + 1e-12)


def spectrum(samples: DataFrame, n: int, fs: float) -> DataFrame:
    """(stream_key, channel, k, hz, power) of the last n samples; channels with fewer have none."""
    head = samples.groupBy("stream_key", "channel").agg(F.max("idx").alias("last"))
    own = samples.join(head, ["stream_key", "channel"]).where(F.col("idx") > F.col("last") - n)
    windows = own.groupBy("stream_key", "channel").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("v")).where(F.size("v") == n)
    powers = windows.select("stream_key", "channel", F.posexplode(psd(F.transform("v", lambda x: x["value"]), fs)).alias("k", "power"))
    return powers.withColumn("hz", psd_freq(F.col("k"), fs, n))


def stft_hop(dt: float, nfft: int, seconds: float = 0.03) -> int:
    return min(nfft // 2, max(1, round(seconds / dt)))


def stft_columns(hop_seconds: float) -> int:
    return min(1500, max(30, int(120 / hop_seconds)))


def _overlapped(chunks: DataFrame, nfft: int) -> DataFrame:
    """(stream_key, channel, chunk_id, start_idx, n, more, values): each chunk with the first nfft - 1 samples of the next one; n is its own length."""
    head = chunks.select("stream_key", "channel", "chunk_id", "start_idx", "values", F.lit(True).alias("own"))
    lent = chunks.where("chunk_id > 0").select("stream_key", "channel", (F.col("chunk_id") - 1).alias("chunk_id"), "start_idx", F.slice("values", 1, nfft - 1).alias("values"), F.lit(False).alias("own"))
    paired = head.unionByName(lent).groupBy("stream_key", "channel", "chunk_id").agg(F.max_by("start_idx", "own").alias("start_idx"), F.max(F.col("own").cast("int")).alias("o"), F.max_by("values", "own").alias("a"), F.max(F.when(~F.col("own"), F.col("values"))).alias("b")).where("o = 1")
    return paired.select("stream_key", "channel", "chunk_id", "start_idx", F.size("a").alias("n"), F.col("b").isNotNull().alias("more"), F.concat("a", F.coalesce("b", F.array().cast("array<double>"))).alias("values"))


def _columns(joined: DataFrame, nfft: int, hop: int, fs: float) -> DataFrame:
    """Powers of the windows of _overlapped() rows that begin in their chunk, by their parts (begin, limit): every hop from begin on, those that end by limit (null: none)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name in ("stream_key", "channel"))

    def run(batches):
        for b in batches:
            start, n, more = (b.column(c).to_numpy(zero_copy_only=False) for c in ("start_idx", "n", "more"))
            if (short := more & (n < nfft - 1)).any():
                raise ValueError(f"a chunk of {n[short][0]} samples is too short for windows of {nfft}")
            sizes, parts = (pc.list_value_length(b.column(c)).to_numpy(zero_copy_only=False) for c in ("values", "parts"))
            x, own = b.column("values").flatten().to_numpy(zero_copy_only=False), b.column("parts").flatten()
            # of each part its chunk, and the first samples of its windows there
            row = np.repeat(np.arange(b.num_rows), parts)
            begin, limit = own.field("begin").to_numpy(zero_copy_only=False), pc.fill_null(own.field("limit"), NO_LIMIT).to_numpy(zero_copy_only=False)
            first = begin + np.maximum(0, -(-(start[row] - begin) // hop)) * hop
            last = np.minimum(start[row] + np.minimum(n, sizes - nfft + 1)[row], limit - nfft + 1)
            count = np.maximum(0, -(-(last - first) // hop))
            at = np.repeat(first, count) + hop * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            row = np.repeat(row, count)
            place = at - start[row] + (np.cumsum(sizes) - sizes)[row]
            for i in range(0, len(at), BLOCK):
                some = slice(i, i + BLOCK)
                p = power(np.lib.stride_tricks.sliding_window_view(x, nfft)[place[some]], fs)
                rows = pa.array(row[some])
                powers = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("stream_key").take(rows), b.column("channel").take(rows), pa.array(at[some] + nfft, pa.int64()), powers], names=["stream_key", "channel", "end_idx", "power"])

    return joined.select("stream_key", "channel", "start_idx", "n", "more", "values", "parts").mapInArrow(run, f"{schema}, end_idx long, power array<double>")


def stft(chunks: DataFrame, nfft: int, hop: int, fs: float) -> DataFrame:
    """(stream_key, channel, end_idx, power): the windows that begin at multiples of hop.

    Each chunk goes to its own id and, by its first nfft - 1 samples, to the one before; a window belongs to the chunk
    of its first sample. Chunks are of one length (the last may be shorter) of at least nfft - 1 samples.
    """
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.lit(None).cast("long").alias("limit")))
    return _columns(_overlapped(chunks, nfft).withColumn("parts", whole), nfft, hop, fs)


def stft_through_gaps(chunks: DataFrame, anchors: DataFrame, gaps: DataFrame, nfft: int, hop: int, dt_us: int, chunk: int) -> DataFrame:
    """(stream_key, channel, col, end_idx, t_us, power): the columns of each channel in order, with blanks (null end_idx and power) for dropouts.

    No window holds samples of both sides of a gap, and none ends right at one: the first window after it begins with the first sample after it,
    and windows go on from there by hop. In between stand int((gap + nfft dt) / hop + 0.5) blanks. A column's time is that just after its
    window, in real time; a blank's is a hop after the column before it (the first sample's time, if there is none).
    anchors: stream_key, t0_us; gaps: as detect_gaps() tells them; chunks hold ``chunk`` samples.
    """
    step = hop * dt_us
    marks = gaps.join(anchors, "stream_key").select("stream_key", F.col("gap_no").cast("long").alias("seg"), F.round((F.col("old_us") - F.col("t0_us")) / dt_us).cast("long").alias("begin"), "cum_us", F.floor((F.col("gap_us") + nfft * dt_us) / F.lit(float(step)) + 0.5).cast("long").alias("blanks"))
    zero = F.lit(0).cast("long")
    starts = anchors.select("stream_key", zero.alias("seg"), zero.alias("begin"), zero.alias("cum_us"), zero.alias("blanks"))
    segments = starts.unionByName(marks).withColumn("limit", F.lead("begin").over(Window.partitionBy("stream_key").orderBy("seg")) - 1)
    # a part goes to the chunks that it touches
    heads = chunks.groupBy("stream_key", "channel").agg(F.max(F.col("start_idx") + F.size("values")).alias("n"))
    ends = heads.groupBy("stream_key").agg(F.max("n").alias("most"))
    upto = F.coalesce("limit", F.col("most"))
    touched = segments.join(ends, "stream_key").where(upto >= F.col("begin")).select("stream_key", "begin", "limit", F.explode(F.sequence(F.expr(f"begin div {chunk}"), (upto / chunk).cast("long"))).alias("chunk_id"))
    parts = touched.groupBy("stream_key", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("begin", "limit"))).alias("parts"))
    powers = _columns(_overlapped(chunks, nfft).join(parts, ["stream_key", "chunk_id"]), nfft, hop, 1e6 / dt_us)
    # how many columns each part has, and what stands before it, from one row a part
    line = Window.partitionBy("stream_key", "channel").orderBy("seg")
    upto_here = line.rowsBetween(Window.unboundedPreceding, 0)
    laid = heads.join(segments.join(anchors, "stream_key"), "stream_key").where(F.col("begin") < F.col("n"))
    room = F.least(F.coalesce("limit", F.col("n")), F.col("n")) - F.col("begin") - nfft
    laid = laid.withColumn("cols", F.when(room >= 0, F.floor(room / hop) + 1).otherwise(0)).withColumn("blank_sum", F.sum("blanks").over(upto_here))
    newest = F.col("t0_us") + (F.col("begin") + nfft + (F.col("cols") - 1) * hop) * dt_us + F.col("cum_us")
    laid = laid.withColumn("base", F.coalesce(F.last(F.when(F.col("cols") > 0, newest - F.col("blank_sum") * step), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.col("t0_us")))
    laid = laid.withColumn("col0", F.coalesce(F.sum("cols").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("blank_sum"))
    k = F.explode(F.sequence(F.lit(1).cast("long"), F.col("blanks"))).alias("k")
    empty = laid.where("blanks > 0").select("stream_key", "channel", "blanks", "blank_sum", "base", "col0", k)
    before = F.col("blank_sum") - F.col("blanks") + F.col("k")
    empty = empty.select("stream_key", "channel", (F.col("col0") - F.col("blanks") + F.col("k") - 1).alias("col"), F.lit(None).cast("long").alias("end_idx"), (F.col("base") + before * step).alias("t_us"), F.lit(None).cast("array<double>").alias("power"))
    numbers = laid.where("cols > 0").select("stream_key", "channel", "begin", "cum_us", "t0_us", "col0", F.posexplode(F.sequence(F.col("begin") + nfft, F.col("begin") + nfft + (F.col("cols") - 1) * hop, F.lit(hop).cast("long"))).alias("j", "end_idx"))
    placed = numbers.select("stream_key", "channel", (F.col("col0") + F.col("j")).alias("col"), "end_idx", (F.col("t0_us") + F.col("end_idx") * dt_us + F.col("cum_us")).alias("t_us"))
    full = powers.join(placed, ["stream_key", "channel", "end_idx"]).select("stream_key", "channel", "col", "end_idx", "t_us", "power")
    return full.unionByName(empty)


def band(df: DataFrame, fmin: float, fmax: float, nyquist: float) -> DataFrame:
    return df.where((F.col("hz") >= fmin) & (F.col("hz") <= min(fmax, nyquist)))


def fit_hz_spectrum(powers: DataFrame, nyquist: float) -> DataFrame:
    """(stream_key, fit_hz): the highest bin (k >= 1) within 45 dB of the peak, times 1.3, at most Nyquist; none if the peak is at most -90 dB. powers: stream_key, k, hz, power."""
    d = powers.where("k >= 1").withColumn("db", to_db(F.col("power")))
    peak = d.groupBy("stream_key").agg(F.max("db").alias("peak")).where("peak > -90")
    return d.join(peak, "stream_key").where(F.col("db") > F.col("peak") - 45).groupBy("stream_key").agg(F.least(F.max("hz") * 1.3, F.lit(nyquist)).alias("fit_hz"))


def fit_hz_stft(cells: DataFrame, bins: int, nyquist: float) -> DataFrame:
    """(stream_key, fit_hz) over columns, times 1.2. Columns lit in more than max(8, bins/4) bins are left out if they are fewer
    than a fifth; if nothing is left the answer is 0. cells: stream_key, col, k, power (null: blank)."""
    d = cells.where("power is not null").withColumn("db", to_db(F.col("power")))
    peak = d.groupBy("stream_key").agg(F.max("db").alias("peak")).where("peak > -120")
    lit = d.join(peak, "stream_key").groupBy("stream_key", "col").agg(F.count(F.when(F.col("db") > F.col("peak") - 45, 1)).alias("n"), F.max(F.when(F.col("db") > F.col("peak") - 45, F.col("k"))).alias("top"))
    wide = F.col("n") > max(8, bins // 4)
    shares = lit.groupBy("stream_key").agg(F.count("*").alias("cols"), F.count(F.when(wide, 1)).alias("wides"), F.max("top").alias("every"), F.max(F.when(~wide, F.col("top"))).alias("narrow"))
    top = F.coalesce(F.when(F.col("wides") * 5 < F.col("cols"), F.col("narrow")).otherwise(F.col("every")), F.lit(0))
    return shares.select("stream_key", F.least(nyquist * top / (bins - 1) * 1.2, F.lit(nyquist)).alias("fit_hz"))
