"""Packing documents into sequences: non-negative least squares over shallow length combinations.

A document's ids give whole sequences of ``width`` as long as they last, then one piece of a multiple of
``unit``, then a tail. Pieces are counted by their units; all combinations of up to ``depth`` pieces that fill
a sequence exactly are enumerated, repeat counts are solved against the histogram by non-negative least squares
and rounded down. Tails and pieces left over are packed greedily: laid end to end and cut where a sequence is full.
What is left at the very end goes into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_bytes, written
from .wordbpe import encoder, tokenizer_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations_filling(units: int, depth: int) -> list[tuple[int, ...]]:
    """All descending tuples of 2 to ``depth`` positive integers that sum to ``units``."""

    def grow(left: int, most: int, room: int):
        if not left:
            yield ()
        elif room:
            for x in range(min(left, most), 0, -1):
                if x * room >= left:
                    yield from ((x, *rest) for rest in grow(left - x, x, room - 1))

    return list(grow(units, units - 1, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """min |ax - b| with x >= 0, by the active-set method of Lawson and Hanson."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[best] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (low := active & (s <= 1e-12)).any():
                step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
                x += step * (s - x)
                active &= x > 1e-12
                x[~active] = 0
                if not active.any():
                    break
            else:
                x = s
                break
    return x


def plan(histogram: dict[int, int], units: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) for pieces counted by units; never more pieces of a size than there are."""
    combos = combinations_filling(units, depth)
    b = np.array([histogram.get(u, 0) for u in range(1, units)], float)
    a = np.zeros((units - 1, len(combos)))
    for j, combo in enumerate(combos):
        np.add.at(a[:, j], np.array(combo) - 1, 1)
    # weights keep rare sizes from being ignored beside frequent ones
    scale = 1 / np.sqrt(np.maximum(b, 1))
    x = np.floor(nnls(a * scale[:, None], b * scale) + 1e-6).astype(np.int64)
    left, out = b.astype(np.int64), []
    # the least squares may ask for more of a size than there is; what is lost or left here is filled up greedily
    for again in (False, True):
        for j in np.argsort([len(c) for c in combos], kind="stable") if again else np.argsort(-x, kind="stable"):
            need = a[:, j].astype(np.int64)
            most = int(np.min(left[need > 0] // need[need > 0]))
            if n := most if again else min(int(x[j]), most):
                left -= n * need
                out.append((combos[j], n))
    return out


def _encode(path: str, end_id: int):
    def run(batches):
        encode = encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                ids = encode(text_bytes(b.column(1)))
                data = [x.astype("<u4").tobytes() if x.dtype.itemsize == 4 else x.tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) + 1 for x in ids], pa.int64()), pa.array([x.dtype.itemsize for x in ids], pa.int8()), pa.array(data, pa.binary())], names=["doc_id", "n", "width", "ids"])

    return run


def _cut(end_id: int, with_ids: bool):
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches):
        for b in batches:
            doc, n, width, ids, pieces = b.columns
            ends, flat = pieces.offsets.to_numpy(), pieces.values.slice(pieces.offsets[0].as_py(), pieces.offsets[-1].as_py() - pieces.offsets[0].as_py())
            ends = ends - ends[0]
            start, length, sequence, offset = (flat.field(k) for k in ("start", "length", "sequence_id", "offset"))
            spans, at, crcs, cut = list(zip(start.to_pylist(), length.to_pylist(), strict=True)), 0, [], []
            for w, raw, to in zip(width.to_pylist(), ids.to_pylist(), ends[1:].tolist(), strict=True):
                own = np.concatenate((np.frombuffer(raw, f"<u{w}"), np.array([end_id], f"<u{w}"))).astype("<u4")
                for s, k in spans[at:to]:
                    crcs.append(zlib.crc32(own[s : s + k]))
                    if with_ids:
                        cut.append(own[s : s + k].view("<i4"))
                at = to
            of = pa.array(np.repeat(np.arange(b.num_rows), np.diff(ends)))
            columns = [doc.take(of), start, length, pa.array(crcs, pa.int64()), n.take(of), sequence, offset]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(c) for c in cut]))), pa.int32()), pa.array(np.concatenate([np.zeros(0, "<i4"), *cut]))))
            yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    return run


def _running(parts: DataFrame, value: str, name: str) -> DataFrame:
    """(bucket, name): the sum of ``value`` over all earlier buckets; one row a bucket."""
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return parts.groupBy("bucket").agg(F.sum(value).alias("x")).select("bucket", F.coalesce(F.sum("x").over(before), F.lit(0)).alias(name))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, width: int = 4096, unit: int = 128, depth: int = 4, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``with_ids`` adds its token ids (ids).

    ``width`` is a power of two and a multiple of ``unit``. Null texts are empty (one end id). Rows that repeat, or
    share a doc_id, are packed each; null doc_ids are kept. A long text is as many whole sequences as it fills, and a
    rest. An empty table gives no rows; other columns are ignored. The plan rests on at most width/unit counts.
    """
    spark = docs.sparkSession
    units, path = width // unit, tokenizer or tokenizer_path()
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = picked.mapInArrow(_encode(path, end_id), "doc_id long, n long, width byte, ids binary").withColumn("uid", F.monotonically_increasing_id())
    ids = written(encoded, "ids")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = ids.select("uid", "n", F.pmod(F.xxhash64("uid"), F.lit(buckets)).alias("bucket")).withColumn("rest", F.col("n") % width)
    sizes = sizes.withColumn("u", F.floor(F.col("rest") / unit))
    counts = sizes.where("u > 0").groupBy("u", "bucket").count()
    histogram = {r.u: r.n for r in counts.groupBy("u").agg(F.sum("count").alias("n")).collect()}

    slots, base, taken = [], 0, dict.fromkeys(range(units), 0)
    for combo, n in plan(histogram, units, depth):
        offset = 0
        for u in combo:
            slots.append((u, taken[u], taken[u] + n, base, offset * unit))
            taken[u] += n
            offset += u
        base += n
    slot_rows = spark.createDataFrame(slots, "u long, first long, past long, base long, offset long")

    own = Window.partitionBy("bucket", "u").orderBy("uid")
    earlier = Window.partitionBy("u").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("u", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("ahead"))
    ranked = sizes.withColumn("k", F.row_number().over(own) - 1).join(ranks, ["u", "bucket"], "left").withColumn("rank", F.col("k") + F.col("ahead"))
    s = F.broadcast(slot_rows.withColumnRenamed("u", "su"))  # at most (units * depth) rows a combination: bounded by the parameters
    placed = ranked.join(s, (F.col("u") == F.col("su")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")), "left")
    placed = placed.select(
        "uid", "n", "bucket", "rest",
        F.expr(f"n div {width}").alias("whole"),
        F.when(F.col("first").isNotNull(), F.col("u") * unit).otherwise(0).alias("main"),
        (F.col("base") + F.col("rank") - F.col("first")).alias("sequence"),
        "offset",
    )
    placed = written(placed.withColumn("tail", F.col("rest") - F.col("main")), "placed")

    in_bucket = Window.partitionBy("bucket").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.agg(F.coalesce(F.sum("tail"), F.lit(0)).alias("tail"), F.coalesce(F.sum("whole"), F.lit(0)).alias("whole")).first()
    tails, last = -(-totals.tail // width), totals.tail // width * width
    powers, ends = totals.tail - last, [last]
    while powers:
        ends.append(ends[-1] + (1 << powers.bit_length() - 1))
        powers -= 1 << powers.bit_length() - 1
    cuts = F.array(*[F.lit(x).cast("long") for x in ends])
    laid = placed.join(_running(placed, "tail", "tails_before"), "bucket").join(_running(placed, "whole", "whole_before"), "bucket")
    zero = F.lit(0)
    laid = laid.withColumn("at", F.col("tails_before") + F.coalesce(F.sum("tail").over(in_bucket), zero)).withColumn("wholes", F.col("whole_before") + F.coalesce(F.sum("whole").over(in_bucket), zero))
    laid = laid.withColumn("cuts", F.array_sort(F.array_distinct(F.flatten(F.array(
        F.array("at", F.col("at") + F.col("tail")),
        F.filter(F.array((F.expr(f"at div {width}") + 1) * width), lambda c: c < F.col("at") + F.col("tail")),
        F.filter(cuts, lambda c: (c > F.col("at")) & (c < F.col("at") + F.col("tail"))),
    )))))
    piece = lambda start, length, sequence, offset: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
    # a sequence of the residue begins at every multiple of width, and after the last one at the powers of two
    number = lambda c: F.when(c < last, F.floor(c / width)).otherwise(F.lit(last // width) + F.size(F.filter(cuts, lambda e: e <= c)) - 1)
    begins = lambda c: F.when(c < last, F.floor(c / width) * width).otherwise(F.array_max(F.filter(cuts, lambda e: e <= c)))
    tail_from = F.col("n") - F.col("tail") - F.col("at")
    tails_of = F.when(F.col("tail") > 0, F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: piece(
        F.element_at("cuts", i) + tail_from, F.element_at("cuts", i + 1) - F.element_at("cuts", i), F.lit(base) + number(F.element_at("cuts", i)), F.element_at("cuts", i) - begins(F.element_at("cuts", i))
    ))).otherwise(F.array())
    base_whole = base + tails + 16
    wholes_of = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(0), F.col("whole").cast("int") - 1), lambda i: piece(i * width, F.lit(width), F.lit(base_whole) + F.col("wholes") + i, zero))).otherwise(F.array())
    main_of = F.when(F.col("main") > 0, F.array(piece(F.col("whole") * width, F.col("main"), F.col("sequence"), F.col("offset")))).otherwise(F.array())
    pieces = laid.select("uid", F.concat(wholes_of, main_of, tails_of).alias("pieces"))
    return ids.join(pieces, "uid").select("doc_id", "n", "width", "ids", "pieces").mapInArrow(_cut(end_id, with_ids), PIECES + ", ids array<int>" * with_ids)
