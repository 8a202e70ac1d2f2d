"""Hard negatives by one-bit codes of rotated vectors and certain bounds on inner products.

A vector v is turned by a fixed orthogonal transform. Its first code c1 has the signs of the turned unit vector o (as a unit vector), each further code those of what
the codes before leave; with each is stored its alignment a = <c, what was left>, and with all the norm of the rest r = o - a1 c1 - ... - ak ck, which is
at right angles to ck. For a query q turned alike, by Cauchy and Schwarz, <v, q> lies within |v| |r| sqrt(|q|^2 - <ck, q>^2) of
|v| (a1 <c1, q> + ... + ak <ck, q>). The terms <c, q> come from population counts of the codes and bit planes of the rounded query; what rounding
leaves is added to the bound. So no row is lost: rows whose interval reaches the range asked for are scored by their integers, all others cannot be in
it. One code leaves 0.6 of a vector's norm, too much for vectors that are hardly alike; CODES of them leave about 0.1.

Queries (anchors) and rows are dealt into groups of bounded size; each pair of groups is one task, which tells only its first few rows a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

POSITIVES = NEGATIVES = 5
SCALE = 256
SEED = 42
#: Codes of a vector, and bits of a rounded query's component.
CODES, PLANES = 4, 6
#: Most queries and rows of a task, and cells (query x row) that it works on at a time.
QUERIES_A_GROUP, ROWS_A_GROUP, TILE = 1 << 17, 1 << 18, 1 << 19
#: Rows of the best estimates that are scored first, for a threshold.
FIRST = 16

CODED = "vec_id long, label long, vector binary, code binary, aligned binary, rest double, norm double"


def _signs(d: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (2, d)) * 2.0 - 1


def width(d: int) -> int:
    """The length of turned vectors: a power of two, 64 at least."""
    return max(64, 1 << (max(d, 1) - 1).bit_length())


def turned(v: np.ndarray) -> np.ndarray:
    """Rows after two rounds of fixed sign flips and a Hadamard transform: inner products stay as they are."""
    n, d = v.shape
    out = np.zeros((n, width(d)))
    out[:, :d] = v
    for flip in _signs(out.shape[1]):
        out *= flip
        half = 1
        while half < out.shape[1]:
            pair = out.reshape(n, -1, 2, half)
            out = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), axis=2).reshape(n, -1)
            half *= 2
        out /= math.sqrt(out.shape[1])
    return out


def coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of integers: sign bits (64 a word, code after code), alignments of the codes, norm of what they leave, and norms. A zero vector is left nothing."""
    x = turned(v)
    norm = np.sqrt((x * x).sum(axis=1))
    left = x / np.where(norm > 0, norm, 1)[:, None]
    codes, aligned = [], []
    for _ in range(CODES):
        bits = left > 0
        signs = np.where(bits, 1.0, -1.0) / math.sqrt(x.shape[1])
        aligned.append((left * signs).sum(axis=1))
        left = left - aligned[-1][:, None] * signs
        codes.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(codes, axis=1), np.stack(aligned, axis=1), np.sqrt((left * left).sum(axis=1)), norm


class Queries:
    """Turned and rounded queries."""

    def __init__(self, q: np.ndarray):
        x = turned(q)
        low, high = x.min(axis=1), x.max(axis=1)
        self.low, self.step = low, np.where(high > low, (high - low) / (2**PLANES - 1), 1.0)
        whole = np.rint((x - low[:, None]) / self.step[:, None]).astype(np.int64)
        rounded = low[:, None] + self.step[:, None] * whole
        self.left = np.sqrt(((x - rounded) ** 2).sum(axis=1))
        self.square, self.sum, self.norm = (rounded**2).sum(axis=1), rounded.sum(axis=1), np.sqrt((x * x).sum(axis=1))
        self.planes = [np.packbits(whole >> j & 1, axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)]

    def intervals(self, at: np.ndarray, code: np.ndarray, aligned: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimates, lower and upper bounds of the inner products of the queries ``at`` with all rows."""
        words = code.shape[1] // CODES
        estimate = np.zeros((len(at), len(code)))
        for k in range(CODES):
            own = code[:, k * words : (k + 1) * words]
            ones = np.bitwise_count(own).sum(axis=1, dtype=np.int64)
            met = np.zeros((len(at), len(code)), np.int32)
            for j, plane in enumerate(self.planes):
                for w in range(words):
                    met += np.bitwise_count(plane[at, w][:, None] & own[:, w]).astype(np.int32) << j
            c = (2 * (self.low[at][:, None] * ones + self.step[at][:, None] * met) - self.sum[at][:, None]) / math.sqrt(64 * words)
            estimate += aligned[:, k] * c
        estimate *= norm
        wide = rest * np.sqrt(np.maximum(self.square[at][:, None] - c * c, 0)) + self.left[at][:, None]
        half = norm * (wide + 1e-7 * self.norm[at][:, None]) + 1e-3
        # scores that pass a long are cut to it, and so are their bounds
        return estimate, np.minimum(estimate - half, 2.0**63), np.maximum(estimate + half, -(2.0**63))


def scores(rows: np.ndarray, query: np.ndarray, largest: int) -> np.ndarray:
    """Exact integer inner products of rows with one query; largest: the greatest magnitude of a component. What passes a long is cut to it."""
    bound = len(query) * largest * largest
    if bound < 1 << 53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return rows.astype(np.int64) @ query.astype(np.int64)
    own = [int(x) for x in query]
    cut = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    return np.array([cut(sum(int(a) * b for a, b in zip(r, own, strict=True))) for r in rows], np.int64)


class Part:
    """Rows of a task in order of vec_id."""

    def __init__(self, t: pa.Table, d: int, kind: str):
        ids = t.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        joined = lambda c, of: np.frombuffer(b"".join(t.column(c).to_pylist()), of).reshape(len(ids), -1)[order]
        self.ids, self.label = ids[order], t.column("label").to_numpy()[order]
        self.vectors = joined("vector", kind) if d else np.zeros((len(ids), 0), kind)
        if "code" in t.column_names:
            self.code = joined("code", np.uint64)
            self.bounds = joined("aligned", np.float64), t.column("rest").to_numpy()[order], t.column("norm").to_numpy()[order]


def _first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:n]


def nearest(q: np.ndarray, estimate, low, high, part: Part, at: np.ndarray, least: int | None, most: int | None, n: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows ``at`` (whose intervals are given) the n of highest score within least..most, ties by id: their places and scores."""
    use = np.ones(len(at), bool)
    if least is not None:
        use = (high >= least) & (low <= most)
    inside = lambda s: np.ones(len(s), bool) if least is None else (s >= least) & (s <= most)
    some = np.flatnonzero(use)
    if len(some) > 4 * FIRST:
        # the threshold that rows which look best set; a row whose upper bound is below it cannot be among the first n
        fits = some if most is None else some[estimate[some] <= most]
        tried = fits[np.argpartition(-estimate[fits], FIRST)[:FIRST]] if len(fits) > FIRST else fits
        s = scores(part.vectors[at[tried]], q, largest)
        s = np.sort(s[inside(s)])[::-1]
        if len(s) >= n:
            some = some[high[some] >= s[n - 1]]
    places = at[some]
    s = scores(part.vectors[places], q, largest)
    good = inside(s)
    places, s = places[good], s[good]
    top = _first(s, part.ids[places], n)
    return places[top], s[top]


def _tiles(n: int, rows: int):
    step = max(1, TILE // max(rows, 1))
    return (np.arange(i, min(i + step, n)) for i in range(0, n, step))


def _positives(d: int, kind: str, largest: int, n: int):
    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            a, part = Part(anchors, d, kind), Part(rows, d, kind)
            q = Queries(a.vectors)
            for label in np.unique(a.label):
                own, at = np.flatnonzero(a.label == label), np.flatnonzero(part.label == label)
                for tile in _tiles(len(own), len(at)):
                    bounds = q.intervals(own[tile], part.code[at], *(x[at] for x in part.bounds))
                    for i, e, lo, hi in zip(own[tile].tolist(), *bounds, strict=True):
                        other = part.ids[at] != a.ids[i]
                        places, s = nearest(a.vectors[i], e[other], lo[other], hi[other], part, at[other], None, None, n, largest)
                        out += zip([a.ids[i]] * len(s), part.ids[places], s, strict=True)
        return _table(out, ("anchor_id", "positive_id", "positive_score"))

    return run


def _negatives(d: int, kind: str, largest: int, n: int):
    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            a, part = Part(anchors, d, kind), Part(rows, d, kind)
            order = np.argsort(anchors.column("vec_id").to_numpy(), kind="stable").tolist()
            asked = anchors.column("asked").take(pa.array(order)).to_pylist()
            q = Queries(a.vectors)
            for label in np.unique(a.label):
                own, at = np.flatnonzero(a.label == label), np.flatnonzero(part.label != label)
                for tile in _tiles(len(own), len(at)):
                    bounds = q.intervals(own[tile], part.code[at], *(x[at] for x in part.bounds))
                    for i, e, lo, hi in zip(own[tile].tolist(), *bounds, strict=True):
                        for most in sorted(set(asked[i])):
                            # 80 positive <= 100 negative: of whole numbers, from the next one above 0.8 positive
                            places, s = nearest(a.vectors[i], e, lo, hi, part, at, -(-4 * most // 5), most, n, largest)
                            out += zip([a.ids[i]] * len(s), [most] * len(s), part.ids[places], s, strict=True)
        return _table(out, ("anchor_id", "positive_score", "negative_id", "negative_score"))

    return run


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    cells = np.array(rows, np.int64).reshape(len(rows), len(names))
    return pa.table({c: pa.array(cells[:, i]) for i, c in enumerate(names)})


def _codes(d: int, kind: str):
    def run(batches):
        for b in batches:
            flat, n = b.column("vector"), b.num_rows
            v = np.zeros((n, d))
            sizes = np.diff(flat.offsets.to_numpy())
            row = np.repeat(np.arange(n), sizes)
            v[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.flatten().to_numpy()
            code, aligned, rest, norm = coded(v)
            held = np.ascontiguousarray(v.astype(kind))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([x.tobytes() for x in held], pa.binary()), pa.array([x.tobytes() for x in code], pa.binary()), pa.array([x.tobytes() for x in aligned], pa.binary()), pa.array(rest), pa.array(norm)], names=[c.split()[0] for c in CODED.split(", ")])

    return run


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, vector of the rows that take part: components are floor(256 x) as doubles, and labels of ids divisible by 7 are moved on by one."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(F.coalesce(v, F.lit(0.0))) & (F.abs(F.coalesce(v, F.lit(0.0))) < float("inf")))
    own, label = F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("long")
    rows = vectors.select(own.alias("vec_id"), label.alias("label"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & whole)
    # floor() of a double is a long; the rest keeps doubles beyond its range whole
    floor = lambda v: F.when(F.abs(v) < 2.0**44, F.floor(v * SCALE).cast("double")).otherwise(v * SCALE)
    rows = rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), F.transform("x", floor).alias("vector"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("m")).select("vec_id", "m.label", "m.vector")


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, queries_a_group: int = QUERIES_A_GROUP, rows_a_group: int = ROWS_A_GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``. Rows with a null id, label, vector or component, or a component that is not
    finite, take no part. Of rows that share an id that of the least label, then vector, counts. A shorter vector is as if filled up with
    zeros, an empty one as zeros. Scores that pass a long are cut to it. Higher scores come first, ties by smaller id. A positive of score below 0
    has no negatives. Columns of other names are ignored; an empty table, and one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(scaled(vectors, id_col, vector_col, label_col), "scaled")
    size = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("anchors"), F.max(F.size("vector")).alias("d"), F.max(F.array_max(F.transform("vector", F.abs))).alias("largest")).first()
    d, largest = int(size.d or 0), int(size.largest or 0)
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8"
    parts = max(-(-size.n // rows_a_group), 2 * spark.sparkContext.defaultParallelism)
    groups = max(-(-size.anchors // queries_a_group), 1)
    codes = written(rows.mapInArrow(_codes(d, kind), CODED), "codes")
    anchors = written(codes.where(F.col("vec_id") % every == 0).select("vec_id", "label", "vector"), "anchors")
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda: codes.withColumn("part", deal(parts, 1)).withColumn("group", each(groups)).groupBy("group", "part")
    asks = lambda df: df.withColumn("group", deal(groups, 2)).withColumn("part", each(parts)).groupBy("group", "part")
    first = lambda n, *by: F.row_number().over(W.partitionBy(*by[:-2]).orderBy(F.desc(by[-2]), by[-1])) <= n
    ranked = lambda df, n, *by: df.withColumn("first", first(n, *by)).where("first").drop("first")

    near = asks(anchors).cogroup(dealt()).applyInArrow(_positives(d, kind, largest, positives), "anchor_id long, positive_id long, positive_score long")
    near = written(ranked(near, positives, "anchor_id", "positive_score", "positive_id"), "positives")
    wanted = near.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set("positive_score").alias("asked"))
    far = asks(anchors.join(wanted, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")).cogroup(dealt()).applyInArrow(_negatives(d, kind, largest, negatives), "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = W.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


REPORT_SQL = f"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [cast(floor({SCALE} * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings where label is not null and embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.vec_id as anchor_id, e.vec_id as other, a.label = e.label as same, cast(list_sum([a.v[i] * e.v[i] for i in range(1, len(a.v) + 1)]) as bigint) as score
  from e a join e on a.vec_id <> e.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= {POSITIVES})
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.other) as int) as rank, s.other as negative_id, positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.other) <= {NEGATIVES}
"""
