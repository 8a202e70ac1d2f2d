"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits meet at a common variant: one side flips at most one bit,
the other at most two. Of the two-bit variants only those whose bits lie in the same half of a two-part split
are needed, since of any three bits two share a part. The split is uneven: flips in the upper ``UPPER`` bits are
emitted and shuffled (137 rows of a fingerprint), flips in the lower bits are expanded by the task that gets
the unflipped row. A key with members that flipped one bit or none links all its members, so a star
around one of them keeps every component and no pair list is made.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, written
from .components import connected_components

SEED = 42
RADIUS = 3
UPPER = 16
LOWER = 64 - UPPER
ONE = np.uint64(1)


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits: a bit is 1 if it is set in more than half of the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, to - at)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits set in more than half of some hashes; zero for none."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, fp) of every row: a hash of the text and the fingerprint, both as signed 64-bit integers. Null or empty texts: zero."""

    def run(batches):
        for b in batches:
            fps = np.fromiter(map(fingerprint, text_bytes(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "mark", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark")).mapInArrow(run, "doc_id long, mark long, fp long")


def _flips(bits: range) -> np.ndarray:
    """Masks of no, one and two flipped bits, in this order."""
    one = [1 << i for i in bits]
    return np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint64)


UPPER_FLIPS, LOWER_FLIPS = _flips(range(LOWER, 64)), _flips(range(LOWER))


def _emit(shards: int):
    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                own = fps[at : at + 4096]
                variants = ((own[:, None] ^ UPPER_FLIPS) >> np.uint64(LOWER)).ravel()
                shard = (variants * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)
                order = np.argsort(shard, kind="stable")
                shard, variants, origin = shard[order], variants[order].astype(np.uint16), np.repeat(own, len(UPPER_FLIPS))[order]
                cuts = np.flatnonzero(np.diff(shard)) + 1
                starts = np.concatenate(([0], cuts)) if len(shard) else []
                rows = [(int(shard[s]), o.tobytes(), v.tobytes()) for s, o, v in zip(starts, np.split(origin, cuts), np.split(variants, cuts), strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "fps", "variants"])

    return run


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)


def links_of(fps: np.ndarray, variants: np.ndarray, room: int = 1024):
    """Star edges (n x 2, uint64) among the members of each full variant; ``room`` unflipped rows are expanded at a time."""
    order = np.argsort(variants, kind="stable")
    fps, variants = fps[order], variants[order].astype(np.uint64)
    flipped = np.bitwise_count((fps >> np.uint64(LOWER)) ^ variants)
    base = (variants << np.uint64(LOWER)) | (fps & np.uint64((1 << LOWER) - 1))
    whole = np.cumsum(flipped == 0)
    at = 0
    while at < len(fps):
        # rows of one variant stay together
        to = np.searchsorted(whole, (whole[at - 1] if at else 0) + room, "right")
        to = len(fps) if to >= len(fps) else max(np.searchsorted(variants, variants[to], "left"), at)
        if to == at:
            to = np.searchsorted(variants, variants[at], "right")
        own, key, cost = fps[at:to], base[at:to], flipped[at:to]
        plain = np.flatnonzero(cost == 0)
        near_flips = LOWER_FLIPS[: 1 + LOWER]
        s_keys = np.concatenate([(key[plain][:, None] ^ near_flips).ravel(), key[cost == 1]])
        s_from = np.concatenate([np.repeat(own[plain], len(near_flips)), own[cost == 1]])
        order = np.argsort(s_keys, kind="stable")
        s_keys, s_from = s_keys[order], s_from[order]
        first = np.concatenate(([True], s_keys[1:] != s_keys[:-1])) if len(s_keys) else np.zeros(0, bool)
        rep = s_from[first][np.cumsum(first) - 1]
        found = [np.stack([rep, s_from], 1)]
        if len(s_keys):
            seen = np.zeros(1 << 24, bool)
            seen[_slot(s_keys)] = True
            keys, reps = s_keys[first], s_from[first]

            def match(t_keys, t_from):
                hit = np.flatnonzero(seen[_slot(t_keys)])
                t_keys, t_from = t_keys[hit], t_from[hit]
                where = np.minimum(np.searchsorted(keys, t_keys), len(keys) - 1)
                same = keys[where] == t_keys
                return np.stack([reps[where[same]], t_from[same]], 1)

            found.append(match(key[cost == 2], own[cost == 2]))
            far = LOWER_FLIPS[1 + LOWER :]
            for i in range(0, len(plain), room):
                some = plain[i : i + room]
                found.append(match((key[some][:, None] ^ far).ravel(), np.repeat(own[some], len(far))))
        edges = np.concatenate(found)
        edges = edges[(edges[:, 0] != edges[:, 1]) & (np.bitwise_count(edges[:, 0] ^ edges[:, 1]) <= RADIUS)]
        edges.sort(axis=1)
        yield np.unique(edges, axis=0) if len(edges) else edges
        at = to


def _meet(table: pa.Table) -> pa.Table:
    fps = np.frombuffer(b"".join(table["fps"].to_pylist()), np.uint64)
    variants = np.frombuffer(b"".join(table["variants"].to_pylist()), np.uint16)
    edges = np.concatenate([np.zeros((0, 2), np.uint64), *links_of(fps, variants)]).view(np.int64)
    return pa.table({"a": pa.array(edges[:, 0].copy()), "b": pa.array(edges[:, 1].copy())})


def ball_links(distinct_fps: DataFrame, keys_a_shard: int = 4_000_000) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (column fp) that keep all components of the relation "at most 3 bits apart"."""
    n = distinct_fps.count()
    shards = max(8, -(-n * (len(UPPER_FLIPS) + len(LOWER_FLIPS)) // keys_a_shard))
    return distinct_fps.select("fp").mapInArrow(_emit(shards), "shard int, fps binary, variants binary").groupBy("shard").applyInArrow(_meet, "a long, b long")


def rooted_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fingerprint; root is the same for all of one component."""
    nodes = written(fps.select("fp").distinct(), "nodes")
    roots = connected_components(ball_links(nodes))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of at most three bits.

    Null and empty texts have fingerprint zero and are linked like any other. Rows that share a doc_id are kept,
    each with its own fingerprint. A component whose doc_ids are all null has a null component_id. An empty table gives
    no rows; other columns are ignored. Very long texts are hashed whole. Variants meet at 2 ** UPPER keys, which tasks group:
    beyond some 10 ** 8 distinct fingerprints a key's group grows with their number, so raise UPPER for more.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fps")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = written(rooted_fingerprints(fps).join(least, "fp"), "rooted")
    components = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(components, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
