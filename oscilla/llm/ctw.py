"""Context-tree weighting over bytes, trained and applied in shards.

A byte is eight binary decisions; a decision's node is a context of 0 to ``depth`` earlier bytes and the bits so far.
Each node has a Krichevsky-Trofimov estimate, whose probability of the training bits depends on the two counts
only. P_w of a node is half that estimate plus half the product of its children's P_w, and a bit's probability mixes
the estimates of all depths by the weights that follow. A context never met in training leaves the
mixture, so the next shorter one speaks for it.

Texts are packed into blocks. A block asks for its distinct byte strings by a hash of the whole string, so no bucket of asks is
hot, and hot strings are counted before they are shuffled. A bucket counts each string once, whoever asked, and lends it to the
shard of its last two context bytes, which holds whole subtrees from depth two down: a shard's size is that of its distinct
strings, not of the asks. What lies above are at most 257 contexts, whose sums are gathered on the driver (65,535 nodes at most,
whatever the input). Answers go back through the buckets to the blocks. Word counts of the base score are asked the same way.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack_array, pack_sorted, text_bytes, unpack_array, unpack_sorted, written

DEPTH = 5
EIGHT = np.uint64(8)
BLOCK = "block string, doc_id array<long>, held array<boolean>, size array<long>, data binary"
ASKED = "kind string, bucket int, block string, keys binary, counts binary"
COUNTED = "kind string, bucket int, block string, wanted binary, shard int, keys binary, counts binary, tokens long, vocabulary long"
SHARD = "shard int, buckets array<int>, places array<binary>, model array<binary>, top array<binary>"
VALUES = "bucket int, shard int, data binary"
ANSWER = "block string, kind string, bucket int, answer binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series, after a shift for small x."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    small = np.flatnonzero(x < 8)
    if len(small):
        y = x[small]
        product = np.ones_like(y)
        for _ in range(8):
            low = y < 8
            product[low] *= y[low]
            y = y + low
        x = x.copy()
        x[small] = y
        shift[small] = -np.log(product)
    i = 1 / x
    i2 = i * i
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680)))


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    out = np.zeros(len(n0))
    met = np.flatnonzero(n0 + n1)
    a, b = n0[met], n1[met]
    out[met] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)
    return out


class Level:
    """Nodes of one depth for sorted distinct keys (context << 8 | byte); ``bits`` holds (node of entry, first entry, n0, n1)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts, self.bits = keys, counts, []
        for j in range(8):
            prefix = keys >> np.uint64(8 - j)
            first = np.concatenate(([True], prefix[1:] != prefix[:-1])) if len(keys) else np.zeros(0, bool)
            node = np.cumsum(first) - 1
            one = (keys >> np.uint64(7 - j)) & np.uint64(1) == 1
            n = np.bincount(node, weights=counts) if len(keys) else np.zeros(0)
            n1 = np.bincount(node, weights=counts * one) if len(keys) else np.zeros(0)
            self.bits.append((node, np.flatnonzero(first), n - n1, n1, one))


def shorter(level: Level, depth: int) -> tuple[Level, np.ndarray]:
    """The level one byte shallower and each entry's place in it."""
    keys, place = np.unique(level.keys & np.uint64((1 << 8 * depth) - 1), return_inverse=True)
    return Level(keys, np.bincount(place, weights=level.counts, minlength=len(keys))), place


def weigh(level: Level, j: int, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """ln P_w of the nodes of bit j and the weight of their own estimates; children: sums of ln P_w, None for leaves."""
    _, _, n0, n1, _ = level.bits[j]
    own = log_kt(n0, n1)
    if children is None:
        return own, np.ones(len(own))
    both = np.logaddexp(own, children) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


def estimates(level: Level, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry: the node's estimate for its bit j, and whether the node was met."""
    node, _, n0, n1, one = level.bits[j]
    n = n0 + n1
    return (np.where(one, n1[node], n0[node]) + 0.5) / (n[node] + 1), n[node] > 0


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
    """Mixtures down from depth ``top``: (entries x 8, NaN where the top node was not met), and ln P_w sums of the level above, by (context << 8 | node)."""
    levels, places = {depth: Level(keys, counts)}, {}
    for d in range(depth, top - 1, -1):
        levels[d - 1], places[d] = shorter(levels[d], d)
    mixed = np.empty((len(keys), 8), np.float64)
    above: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for j in range(8):
        children, weights = None, {}
        for d in range(depth, top - 1, -1):
            lw, weights[d] = weigh(levels[d], j, children)
            parent = levels[d - 1].bits[j][0][places[d][levels[d].bits[j][1]]]
            children = np.bincount(parent, weights=lw, minlength=len(levels[d - 1].bits[j][1]))
        _, first, n0, n1, _ = levels[top - 1].bits[j]
        k = levels[top - 1].keys[first]
        node = ((k & np.uint64(255)) >> np.uint64(8 - j)) | np.uint64(1 << j)
        above.append(((k >> EIGHT << EIGHT) | node, n0, n1, children))
        p, met = estimates(levels[top], j)
        # down from the top: what is left of the weight goes to the next longer context, as far as it was met
        at = {depth: np.arange(len(keys))}
        for d in range(depth, top, -1):
            at[d - 1] = places[d][at[d]]
        p, met = estimates(levels[depth], j)
        p, met = p.copy(), met.copy()
        for d in range(depth - 1, top - 1, -1):
            q, seen = estimates(levels[d], j)
            w = weights[d][levels[d].bits[j][0]]
            q, seen, w = q[at[d]], seen[at[d]], w[at[d]]
            p = np.where(met, w * q + (1 - w) * p, q)
            met = seen
        mixed[:, j] = np.where(met, p, np.nan)
    return mixed, [np.concatenate(x) for x in zip(*above, strict=True)]


def byte_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | byte) of every byte of every text and of a closing zero byte, zeros before the text; and the text's number (of 65,536 texts at most)."""
    pad = b"\0" * depth
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + depth + 1
    keys = np.zeros(len(data), np.uint64)
    for j in range(depth + 1):
        keys[depth:] <<= EIGHT
        keys[depth:] |= data[j : len(data) - depth + j]
    coded = np.ones(len(data), bool)
    starts = np.cumsum(sizes) - sizes
    for j in range(depth):
        coded[starts + j] = False
    return keys[coded], np.repeat(np.arange(len(texts), dtype=np.uint16), sizes - depth)


def _dealt(numbers: np.ndarray, parts: int) -> np.ndarray:
    return ((numbers * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the whole string: asks of one string meet, and no context is hot."""
    return _dealt(keys, buckets)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the last two context bytes."""
    return _dealt((keys >> EIGHT) & np.uint64(0xFFFF), shards)


def _parts(own: np.ndarray) -> list[np.ndarray]:
    """The places of each part, parts and places ascending."""
    order = np.argsort(own, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(own) else []


def held_out(doc_id, fold: int = 2, folds: int = 7) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _pack(block_bytes: int):
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, texts, room = [], [], block_bytes

        def row():
            data = zstandard.compress(b"".join(texts), 1)
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{number}"]), pa.array([ids], pa.list_(pa.int64())), pa.array([[held_out(i) for i in ids]], pa.list_(pa.bool_())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=[f.split()[0] for f in BLOCK.split(", ")])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                ids.append(i)
                texts.append(t.lower())
                room -= len(t) + 16
                if room <= 0 or len(ids) == 1 << 15:
                    yield row()
                    number += 1
                    ids, texts, room = [], [], block_bytes
        if ids:
            yield row()

    return run


def _texts(sizes, data: bytes) -> list[bytes]:
    raw, ends = zstandard.decompress(data), np.cumsum(sizes)
    return [raw[e - n : e] for n, e in zip(sizes, ends.tolist(), strict=True)]


def _distinct_keys(keys: np.ndarray, marks: np.ndarray, buckets: int):
    """Distinct keys and the marked count of each, by bucket: (bucket, keys, counts). Six-byte keys leave room for the mark; they are changed in place."""
    keys <<= np.uint64(1)
    keys |= marks
    keys.sort()
    marks = (keys & np.uint64(1)).astype(bool)
    keys >>= np.uint64(1)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.add.reduceat(marks, first, dtype=np.int64)
    own = keys[first]
    bucket = bucket_of(own, buckets)
    return [(int(bucket[g[0]]), own[g], counts[g]) for g in _parts(bucket)]


def _words_by_bucket(words, buckets: int) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for w in sorted(words):
        out.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return out


def _ask(depth: int, buckets: int):
    names = [f.split()[0] for f in ASKED.split(", ")]

    def run(batches):
        for b in batches:
            for block, held, sizes, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                texts, rows = _texts(sizes, data), []
                keys, number = byte_keys(texts, depth)
                marks = (~np.array(held, bool))[number]
                for bucket, own, counts in _distinct_keys(keys, marks, buckets):
                    rows.append(("bytes", bucket, block, pack_sorted(own), pack_array(counts.astype(np.uint32))))
                del keys, number, marks
                train, rest = Counter(), set()
                for t, h in zip(texts, held, strict=True):
                    (rest if h else train).update(t.split())
                for bucket, words in _words_by_bucket(rest.union(train), buckets).items():
                    rows.append(("words", bucket, block, zstandard.compress(b"\n".join(words), 1), pack_array(np.array([train[w] for w in words], np.uint32))))
                if not rows:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=names)

    return run


def _count(shards: int):
    """A bucket's strings, each once: a row per block with what it wants, and (byte strings) a row per shard with keys and counts.

    The wanted places of byte strings are those in the order of (shard, key), in which the values come back.
    """
    schema = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.string()), ("wanted", pa.binary()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("vocabulary", pa.int64())])

    def run(key, table):
        kind, bucket = key[0].as_py(), key[1].as_py()
        blocks, asked = table["block"].to_pylist(), table["keys"].to_pylist()
        counts = [unpack_array(x, np.uint32).astype(np.int64) for x in table["counts"].to_pylist()]
        if kind == "words":
            total: dict[bytes, int] = {}
            words = [zstandard.decompress(x).split(b"\n") for x in asked]
            for ws, n in zip(words, counts, strict=True):
                for w, c in zip(ws, n.tolist(), strict=True):
                    total[w] = total.get(w, 0) + c
            out = [{"block": b, "wanted": pack_array(np.fromiter((total[w] for w in ws), np.uint64, len(ws)))} for b, ws in zip(blocks, words, strict=True)]
            out[0] |= {"tokens": sum(total.values()), "vocabulary": sum(c > 0 for c in total.values())}
        else:
            own = [unpack_sorted(x) for x in asked]
            keys, place = np.unique(np.concatenate(own), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate(counts)).astype(np.uint64)
            shard = shard_of(keys, shards)
            parts = _parts(shard)
            at = np.empty(len(keys), np.uint32)
            at[np.concatenate(parts)] = np.arange(len(keys), dtype=np.uint32)
            wanted = np.split(at[place], np.cumsum([len(x) for x in own])[:-1])
            out = [{"block": b, "wanted": pack_array(w)} for b, w in zip(blocks, wanted, strict=True)]
            out += [{"shard": int(shard[g[0]]), "keys": pack_sorted(keys[g]), "counts": pack_array(n[g])} for g in parts]
        return pa.Table.from_pylist([{"kind": kind, "bucket": bucket, **row} for row in out], schema)

    return run


def _weigh_shard(depth: int):
    """A shard's subtrees: mixtures of its strings, where those of each bucket stand, and the sums for the depths above."""
    schema = pa.schema([("shard", pa.int32()), ("buckets", pa.list_(pa.int32())), ("places", pa.list_(pa.binary())), ("model", pa.list_(pa.binary())), ("top", pa.list_(pa.binary()))])

    def run(key, table):
        own = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        keys = np.concatenate(own)
        order = np.argsort(keys)
        n = np.concatenate([unpack_array(x, np.uint64) for x in table["counts"].to_pylist()])[order].astype(float)
        keys = keys[order]
        place = np.empty(len(keys), np.uint32)
        place[order] = np.arange(len(keys), dtype=np.uint32)
        mixed, above = subtree(keys, n, depth, 2)
        lasts = ((keys >> EIGHT) & np.uint64(255)) << EIGHT | (keys & np.uint64(255))
        row = {
            "shard": key[0].as_py(),
            "buckets": table["bucket"].to_pylist(),
            "places": [pack_array(x) for x in np.split(place, np.cumsum([len(x) for x in own])[:-1])],
            "model": [pack_array(lasts.astype(np.uint16)), pack_array(mixed.astype(np.float32).ravel())],
            "top": [pack_array(x) for x in above],
        }
        return pa.Table.from_pylist([row], schema)

    return run


def _top_rows(batches):
    for b in batches:
        for top in b.column(0).to_pylist():
            node, n0, n1, lw = (unpack_array(x, t) for x, t in zip(top, (np.uint64, np.float64, np.float64, np.float64), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.array(n0), pa.array(n1), pa.array(lw)], names=["node", "n0", "n1", "lw"])


class Top:
    """Depths 0 and 1 as tables over (last byte, byte prefix): fixed size, made from the shards' sums."""

    def __init__(self, rows):
        n0, n1, below = (np.zeros((256, 256)) for _ in range(3))
        for r in rows:
            n0[r.node >> 8, r.node & 255], n1[r.node >> 8, r.node & 255], below[r.node >> 8, r.node & 255] = r.n0, r.n1, r.lw
        shape = n0.shape
        own = log_kt(n0.ravel(), n1.ravel()).reshape(shape)
        both = np.logaddexp(own, below) - math.log(2)
        self.n, self.w = (n0, n1), np.exp(own - math.log(2) - both)
        z0, z1 = n0.sum(0), n1.sum(0)
        root = log_kt(z0, z1)
        self.root, self.root_w = (z0, z1), np.exp(root - math.log(2) - (np.logaddexp(root, both.sum(0)) - math.log(2)))

    def log10(self, lasts: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """log10 probability of each entry's byte, given its last context byte and the mixtures of depth two and more."""
        context, byte = (lasts >> 8).astype(np.int64), (lasts & 255).astype(np.int64)
        out = np.zeros(len(lasts))
        for j in range(8):
            node, bit = (byte >> (8 - j)) | (1 << j), (byte >> (7 - j)) & 1
            n0, n1 = self.n[0][context, node], self.n[1][context, node]
            one = (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
            w = self.w[context, node]
            deep = mixed[:, j]
            p = np.where(np.isnan(deep), one, w * one + (1 - w) * deep)
            z0, z1 = self.root[0][node], self.root[1][node]
            zero = (np.where(bit == 1, z1, z0) + 0.5) / (z0 + z1 + 1)
            w = self.root_w[node]
            out += np.log10(np.where(n0 + n1 > 0, w * zero + (1 - w) * p, zero))
        return out


def _values(top: Top):
    """The log10 probabilities of a shard's strings, back to their buckets."""

    def run(batches):
        for b in batches:
            for shard, buckets, places, (lasts, mixed) in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                scores = top.log10(unpack_array(lasts, np.uint16), unpack_array(mixed, np.float32).reshape(-1, 8).astype(float)).astype(np.float32)
                data = [pack_array(scores[unpack_array(x, np.uint32)]) for x in places]
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([shard] * len(buckets), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "shard", "data"])

    return run


def _answer(wanted, values):
    """What each block asked a bucket for."""
    held = sorted(zip(values["shard"].to_pylist(), values["data"].to_pylist(), strict=True))
    scores = np.concatenate([unpack_array(x, np.float32) for _, x in held])
    answers = [pack_array(scores[unpack_array(x, np.uint32)]) for x in wanted["wanted"].to_pylist()]
    return pa.table([wanted["block"], wanted["kind"], wanted["bucket"], pa.array(answers, pa.binary())], names=["block", "kind", "bucket", "answer"])


def _score(depth: int, buckets: int, tokens: int, vocabulary: int, ends: int):
    unit = math.log10(tokens + vocabulary + 1)
    names = [f.split()[0] for f in SCORED.split(", ")]

    def run(blocks, answers):
        got = {(k, s): a for k, s, a in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["answer"].to_pylist(), strict=True)}
        out = []
        for ids, held, sizes, data in zip(blocks["doc_id"].to_pylist(), blocks["held"].to_pylist(), blocks["size"].to_pylist(), blocks["data"].to_pylist(), strict=True):
            texts = _texts(sizes, data)
            keys, number = byte_keys(texts, depth)
            # six-byte keys and the text's number share one integer: a plain sort brings equal keys together
            keys <<= np.uint64(16)
            keys |= number
            keys.sort()
            number = (keys & np.uint64(0xFFFF)).astype(np.uint16)
            keys >>= np.uint64(16)
            first = np.concatenate(([True], keys[1:] != keys[:-1]))
            own = keys[first]
            del keys
            bucket = bucket_of(own, buckets)
            logs = np.empty(len(own), np.float64)
            for g in _parts(bucket):
                logs[g] = unpack_array(got["bytes", int(bucket[g[0]])], np.float32)
            place = np.cumsum(first, dtype=np.int32)
            place -= 1
            scores = np.bincount(number, weights=logs[place], minlength=len(texts))
            del number, first, place, own, logs
            logs_of, unknown = {}, set()
            split = [t.split() for t in texts]
            for s, words in _words_by_bucket(set().union(*split), buckets).items():
                counts = unpack_array(got["words", s], np.uint64)
                logs_of.update(zip(words, np.log10(counts + 1.0).tolist(), strict=True))
                unknown.update(w for w, c in zip(words, counts.tolist(), strict=True) if not c)
            end = math.log10(ends + 1)
            for doc, h, words, size, score in zip(ids, held, split, sizes, scores.tolist(), strict=True):
                n = len(words) + 1
                missed = sum(map(unknown.__contains__, words)) if unknown else 0
                out.append((doc, h, n, n - missed - (ends == 0), tokens, sum(map(logs_of.__getitem__, words)) + end - n * unit, score, size))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        columns = zip(*out, strict=True) if out else [[]] * 8
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def score_documents(docs: DataFrame, depth: int = DEPTH, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", most_buckets: int = 1 << 14, most_shards: int = 512) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every row.

    The model learns from rows whose crc32(doc_id as text) mod 7 is not 2 (null doc_id: empty text). Texts are lower-cased
    (A-Z); null is empty. ``score`` is the log10 probability of the text's bytes and a closing zero byte; bits per
    byte are -score * log2(10) / (n_bytes + 1). Rows that repeat count each time. ``depth`` is 2 to 5. An empty table
    gives no rows; without training rows every bit has probability one half. Other columns are ignored, and texts may be of any
    length that a task can hold. There are as many buckets as blocks, up to ``most_buckets``; a bucket reads some 10 MB for
    each time that the blocks outnumber them.
    """
    if not 2 <= depth <= 5:
        raise ValueError("depth is 2 to 5")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = written(picked.mapInArrow(_pack(block_bytes), BLOCK), "blocks")
    n_blocks = blocks.count()
    buckets, shards = min(most_buckets, max(16, n_blocks)), min(most_shards, max(16, n_blocks))
    asked = blocks.mapInArrow(_ask(depth, buckets), ASKED)
    counted = written(asked.groupBy("kind", "bucket").applyInArrow(_count(shards), COUNTED), "counted")
    ends = blocks.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    sums = counted.agg(F.sum("tokens").alias("tokens"), F.sum("vocabulary").alias("vocabulary")).first()
    tokens, vocabulary = (sums.tokens or 0) + ends, (sums.vocabulary or 0) + (ends > 0)
    weighed = counted.where("shard is not null").select("shard", "bucket", "keys", "counts").groupBy("shard").applyInArrow(_weigh_shard(depth), SHARD)
    weighed = written(weighed, "shards")
    top = Top(weighed.select("top").mapInArrow(_top_rows, "node long, n0 double, n1 double, lw double").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "lw")]).collect())
    values = weighed.select("shard", "buckets", "places", "model").mapInArrow(_values(top), VALUES)
    wanted = counted.where("block is not null").select("kind", "bucket", "block", "wanted")
    answers = wanted.where("kind = 'bytes'").groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(_answer, ANSWER)
    answers = answers.unionByName(wanted.where("kind = 'words'").select("block", "kind", "bucket", F.col("wanted").alias("answer")))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(depth, buckets, tokens, vocabulary, ends), SCORED)
