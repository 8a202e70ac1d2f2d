"""Collocations by Toivonen's method: a sample proposes frequent phrases, a pass over all texts bounds these and their border, another counts.

A phrase can be frequent only if it is so without its last and without its first word. The sample's frequent phrases, by a
lowered count, are the proposal; its negative border are all phrases that are not proposed though both shorter ones are. The first full pass
counts both in buckets by a hash of the phrase, so that a bucket's sum is at least the count of each phrase in it. A border phrase whose
bucket reaches the least count shows that the sample may have fallen short. The second full pass counts, phrase by phrase, all that stands in such buckets and,
for whatever was not proposed, what grows from it at every length, so that one such pass closes the border. The result never depends on the sample or the hash.

Tasks are told what is proposed, and which buckets are full, by tables of bits whose size is fixed by that of the sample (2 ** MOST_BITS at
most). Phrases that share a bit are counted for nothing; what is counted is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pack_array, pack_sorted, text_bytes, unpack_array, unpack_sorted, written

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: One text in so many is in the sample, where a phrase met so often is proposed.
SAMPLE, SAMPLE_COUNT = 8, 4
#: Tables of bits have one for each so many bytes of the sample, within bounds; buckets are told by BUCKET_BITS bits of a hash.
BYTES_A_BIT, LEAST_BITS, MOST_BITS, BUCKET_BITS = 4, 16, 30, 40
#: Bytes of text that a task takes at a time, buckets that it gathers before it tells them, and bytes of text a shard of the buckets.
BLOCK, HELD, BYTES_A_SHARD, MOST_SHARDS = 1 << 20, 1 << 21, 1 << 18, 1 << 16
#: Parts by which the phrases of one language are ranked before the last ranking.
PARTS = 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BREAKS, _SPACES = b".,;:!?\n\v\f\r", b" \t"
_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.full(256, _WORD, np.uint8)
_KIND[list(_SPACES)], _KIND[list(_BREAKS)] = _SPACE, _BREAK
_MARK = b"[" + re.escape(_BREAKS + _SPACES) + b"]"
_CUT = re.compile(_MARK)
_TIMES = np.uint64(0x9E3779B97F4A7C15)

COUNTED = "lang string, phrase string, n long"


def _mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    x = (h ^ more) * _TIMES
    return x ^ (x >> np.uint64(29))


def _digests(values: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, values), np.uint64, len(values))


class Bits:
    """A set of buckets by one bit each, of a power of two."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - (len(words).bit_length() + 5))

    def slots(self, bucket: np.ndarray) -> np.ndarray:
        return (bucket * _TIMES) >> self.shift

    def has(self, bucket: np.ndarray) -> np.ndarray:
        slot = self.slots(bucket)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)) > 0


def _bucket(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - BUCKET_BITS)


def _blocks(langs: list[str], texts: list[bytes], words: int, size: int) -> Iterator[tuple[list[str], list[bytes], list[int]]]:
    """Texts of some ``size`` bytes together, each with the number of its bytes where a counted phrase may begin.

    A long text is cut at marks; the words that a phrase can need after the cut go along, but no phrase begins in them.
    """
    ahead = re.compile(b"(?:" + _MARK + b"*[^" + _MARK[1:] + b"+){0,%d}" % (words - 1))
    own: tuple[list, list, list] = ([], [], [])
    held = 0
    for lang, text in zip(langs, texts, strict=True):
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + size) if len(text) - at > size else None
            to = cut.start() if cut else len(text)
            till = ahead.match(text, to).end() if cut else to
            for x, y in zip(own, (lang, text[at:till], to - at), strict=True):
                x.append(y)
            held += till - at
            at = to
            if held >= size:
                yield own
                own, held = ([], [], []), 0
    if held:
        yield own


class Words:
    """The words of some texts: their bytes, each followed by one space, and for each its piece, language and whether phrases may begin there."""

    def __init__(self, langs: list[str], texts: list[bytes], room: list[int]):
        raw = np.frombuffer(b"\n".join([*texts, b""]).translate(_LOWER), np.uint8)
        kind = _KIND[raw]
        word = kind == _WORD
        begins, ends = word.copy(), ~word
        begins[1:] &= ~word[:-1]
        ends[1:] &= word[:-1]
        ends[0] = False
        keep = word | ends
        self.flat = np.where(word, raw, np.uint8(0x20))[keep]
        self.start, self.end = np.flatnonzero(begins[keep]), np.flatnonzero(ends[keep])
        at = np.flatnonzero(begins)
        self.piece = np.cumsum(kind == _BREAK)[at]
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        text = np.searchsorted(starts, at, side="right") - 1
        self.own = at < (starts[:-1] + room)[text] if len(texts) else np.zeros(0, bool)
        self.langs = sorted(set(langs))
        self.lang = np.fromiter(map(self.langs.index, langs), np.int64, len(langs))[text]
        offsets = pa.py_buffer(np.append(self.start, len(self.flat)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(self.start), [None, offsets, pa.py_buffer(self.flat)]).dictionary_encode()
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.hash = _digests([w[:-1] for w in coded.dictionary.to_pylist()])[self.code]

    def spans(self, first: np.ndarray, words: int) -> pa.Array:
        """The phrases of so many words that begin at these."""
        start, size = self.start[first], self.end[first + words - 1] - self.start[first]
        offsets = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
        return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.flat[at])])

    def counted(self, places: np.ndarray, keys: np.ndarray, words: int, wanted: np.ndarray) -> tuple[np.ndarray, list[pa.RecordBatch]]:
        """Numbers of the phrases at these places, equal where the keys are, and the counts of those that are wanted."""
        coded = pa.array(keys).dictionary_encode()
        ids = coded.indices.to_numpy().astype(np.int64)
        use = self.own[places] & wanted
        if not use.any():
            return ids, []
        n = np.bincount(ids[use], minlength=len(coded.dictionary))
        first = np.zeros(len(n), np.int64)
        first[ids[use]] = places[use]
        first = first[n > 0]
        return ids, [pa.RecordBatch.from_arrays([pa.array(self.langs, pa.string()).take(pa.array(self.lang[first])), self.spans(first, words), pa.array(n[n > 0])], names=["lang", "phrase", "n"])]


def _first_level(w: Words) -> tuple[np.ndarray, np.ndarray]:
    lang = _digests([x.encode() for x in w.langs])
    return np.arange(len(w.start)), _mixed(lang[w.lang], w.hash)


def _longer(w: Words, places: np.ndarray, good: np.ndarray, words: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of so many words begin both of whose shorter ones (at ``places``, with hashes h) are good, and their hashes. good: by word."""
    longer = places[good[places] & good[places + 1]]
    longer = longer[longer + words <= len(w.start)]
    longer = longer[w.piece[longer] == w.piece[longer + words - 1]]
    return longer, _mixed(h[np.searchsorted(places, longer)], w.hash[longer + words - 1])


def _by_word(w: Words, places: np.ndarray, values: np.ndarray, kind=bool) -> np.ndarray:
    out = np.zeros(len(w.start) + 1, kind)
    out[places] = values
    return out


def _buckets(w: Words, proposed: Bits | None, least: int, most: int) -> Iterator[np.ndarray]:
    """Buckets of all phrases of ``least`` to ``most`` words that begin here and whose shorter ones are proposed."""
    places, h = _first_level(w)
    for words in range(1, most + 1):
        if words > 1:
            places, h = _longer(w, places, _by_word(w, places, proposed.has(_bucket(h))), words, h)
        if words >= least:
            yield _bucket(h[w.own[places]])


def _exact(w: Words, proposed: Bits, full: Bits, most: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases in full buckets, and of all phrases that were not met by the first pass as a shorter one was not proposed; '' counts words."""
    places, h = _first_level(w)
    total = np.bincount(w.lang[w.own], minlength=len(w.langs))
    yield pa.RecordBatch.from_arrays([pa.array(w.langs, pa.string()), pa.array([""] * len(w.langs)), pa.array(total)], names=["lang", "phrase", "n"])
    keys, met = (w.lang << 32 | w.code).astype(np.uint64), np.ones(len(places), bool)
    for words in range(1, most + 1):
        if words > 1:
            before = _by_word(w, places, met & proposed.has(_bucket(h)))
            number = _by_word(w, places, ids, np.uint64)
            places, h = _longer(w, places, _by_word(w, places, good), words, h)
            met = before[places] & before[places + 1]
            # a phrase is told by its words but for the last and its words but for the first
            keys = number[places] << np.uint64(32) | number[places + 1]
        if not len(places):
            return
        good = ~met | full.has(_bucket(h))
        ids, rows = w.counted(places, keys, words, good)
        yield from rows


def _worked(texts: DataFrame, block: int, work, schema: str) -> DataFrame:
    """work(stream of Words) for each task's texts (lang, text)."""

    def run(batches):
        parts = (x for b in batches for x in _blocks(b.column(0).to_pylist(), text_bytes(b.column(1)), MAX_WORDS, block))
        yield from work(w for w in (Words(*x) for x in parts) if len(w.start))

    return texts.select("lang", "text").mapInArrow(run, schema)


def bucket_sums(texts: DataFrame, proposed, words: tuple[int, int], least: int, shards: int, block: int) -> DataFrame:
    """(bucket, n) of the buckets that ``least`` phrases or more stand in, of those from words[0] to words[1] long whose shorter ones are proposed.

    Tasks tell their buckets by shard, as sorted arrays: a few bytes a phrase.
    """
    upper = np.uint64(BUCKET_BITS - (shards.bit_length() - 1))

    def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        shard, first = np.unique(keys >> upper, return_index=True)
        cut = [slice(a, b) for a, b in zip(first, np.append(first[1:], len(keys)), strict=True)]
        for at in range(0, len(cut), 512):
            some = cut[at : at + 512]
            yield pa.RecordBatch.from_arrays([pa.array(shard[at : at + 512].astype(np.int32)), pa.array([pack_sorted(keys[x]) for x in some], pa.binary()), pa.array([pack_array(n[x].astype(np.uint32)) for x in some], pa.binary())], names=["shard", "keys", "counts"])

    def work(stream):
        new = Bits(proposed.value) if proposed is not None else None
        held, size = [], 0
        for w in stream:
            for keys in _buckets(w, new, *words):
                held.append(keys)
                size += len(keys)
            if size >= HELD:
                yield from told(held)
                held, size = [], 0
        if size:
            yield from told(held)

    def summed(key, t):
        keys = np.concatenate([unpack_sorted(x) for x in t.column("keys").to_pylist()])
        n = np.concatenate([unpack_array(x, np.uint32) for x in t.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        n = np.add.reduceat(n[order], first)
        return pa.table({"bucket": pa.array(keys[n >= least].view(np.int64)), "n": pa.array(n[n >= least])})

    return _worked(texts, block, work, "shard int, keys binary, counts binary").groupBy("shard").applyInArrow(summed, "bucket long, n long")


def table_of(buckets: DataFrame, bits: int, known: np.ndarray | None = None) -> np.ndarray:
    """A table of 2 ** bits bits, 64 a word, of the buckets found and those known. The driver gets the table's words only."""
    out = np.zeros(1 << bits - 6, np.uint64) if known is None else known.copy()
    like = Bits(np.zeros(1 << bits - 6, np.uint64))

    def run(batches):
        for b in batches:
            slot = like.slots(b.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    new = buckets.select("bucket").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("taken")).toArrow()
    out[new.column("word").to_numpy()] |= new.column("taken").to_numpy().view(np.uint64)
    return out


def frequent_phrases(texts: DataFrame, min_count: int = MIN_COUNT, most: int = MAX_WORDS, sample: int = SAMPLE, sample_count: int = SAMPLE_COUNT, bits: int | None = None, block: int = BLOCK) -> DataFrame:
    """(lang, phrase, n) of all phrases of up to ``most`` words that occur ``min_count`` times or more in texts (lang, text, mark), and of '' by language.

    The sample are rows whose hashed mark is divisible by ``sample``; it decides how much work the passes are, not what they find.
    """
    send = texts.sparkSession.sparkContext.broadcast
    part = written(texts.where(F.pmod(F.xxhash64("mark"), F.lit(sample)) == 0), "phrase-sample")
    size = part.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    bits = bits or min(max((size // BYTES_A_BIT).bit_length(), LEAST_BITS), MOST_BITS)
    shards = lambda n: 1 << min(max((n // BYTES_A_SHARD).bit_length(), 4), MOST_SHARDS.bit_length() - 1)
    table = None
    for words in range(1, most):
        found = bucket_sums(part, None if table is None else send(table), (words, words), sample_count, shards(size), block)
        table = table_of(found, bits, table)
    proposed = send(table)
    full = send(table_of(bucket_sums(texts, proposed, (1, most), min_count, shards(size * sample), block), bits))

    def work(stream):
        new, reached = Bits(proposed.value), Bits(full.value)
        for w in stream:
            yield from _exact(w, new, reached, most)

    counts = _worked(texts, block, work, COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return written(counts.where((F.col("n") >= min_count) | (F.col("phrase") == "")), "phrases")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", min_count: int = MIN_COUNT, most: int = MAX_WORDS, top: int = TOP, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and these at spaces and tabs into words. A phrase of
    two words or more that occurs a >= min_count times scores floor(1000 a n / (l r)) at its lowest-scoring cut, where l and r are the
    counts of the cut's sides and n is that of all words; products are decimals of 38 digits. A phrase that stands inside a longer one as frequent is
    dropped. A null language is ``und``, a null text is empty. Every row counts, so rows that repeat count again; columns
    of other names are ignored. An empty table, and one without a phrase so frequent, gives no rows. Very long texts are counted
    in blocks that overlap by the words a phrase can need. ``how``: see frequent_phrases.
    """
    col = lambda c: F.col(f"`{c}`").cast("string")
    texts = docs.select(F.coalesce(col(lang_col), F.lit("und")).alias("lang"), F.coalesce(col(text_col), F.lit("")).alias("text"), F.xxhash64(col(id_col), col(text_col)).alias("mark"))
    counts = frequent_phrases(texts, min_count, most, **how)
    known = counts.where("phrase <> ''")
    words = F.split("phrase", " ")
    long = known.where(F.size(words) > 1).select("lang", "phrase", F.col("n").alias("a"), words.alias("w"))
    # a longer phrase as frequent as one inside it is so through one with a single word more
    inside = long.where(F.size("w") > 2).select("lang", "a", F.explode(F.array(*[F.array_join(F.slice("w", at, F.size("w") - 1), " ") for at in (1, 2)])).alias("phrase")).distinct()
    kept = long.join(inside, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.lit(most)), " ").alias("right"))
    side = lambda part, n: known.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    totals = counts.where("phrase = ''").select("lang", "n")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = scored.withColumns({"above": whole("a") * whole("n") * 1000, "below": whole("l") * whole("r")}).withColumn("score", F.expr("above div below"))
    least = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    rows = least.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = rows.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


REPORT_SQL = rf"""
with base as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from base),
words as (select lang, [x for x in regexp_split_to_array(p, '[\x20\x09]+') if x <> ''] as w from pieces),
total as (select lang, sum(len(w)) as n from words group by lang),
grams as ({" union all ".join(f"select lang, {k} as k, unnest([array_to_string(w[i:i + {k - 1}], ' ') for i in range(1, len(w) - {k - 2})]) as phrase from words where len(w) >= {k}" for k in range(1, MAX_WORDS + 1))}),
f as (select lang, k, phrase, count(*) as a from grams group by lang, k, phrase having count(*) >= {MIN_COUNT}),
kept as (select * from f where k > 1 and not exists (select 1 from f g where g.lang = f.lang and g.k > f.k and 100 * g.a >= 100 * f.a and contains(' ' || g.phrase || ' ', ' ' || f.phrase || ' '))),
cuts as (select c.lang, c.phrase, c.a, x.i, array_to_string(string_split(c.phrase, ' ')[1:x.i], ' ') as s, array_to_string(string_split(c.phrase, ' ')[x.i + 1:], ' ') as e from kept c join (select unnest(range(1, {MAX_WORDS})) as i) x on x.i < c.k),
scored as (select c.lang, c.phrase, c.a, c.i, l.a as l, r.a as r, n, (1000::hugeint * c.a * n) // (l.a::hugeint * r.a) as score
  from cuts c join f l on l.lang = c.lang and l.phrase = c.s join f r on r.lang = c.lang and r.phrase = c.e join total t on t.lang = c.lang),
least as (select * from scored qualify row_number() over (partition by lang, phrase order by score, i) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from least qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= {TOP}
"""
