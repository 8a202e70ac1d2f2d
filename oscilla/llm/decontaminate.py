"""Benchmark decontamination by templates.

Windows of eight tokens of the benchmark are hash-joined with those of the documents, in two forms. Literal windows hold the
words themselves, lower-cased. In template windows numbers, names (a run of them is one) and units are typed placeholders; a
capital that begins a sentence or line is a word in one template and a name in another. A placeholder's values (slots) must map
one to one from the item to the document: so a question with other numbers or names is caught, and one that only looks alike is
not. A document leaks an item if windows that lie near each other and agree cover 0.8 or more of the item's tokens; they need
not share one alignment, so words may be added or dropped between them.

A document leaks an item only if they share a window with a word in it, and is first met by key windows: of an item's windows with a word the
rarest (shared by the fewest items), up to where all its other windows cover less than 0.8 of its tokens. So whatever leaks an item meets one of
them, and what stands in every item makes no pairs unless it is 0.8 of one. Only where one meets are all windows of document and item compared.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, written

WINDOW = 8
COVER = 0.8
#: Items of fewer words are found where they stand as a line or sentences of their own.
LEAST_ITEM = 4
#: Templates are made of items of which so large a share are words.
LEAST_WORDS = 0.2
FILTER_BITS = 24
#: More than any number of items.
MOST = (1 << 63) - 1

# Units that follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs ms kb mb gb tb hz khz mhz ghz w kw mw v kv a pa kpa j kj cal kcal k c f usd eur gbp dollars euros pounds cents percent meters metres kilometers kilometres miles feet inches grams kilograms liters litres seconds minutes hours days weeks months years degrees".split()

LITERAL, NUMBER, NAME, UNIT, NONE, STOPS, BREAKS = 0, 1, 2, 3, 4, 8, 64
#: Forms of windows: words, templates where a capital that begins a sentence is a word, and where it is a name.
WORDS, PLAIN, NAMED = 0, 1, 2
CHUNK = 1 << 20
_NUMBER = r"[+-]?[$€£]?\p{Nd}[\p{Nd}.,:/]*(%|st|nd|rd|th)?"
_WITH_UNIT = rf"[+-]?\p{{Nd}}[\p{{Nd}}.,]*({'|'.join(sorted(UNITS, key=len, reverse=True))})"
_UNIT_ARRAY, _STOPS, _PAUSES, _CLOSERS = pa.array(UNITS), pa.array([".", "!", "?", ":"]), pa.array([",", ";"]), "\"')]”’»"
_EDGES = " \t\n\r\x0b\x0c.,;:!?\"'`()[]{}<>|*_~“”‘’«»…—–-"
_MARKS = {NUMBER: "<num>", NAME: "<name>", UNIT: "<unit>"}
_BASE = np.uint64(0x100000001B3)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(b" \t\n\r\v\f")] = True
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string; joins compare the strings too."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    offsets = offsets - offsets[0]
    # a polynomial in the bytes: prefix sums, and each word's part taken back to power 0
    ups = np.cumprod(np.full(len(data), _STEP)) if len(data) else np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * ups, dtype=np.uint64)))
    downs = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(data), _BACK)))) if len(data) else np.ones(1, np.uint64)
    h = (sums[offsets[1:]] - sums[offsets[:-1]]) * downs[offsets[:-1]]
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return h ^ (h >> np.uint64(29))


def word_features(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of distinct words: what templates hold (lower-case, without marks at the ends), kinds (with marks for words that end a sentence or stand before a comma), and hashes."""
    text = words.cast(pa.string())
    core = pc.utf8_trim(text, characters=_EDGES)
    low = pc.utf8_lower(core)
    is_ = lambda x: x.to_numpy(zero_copy_only=False)
    kind = np.where(is_(pc.utf8_is_upper(pc.utf8_slice_codeunits(core, 0, 1))), NAME, LITERAL) | (UNIT << 4) * is_(pc.is_in(low, _UNIT_ARRAY))
    odd = np.flatnonzero(~is_(pc.utf8_is_alpha(core)))
    own = low.take(pa.array(odd))
    number, measure = (is_(pc.match_substring_regex(own, f"^(?:{x})$")) for x in (_NUMBER, _WITH_UNIT))
    kind[odd] = np.where(number, NUMBER, np.where(measure, NUMBER | UNIT << 4, kind[odd]))
    end = pc.utf8_slice_codeunits(pc.utf8_rtrim(text, characters=_CLOSERS), -1)
    kind = np.where(is_(pc.equal(pc.binary_length(core), 0)), NONE, kind) | STOPS * is_(pc.is_in(end, _STOPS)) | BREAKS * is_(pc.is_in(end, _PAUSES))
    return low, kind.astype(np.uint8), _hashes(low)


_HASHES = _hashes(pa.array([_MARKS.get(k, "") for k in range(4)], pa.string()))


class Tokens:
    """The tokens of one form of some texts: the text's number, what they hash to, kinds, and the words from ``start`` to ``end`` that they stand for."""

    def __init__(self, form, text, hashes, kind, start, end, opens):
        self.form, self.text, self.hash, self.kind, self.start, self.end, self.opens = form, text, hashes, kind, start, end, opens

    def windows(self, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every window, and which ones are to be used: none over two texts, and of templates those that differ from other forms and have ``least`` words."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.full(n, size + 1000 * (self.form == WORDS), np.uint64)
        for j in range(size):
            h = (h ^ self.hash[j : j + n]) * _BASE + (h >> np.uint64(29))
        use = self.text[:n] == self.text[size - 1 :]
        if self.form == WORDS and size < LEAST_ITEM:
            use &= self.opens[:n] & np.append(self.opens, True)[size:]
        if self.form != WORDS:
            count = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[size:] - c[:-size]
            literal = count(self.kind == LITERAL)
            use &= (literal >= least) & (literal < size)
            if self.form == NAMED:
                use &= count(self.opens) > 0
        return h, use


class Texts:
    """The words of some texts, without those that are marks only."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        word = ~_IS_SPACE[raw]
        edge = np.diff(word.astype(np.int8), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        text = np.searchsorted(np.cumsum([0, *[len(t) + 1 for t in texts]]), start, side="right") - 1
        lines = np.searchsorted(np.flatnonzero(raw == 10), start)
        offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])]).dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        self.low, kinds, hashes = word_features(coded.dictionary)
        kind, hashes = kinds[at], hashes[at]
        first = np.zeros(len(at) + 1, bool)
        first[:-1] = np.diff(lines, prepend=-1) > 0
        first[1:-1] |= (kind[:-1] & STOPS) > 0
        keep = (kind & 7) != NONE
        # what a mark on its own opens, the next word opens
        opened = np.cumsum(first[:-1])[keep]
        self.text = text[keep]
        self.at, self.hash, self.first, self.breaks = at[keep], hashes[keep], np.diff(opened, prepend=0) > 0, (kind[keep] & BREAKS) > 0
        own, unit = (kind & 7)[keep], ((kind >> 4) & 3)[keep] == UNIT
        self.n = np.bincount(self.text, minlength=len(texts))
        self.n_words = np.bincount(self.text[(own == LITERAL) | (self.first & (own == NAME))], minlength=len(texts))
        self.base = np.cumsum(self.n) - self.n
        self.pos = np.arange(len(own)) - self.base[self.text]
        self.same = np.concatenate(([False], self.text[1:] == self.text[:-1]))[: len(own)]
        number = (own == NUMBER) & ~unit
        after = self.same & np.concatenate(([False], number[:-1]))[: len(own)]
        self.kind = np.where(unit & after & (own != NUMBER), UNIT, own)

    def form(self, form: int) -> Tokens:
        if form == WORDS:
            return Tokens(form, self.text, self.hash, np.zeros(len(self.at), np.uint8), self.pos, self.pos + 1, self.first)
        opens = self.first & (self.kind == NAME)
        kind = np.where(opens, LITERAL, self.kind) if form == PLAIN else self.kind
        name = kind == NAME
        joins = self.same & name & ~self.first
        joins[1:] &= name[:-1] & ~self.breaks[:-1]
        heads = np.flatnonzero(~joins)
        end = self.pos[np.append(heads[1:], len(kind)) - 1] + 1 if len(heads) else self.pos
        kind = kind[heads]
        return Tokens(form, self.text[heads], np.where(kind == LITERAL, self.hash[heads], _HASHES[np.minimum(kind, 3)]), kind, self.pos[heads], end, opens[heads])

    def row(self, tokens: Tokens, i: int, size: int) -> tuple[int, int, str, list[str]]:
        """First word, end, template and slots of a window."""
        kinds, base, to = tokens.kind[i : i + size].tolist(), self.base[tokens.text[i]], i + size - 1
        first = tokens.start[i]
        words = self.low.take(pa.array(self.at[base + first : base + tokens.end[to]])).to_pylist()
        own = [" ".join(words[s:e]) for s, e in zip((tokens.start[i : i + size] - first).tolist(), (tokens.end[i : i + size] - first).tolist(), strict=True)]
        template = " ".join(_MARKS.get(k, w) for k, w in zip(kinds, own, strict=True))
        return int(tokens.start[i]), int(tokens.end[to]), f"{int(tokens.form == WORDS)} {template}", [f"{k}:{w}" for k, w in zip(kinds, own, strict=True) if k]


WINDOWS = "id long, mark long, form int, size int, pos int, till int, n_tokens int, n_words int, h long, template string, slots array<string>"
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()))


def _chunks(ids: list, texts: list[bytes], room: int):
    at = size = 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size >= room or i == len(texts):
            yield ids[at:i], texts[at:i]
            at, size = i, 0


def template_windows(rows: DataFrame, id_col: str, text_col: str, sizes: list[int] | None = None, met: np.ndarray | None = None, least: int = 1) -> DataFrame:
    """Windows of every row in all forms. Without ``sizes``: WINDOW tokens, or all of a shorter text.

    pos, till and n_tokens count words, n_words those of the text that no template replaces. Templates with fewer than ``least`` such words are left out;
    so are those that are words only, as literal windows hold them, and those of under LEAST_ITEM tokens. ``met``: a
    table of bits (64 a word), by the upper bits of the hash, of the windows to keep.
    """
    shift = None if met is None else np.uint64(64 - (len(met).bit_length() + 5))

    def run(batches):
        for b in batches:
            for ids, raw in _chunks(b.column(0).to_pylist(), text_bytes(b.column(1)), CHUNK if sizes else 1):
                out, texts, marks = [], Texts(raw), {}
                for form in (WORDS, PLAIN, NAMED):
                    tokens = texts.form(form)
                    n = len(tokens.hash)
                    for size in sizes or [min(n, WINDOW)]:
                        if not size or (size < LEAST_ITEM and form != WORDS):
                            continue
                        h, use = tokens.windows(size, least)
                        if met is not None:
                            slot = h >> shift
                            use &= (met[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)) > 0
                        for i in np.flatnonzero(use).tolist():
                            k = int(tokens.text[i])
                            if k not in marks:
                                marks[k] = int(np.uint64(xxhash.xxh64_intdigest(raw[k], 42)).astype(np.int64))  # what F.xxhash64 gives
                            pos, till, template, slots = texts.row(tokens, i, size)
                            out.append((ids[k], marks[k], form, size, pos, till, int(texts.n[k]), int(texts.n_words[k]), int(h[i].astype(np.int64)), template, slots))
                            if len(out) > 20_000:
                                yield _batch(out)
                                out = []
                if out:
                    yield _batch(out)

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, WINDOWS)


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=[f.split()[0] for f in WINDOWS.split(", ")])


def agreeing(hits: list[dict], n: int) -> tuple[int, float, bool] | None:
    """Number of windows, coverage and exactness of the first place in the document where agreeing windows cover COVER of an item of n tokens.

    Windows of one alignment and form are taken together. Places are tried from the alignment that covers most; there, those within n tokens of it
    are added, the longest first, if their slots map one to one along with those before, or else their windows with equal slots.
    """
    units: dict[tuple, list[dict]] = {}
    for w in hits:
        units.setdefault((w["shift"], w["forms"]), []).append(w)
    over = lambda ws: {i for w in ws for i in range(w["at"], w["till"])}
    own = {k: over(ws) for k, ws in units.items()}
    shifts: dict[int, set] = {}
    for (shift, _), x in own.items():
        shifts.setdefault(shift, set()).update(x)
    # in order of shift, so that those near a place are a slice
    lined = sorted(units)
    for seed in sorted(shifts, key=lambda s: (-len(shifts[s]), s)):
        close = lined[bisect_left(lined, (seed - n,)) : bisect_left(lined, (seed + n + 1,))]
        if len(set().union(*(own[k] for k in close))) < COVER * n:
            continue
        there, back, covered, equal, windows = {}, {}, set(), set(), set()
        for k in sorted(close, key=lambda k: (k[0] != seed, -len(own[k]), k)):
            pairs = {(p["i"], p["d"]) for w in units[k] for p in w["pairs"]}
            t, r = {**there, **dict(pairs)}, {**back, **{d: i for i, d in pairs}}
            agrees = all(there.get(i, d) == d and back.get(d, i) == i and t[i] == d and r[d] == i for i, d in pairs)
            if agrees:
                there, back = t, r
            for w in units[k]:
                if agrees or w["equal"]:
                    span = range(w["at"], w["till"])
                    covered.update(span)
                    windows.add((w["at"], w["till"]))
                    if w["equal"]:
                        equal.update(span)
        if len(covered) >= COVER * n:
            return len(windows), round(len(covered) / n, 6), equal == covered
    return None


def _told(batches):
    for b in batches:
        found = [agreeing(hits, n) for hits, n in zip(b.column("hits").to_pylist(), b.column("item_tokens").to_pylist(), strict=True)]
        good = [i for i, x in enumerate(found) if x]
        keys, told = b.take(pa.array(good, pa.int64())), [found[i] for i in good]
        cols = [pa.array([x[k] for x in told], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*(keys.column(c) for c in ("id", "mark", "item_id")), *cols], names=["doc_id", "mark", "item_id", "n_windows", "coverage", "exact"])


def window_bits(items: DataFrame, bits: int) -> np.ndarray:
    """Of 2 ** bits slots, by the upper bits of h, those that a window takes: 64 a word, at most 2 ** (bits - 6) rows for the driver."""
    slot = F.shiftrightunsigned("h", 64 - bits)
    words = items.groupBy(F.shiftrightunsigned(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("taken"))
    out = np.zeros(1 << bits - 6, np.int64)
    for r in words.collect():
        out[r.word] = r.taken
    return out.view(np.uint64)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, mark, item_id, n_windows, coverage and exact of every leak; mark is a hash of the text, exact says that windows with equal slots cover as much.

    An item of fewer than four words leaks where it stands as a line or as whole sentences; one without a word never does. Null and
    empty texts leak nothing; an empty table on either side gives no rows; rows that repeat are one; a very long text is worked on whole, in time in
    proportion to its words. Of an alignment whose slots do not map one to one only windows with equal slots count. Items with fewer than LEAST_WORDS of
    their tokens words are found by their words only. Text that is COVER of many items leaks each of them: a row a pair. Document windows are filtered by a table of 2 ** ``filter_bits`` bits
    (6 at least) of the benchmark's before the join decides: a fixed size, whatever the benchmark's.
    """
    every = template_windows(benchmark, item_col, item_text, least=0).where((F.col("form") == WORDS) | (F.col("n_words") >= LEAST_WORDS * F.col("n_tokens")))
    every = every.select(F.col("id").alias("item_id"), F.col("form").alias("item_form"), "size", F.col("pos").alias("at"), F.col("till").alias("item_till"), F.col("n_tokens").alias("item_tokens"), "h", "template", F.col("slots").alias("item_slots"), (F.size("slots") < F.col("size")).alias("worded")).distinct()
    every = written(every, "item-windows")
    shared = every.groupBy("size", "h", "template").agg(F.count_distinct(F.coalesce("item_id", F.lit(-1))).alias("sharing"))
    counted = every.join(shared, ["size", "h", "template"])
    # without windows shared by ``upto`` items or fewer, fewer tokens than needed are covered; a window without a word is never left out
    spots = counted.select("item_id", "item_tokens", F.when(F.col("worded"), F.col("sharing")).otherwise(MOST).alias("sharing"), F.explode(F.sequence("at", F.col("item_till") - 1)).alias("spot"))
    spots = spots.groupBy("item_id", "item_tokens", "spot").agg(F.max("sharing").alias("sharing"))
    needed = F.ceil(COVER * F.col("item_tokens")).cast("int")
    upto = spots.groupBy("item_id", "item_tokens").agg(F.sort_array(F.collect_list("sharing"), asc=False).alias("s")).select(F.col("item_id").alias("of"), F.col("item_tokens").alias("of_tokens"), F.get("s", needed - 1).alias("upto"))
    counted = counted.join(upto, counted["item_id"].eqNullSafe(upto["of"]) & (counted["item_tokens"] == upto["of_tokens"])).where("upto is not null")
    items = written(counted.withColumn("key", F.col("worded") & (F.col("sharing") <= F.col("upto"))).drop("sharing", "worded", "of", "of_tokens", "upto"), "items")
    keys = items.where("key")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    met = template_windows(docs, id_col, text_col, sizes or [WINDOW], window_bits(keys, filter_bits)).select("id", "mark", "size", "h", "template")
    candidates = written(met.join(keys.select("item_id", "item_tokens", "size", "h", "template").distinct(), ["size", "h", "template"]).select("id", "mark", F.struct("item_id", "item_tokens").alias("item")).distinct(), "candidates")
    # documents with a candidate are looked at again, with all windows
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["mark"] == b["mark"])
    which = candidates.select("id", "mark").distinct()
    near = own.join(which, same(own, which), "left_semi").select("id", "text")
    found = template_windows(near, "id", "text", sizes or [WINDOW], window_bits(items, filter_bits), 0).drop("n_tokens", "n_words")
    paired = found.join(candidates, same(found, candidates)).select(found["*"], "item.*")
    of_item = paired["item_id"].eqNullSafe(items["item_id"]) & (paired["item_tokens"] == items["item_tokens"])
    hits = paired.join(items, of_item & (paired["size"] == items["size"]) & (paired["h"] == items["h"]) & (paired["template"] == items["template"])).drop(paired["item_id"], paired["item_tokens"], paired["size"], paired["h"], paired["template"])
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    hit = F.struct((F.col("pos") - F.col("at")).alias("shift"), (3 * F.col("item_form") + F.col("form")).alias("forms"), "at", F.col("item_till").alias("till"), (F.col("slots") == F.col("item_slots")).alias("equal"), pairs.alias("pairs"))
    grouped = hits.groupBy("id", "mark", "item_id", "item_tokens").agg(F.collect_set(hit).alias("hits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.transform("hits", lambda w: F.struct(w["at"].alias("at"), w["till"].alias("till")))), lambda w: F.sequence(w["at"], w["till"] - 1)))))
    return grouped.where(covered >= COVER * F.col("item_tokens")).mapInArrow(_told, "doc_id long, mark long, item_id long, n_windows long, coverage double, exact boolean")


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it leaks: doc_id, item_id, n_windows, coverage, exact."""
    return leaks(docs.select("doc_id", "text"), benchmark).drop("mark")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that leak no item, with their columns, whatever these are called. An empty table stays empty."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    bad = leaks(rows, benchmark).select(F.col("doc_id").alias("id"), "mark").distinct()
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("id")) & (own == F.col("mark")), "left_anti").select("row.*")
