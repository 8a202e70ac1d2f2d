"""Language of documents by a linear-chain conditional random field over their words.

A word has features of its affixes and character n-grams (hashed, with marks at both ends), of the word itself and of a lexicon: the commonest
words of each language over all training documents. Weights of features and of transitions between languages are learned together, so a text that
switches between languages is labelled word by word. Forward-backward gives each word's probabilities; a document has the
language that most of its words are expected to have. A chain is a line, cut after CHAIN words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "und"
HELD_OUT = 5
CHAIN = 64
#: Bounds of what the weights are fitted on: documents a language, windows a document, words a window.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_WORDS = 400, 6, 24
#: Words of the lexicon a language, and how sure of one language they are.
LEXICON, SURE = 5000, (0.5, 0.8, 0.97)
PARTS = 64
BUCKETS = 1 << 16
NGRAMS = (2, 3, 4, 5)
STEPS, RATE, PENALTY = 60, 0.3, 1e-4
BLOCK = 1 << 22
SEED = 42

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x80:] = True
_IS_WORD[list(range(ord("A"), ord("Z") + 1)) + list(range(ord("a"), ord("z") + 1))] = True
_TIMES = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some lower-cased texts: the distinct ones, and for each word its number, text and chain."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        word = _IS_WORD[raw]
        edge = np.diff(word.astype(np.int8), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.text = np.searchsorted(starts, start, side="right") - 1
        line = np.searchsorted(np.flatnonzero(raw == 10), start)
        size = end - start
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])]).dictionary_encode()
        self.code, self.distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        # the place of each word in its line, then in its chain
        first = np.flatnonzero(np.diff(line, prepend=-1))
        place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
        self.place = place % CHAIN
        self.heads = np.flatnonzero(self.place == 0)
        self.sizes = np.diff(np.append(self.heads, len(start)))


def _digests(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))


@dataclass(frozen=True)
class Lexicon:
    """Hashes of words, ascending, and for each the number of its feature: language times levels of sureness."""

    hashes: np.ndarray
    feature: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        """The feature of each hash, -1 if it is no word of the lexicon."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.feature[at], -1)


def features(words: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The features of all words, one after another, and how many each has."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(words) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    begin = np.cumsum(size + 2) - size - 2
    marked = np.full(int((size + 2).sum()), ord("$"), np.uint64)
    marked[begin] = ord("^")
    inner = np.ones(len(marked), bool)
    inner[begin] = inner[begin + size + 1] = False
    marked[inner] = data
    owner = np.repeat(np.arange(len(words)), size + 2)
    last = np.repeat(begin + size + 2, size + 2)
    at, found, whose = np.arange(len(marked)), [], []
    h = np.full(len(marked), 7, np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        h = h[: len(marked) - n + 1]
        h = (h ^ marked[n - 1 :]) * _TIMES
        h ^= h >> np.uint64(31)
        if n in NGRAMS:
            whole = at[: len(h)] + n <= last[: len(h)]
            found.append((h[whole] % np.uint64(BUCKETS)).astype(np.int64))
            whose.append(owner[: len(h)][whole])
    digest = _digests(words)
    known = lexicon.of(digest)
    found += [(digest % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + known[known >= 0]]
    whose += [np.arange(len(words)), np.flatnonzero(known >= 0)]
    found, whose = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return found[order], np.bincount(whose, minlength=len(words))


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    lexicon: Lexicon
    weights: np.ndarray
    first: np.ndarray
    moves: np.ndarray

    def emissions(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of its features' weights for each word (each has one at least)."""
        out = np.empty((len(counts), len(self.langs)))
        starts = np.cumsum(counts) - counts
        for i in range(len(self.langs)):
            if len(counts):
                out[:, i] = np.add.reduceat(self.weights[:, i][found], starts)
        return out

    def marginals(self, words: Words, scores: np.ndarray, code: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each word's probabilities of the languages, and the sum over words of those of moves from one language to the next."""
        own = scores[words.code if code is None else code]
        if not own.size:
            return own, np.zeros_like(self.moves)
        own = np.exp(own - own.max(axis=1, keepdims=True))
        order = np.argsort(-words.sizes, kind="stable")
        heads, sizes = words.heads[order], words.sizes[order]
        live = [int(np.searchsorted(-sizes, -t, side="right")) for t in range(int(sizes.max(initial=0)) + 1)]
        top = max(float(self.moves.max()), float(self.first.max()))
        moves, first = np.exp(self.moves - top), np.exp(self.first - top)
        alpha, beta = np.zeros_like(own), np.ones_like(own)
        for t in range(len(live) - 1):
            at = heads[: live[t + 1]] + t
            x = own[at] * (first if t == 0 else alpha[at - 1] @ moves)
            alpha[at] = x / x.sum(axis=1, keepdims=True)
        pairs = np.zeros_like(moves)
        for t in range(len(live) - 2, 0, -1):
            at = heads[: live[t + 1]] + t
            x = own[at] * beta[at]
            back = x @ moves.T
            # alpha, the move and what follows: in proportion to the pair's probability
            scale = (alpha[at - 1] * back).sum(axis=1)
            pairs += (alpha[at - 1] / scale[:, None]).T @ x * moves
            beta[at - 1] = back / back.sum(axis=1, keepdims=True)
        both = alpha * beta
        return both / both.sum(axis=1, keepdims=True), pairs


def fit(windows: list[tuple[str, bytes]], langs: tuple[str, ...], lexicon: Lexicon, steps: int = STEPS) -> Model:
    """Weights from windows of words (language, text), half of which are joined with one of another language, so that moves between languages are seen."""
    rng = np.random.default_rng(SEED)
    order, texts, labels = rng.permutation(len(windows)), [], []
    number = {x: i for i, x in enumerate(langs)}
    at = 0
    while at < len(order):
        n = 2 if rng.random() < 0.5 and at + 1 < len(order) else 1
        chain = [windows[i] for i in order[at : at + n]]
        texts.append(b" ".join(t for _, t in chain))
        labels += [number[x] for x, t in chain for _ in Words([t]).code]
        at += n
    words, labels = Words(texts), np.array(labels, np.int64)
    found, counts = features(words.distinct, lexicon)
    owner = np.repeat(np.arange(len(counts)), counts)
    size, k = BUCKETS + len(langs) * len(SURE), len(langs)
    model = Model(langs, lexicon, np.zeros((size, k)), np.zeros(k), np.zeros((k, k)))
    if k < 2 or not len(labels):
        return model
    told = np.eye(k)[labels]
    firsts = told[words.heads].sum(axis=0)
    inside = words.place > 0
    moved = np.zeros((k, k))
    np.add.at(moved, (labels[:-1][inside[1:]], labels[1:][inside[1:]]), 1)
    square = [np.full_like(x, 1e-8) for x in (model.weights, model.first, model.moves)]
    for _ in range(steps):
        probable, pairs = model.marginals(words, model.emissions(found, counts))
        miss = told - probable
        by_word = np.stack([np.bincount(words.code, miss[:, i], len(counts)) for i in range(k)], axis=1)
        slopes = [np.stack([np.bincount(found, by_word[owner, i], size) for i in range(k)], axis=1), firsts - probable[words.heads].sum(axis=0), moved - pairs]
        parts = []
        for x, slope, s in zip((model.weights, model.first, model.moves), slopes, square, strict=True):
            slope = slope / len(labels) - PENALTY * x
            s += slope**2
            parts.append(x + RATE * slope / np.sqrt(s))
        model = replace(model, weights=parts[0], first=parts[1], moves=parts[2])
    return model


def _lower(column) -> list[bytes]:
    return [x or b"" for x in pc.utf8_lower(column.cast(pa.string())).cast(pa.binary()).to_pylist()]


def _blocks(texts: list[bytes], room: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts of some ``room`` bytes together, with their numbers; a longer one is cut between words."""
    at, own, held = [], [], 0
    for i, text in enumerate(texts):
        begin = 0
        while begin < len(text):
            end = begin + room
            # in steps, as a long text is cut often
            while end < len(text) and _IS_WORD[text[end]]:
                end += 1
            at.append(i)
            own.append(text[begin:end])
            held += len(own[-1])
            begin = end
            if held >= room:
                yield at, own
                at, own, held = [], [], 0
    if own:
        yield at, own


def _counted(batches):
    for b in batches:
        langs, texts = b.column(0).to_pylist(), _lower(b.column(1))
        for at, own in _blocks(texts, BLOCK):
            words = Words(own)
            names = sorted({langs[i] for i in at})
            lang = np.array([names.index(langs[i]) for i in at])[words.text]
            keys, n = np.unique(lang << 40 | words.code, return_counts=True)
            word = words.distinct.take(pa.array(keys & ((1 << 40) - 1))).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(keys >> 40)), word, pa.array(n)], names=["lang", "word", "n"])


def lexicon_of(labelled: DataFrame, size: int = LEXICON) -> tuple[dict[str, int], Lexicon, tuple[str, ...]]:
    """The lexicon of labelled (lang, text), and the languages; words are counted over all rows, and each language's first ``size`` go to the driver."""
    counts = labelled.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # the first ones of each part of a language, then of the language: no task ranks more than PARTS * size words
    part = F.pmod(F.xxhash64("word"), F.lit(PARTS)).alias("part")
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= size).drop("rank")
    top = first(first(counts.select("*", part), "lang", "part"), "lang").select("lang", "word", "n").toPandas()
    langs = tuple(sorted(top.lang.unique()))
    if not langs:
        return {}, Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64)), ()
    share = top.assign(part=top.n / top.groupby("lang").n.transform("sum"), code=top.lang.map({x: i for i, x in enumerate(langs)}))
    share["sure"] = share.part / share.groupby("word").part.transform("sum")
    best = share.sort_values(["sure", "lang"], ascending=[False, True]).drop_duplicates("word")
    best = best[best.sure > SURE[0]]
    level = np.searchsorted(SURE, best.sure.to_numpy(), side="left") - 1
    hashes = _digests(pa.array(best.word.tolist(), pa.string()).cast(pa.binary()))
    order = np.argsort(hashes)
    return dict(zip(langs, range(len(langs)), strict=True)), Lexicon(hashes[order], (best.code.to_numpy() * len(SURE) + level)[order]), langs


def sample_windows(labelled: DataFrame, docs: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """Windows of words of some ``docs`` rows of each language, by a hash of the row."""
    own = labelled.select("lang", "text", F.xxhash64("id", "text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # some more than asked for by the hash alone, then the first ones of each language
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * docs / n)))]) if sizes else F.lit(None)
    if not sizes:
        return []
    few = own.where((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")]).dropDuplicates(["lang", "h"])

    def run(batches):
        for b in batches:
            out = []
            for lang, h, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), _lower(b.column(1)), strict=True):
                at = np.frombuffer(text, np.uint8)
                for k in range(SAMPLE_WINDOWS):
                    # a window begins at the k-th part of the text
                    begin = len(text) * k // SAMPLE_WINDOWS
                    piece = text[begin : begin + 40 * SAMPLE_WORDS]
                    edge = np.flatnonzero(np.diff(_IS_WORD[at[begin : begin + len(piece)]].astype(np.int8), prepend=1 if begin and _IS_WORD[at[begin - 1]] else 0, append=0))
                    spans = edge[1:] if begin and _IS_WORD[at[begin - 1]] else edge
                    spans = spans[: len(spans) // 2 * 2].reshape(-1, 2)[:SAMPLE_WORDS]
                    if len(spans) > 1:
                        out.append((lang, h, b" ".join(piece[s:e] for s, e in spans.tolist())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["lang", "h", "window"])

    rank = F.dense_rank().over(W.partitionBy("lang").orderBy("h"))
    rows = few.select("lang", "text", "h").mapInArrow(run, "lang string, h long, window binary").withColumn("rank", rank).where(F.col("rank") <= docs)
    return sorted((r["lang"], bytes(r["window"])) for r in rows.collect())


def train(labelled: DataFrame) -> Model:
    """A model of the languages of labelled (id, lang, text); rows with a null language are left out."""
    known = labelled.where(F.col("lang").isNotNull())
    _, lexicon, langs = lexicon_of(known)
    return fit([x for x in sample_windows(known) if x[0] in langs], langs, lexicon)


def _shares(batches, model: Model):
    """For each batch the expected number of words of each language by text."""
    for b in batches:
        texts = _lower(b.column("text"))
        sums = np.zeros((len(texts), len(model.langs)))
        for at, own in _blocks(texts, BLOCK):
            words = Words(own)
            if len(words.code):
                probable, _ = model.marginals(words, model.emissions(*features(words.distinct, model.lexicon)))
                text = np.array(at)[words.text]
                for i in range(len(model.langs)):
                    sums[:, i] += np.bincount(text, probable[:, i], len(texts))
        yield b, sums


def predict(rows: DataFrame, model) -> DataFrame:
    """rows (id, held_out, text) with lang_pred and score, by a broadcast model; text leaves."""

    def run(batches):
        own = model.value
        names = np.array([*own.langs, UNKNOWN], object)
        for b, sums in _shares(batches, own):
            total = sums.sum(axis=1)
            told = (total > 0) & b.column("lettered").to_numpy(zero_copy_only=False)
            best = np.where(told, sums.argmax(axis=1), len(own.langs)) if len(own.langs) else np.zeros(b.num_rows, np.int64)
            score = np.where(told, sums.max(axis=1, initial=0) / np.where(total > 0, total, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(names[best], pa.string()), pa.array(np.minimum(score, 1.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return rows.select("id", "held_out", "text", lettered.alias("lettered")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_runs(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and runs of every row: the languages that its words most probably have, in order, as (lang, words)."""

    def run(batches):
        own = model.value
        for b in batches:
            out: list[list] = [[] for _ in range(b.num_rows)]
            for at, texts in _blocks(_lower(b.column(1)), BLOCK):
                words = Words(texts)
                if len(words.code) and own.langs:
                    best = own.marginals(words, own.emissions(*features(words.distinct, own.lexicon)))[0].argmax(axis=1)
                    for i, lang in zip(np.array(at)[words.text].tolist(), best.tolist(), strict=True):
                        if out[i] and out[i][-1]["lang"] == own.langs[lang]:
                            out[i][-1]["words"] += 1
                        else:
                            out[i].append({"lang": own.langs[lang], "words": 1})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())])))], names=["id", "runs"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "id long, runs array<struct<lang: string, words: long>>")


def document_languages(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the share of its words that lang_pred is expected to have) of every row.

    Rows whose crc32 of the id as text (null: empty) is divisible by ``held_out`` teach nothing, nor do those with a null language. A text that is
    null or has no letter is ``und`` with score 0; so is every text if nothing could be learned. Ties go to the first language by
    name. Long texts are worked on in blocks cut between words. Rows that repeat are told each; columns of other names are ignored; an empty table gives no rows.
    """
    text = F.col(f"`{text_col}`").cast("string")
    left_out = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % held_out == 0
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), text.alias("text"), left_out.alias("held_out"))
    model = train(rows.where(~F.col("held_out")))
    return predict(rows, docs.sparkSession.sparkContext.broadcast(model))
