import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from oscilla.llm import languages
from oscilla.llm.queries import QUERIES

EMPTY = languages.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def slow_marginals(model, scores):
    """Probabilities of a chain's labels by all paths."""
    n, k = scores.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        weight = model.first[path[0]] + sum(scores[t, c] for t, c in enumerate(path)) + sum(model.moves[a, b] for a, b in itertools.pairwise(path))
        out[np.arange(n), path] += np.exp(weight)
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_equals_all_paths(monkeypatch):
    """Chains of one to five words; lines and cut lines begin anew."""
    monkeypatch.setattr(languages, "CHAIN", 5)
    rng = np.random.default_rng(1)
    words = languages.Words([b"a b c\nd\n\ne f g h i j k", b"", b"123 l, m"])
    assert words.sizes.tolist() == [3, 1, 5, 2, 2] and words.text.tolist() == [0] * 11 + [2] * 2
    model = languages.Model(("x", "y", "z"), EMPTY, np.zeros((1, 3)), rng.normal(size=3), rng.normal(size=(3, 3)) * 2)
    scores = rng.normal(size=(len(words.distinct), 3)) * 3
    got, pairs = model.marginals(words, scores)
    for head, size in zip(words.heads, words.sizes, strict=True):
        at = slice(head, head + size)
        assert np.allclose(got[at], slow_marginals(model, scores[words.code[at]]))
    assert np.isclose(pairs.sum(), (words.sizes - 1).sum())


def test_features_of_a_word():
    found, counts = languages.features(pa.array([b"ab", b"\xc3\xa9"], pa.binary()), EMPTY)
    # ^a ab b$ ^ab ab$ ^ab$ and the word itself
    assert counts.tolist() == [7, 7] and found.max() < languages.BUCKETS
    again, _ = languages.features(pa.array([b"xyz", b"ab"], pa.binary()).slice(1), EMPTY)
    assert again.tolist() == found[:7].tolist()


@pytest.fixture(scope="module")
def learned(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id as id", "lang", "text")
    return spark.sparkContext.broadcast(languages.train(rows))


def test_switched_text_is_told_word_by_word(spark, data, learned):
    """Lines of two languages in turn."""
    rows = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").where("n_chars between 300 and 2000").collect():
        rows.setdefault(r.lang, []).append(" ".join(r.text.split()[:12]))
    pairs = [(a, b) for a in rows for b in rows if a < b]
    docs = [(i, " ".join((rows[a][i], rows[b][i], rows[a][i + 1]))) for i, (a, b) in enumerate(pairs)]
    right = total = 0
    for r in languages.language_runs(spark.createDataFrame(docs, "doc_id long, text string"), learned).collect():
        a, b = pairs[r.id]
        told = [x.lang for x in r.runs for _ in range(x.words)]
        want = [lang for lang, text in ((a, rows[a][r.id]), (b, rows[b][r.id]), (a, rows[a][r.id + 1])) for _ in languages.Words([text.lower().encode()]).code]
        right, total = right + sum(x == y for x, y in zip(told, want, strict=True)), total + len(want)
    assert right > 0.9 * total


def test_held_out_accuracy(spark, data):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = QUERIES["op12_languages"](spark, data)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    judged = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in judged) >= 0.97 * len(judged) > 10


def test_odd_rows(spark, data):
    known = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, "123 456 — «»", "fr"), (10**6 + 3, "The of and THE in to", None), (None, "the of and the in to", "zz"), (10**6 + 4, "the of and " * 600_000, "en"), (10**6 + 4, "x" * 5_000_000, "en")]
    docs = known.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).selectExpr("*", "1 as id", "2 as held_out", "3 as score")
    got = languages.document_languages(docs).where("doc_id is null or doc_id >= 1000000").collect()
    told = sorted((r.doc_id or 0, r.lang_pred) for r in got)
    assert told[:5] == [(0, "en"), (10**6, "und"), (10**6 + 1, "und"), (10**6 + 2, "und"), (10**6 + 3, "en")] and (10**6 + 4, "en") in told and len(told) == 7
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert languages.document_languages(docs.where("false")).collect() == []
    assert {r.lang_pred for r in languages.document_languages(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    assert {r.lang_pred for r in languages.document_languages(docs.where("lang = 'fr'")).collect()} == {"fr", "und"}
