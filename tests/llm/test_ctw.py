import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from oscilla.llm import ctw


def slow_scores(rows, depth):
    """The same model by walking a dictionary of nodes, bit by bit."""
    texts = [(d, bytes(t or "", "utf8").lower()) for d, t in rows]
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def steps(text):
        data = b"\0" * depth + text + b"\0"
        for i in range(depth, len(data)):
            for j in range(8):
                yield data[i - depth : i], (1 << j) | data[i] >> (8 - j), data[i] >> (7 - j) & 1

    for d, t in texts:
        if not ctw.held_out(d):
            for context, node, bit in steps(t):
                for k in range(depth + 1):
                    own = context[depth - k :]
                    counts[own, node][bit] += 1
                    if k:
                        children[own[1:], node].add(own)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighed(context, node):
        own = kt(*counts[context, node])
        if len(context) == depth:
            return own, 1.0
        both = np.logaddexp(own, sum(weighed(c, node)[0] for c in children[context, node])) - math.log(2)
        return both, math.exp(own - math.log(2) - both)

    def p(context, node, bit):
        if (b"", node) not in counts:
            return 0.5
        most = max(k for k in range(depth + 1) if (context[depth - k :], node) in counts)
        out = None
        for k in range(most, -1, -1):
            own = context[depth - k :]
            a = counts[own, node]
            q = (a[bit] + 0.5) / (sum(a) + 1)
            out = q if out is None else (w := weighed(own, node)[1]) * q + (1 - w) * out
        return out

    train = Counter()
    for d, t in texts:
        if not ctw.held_out(d):
            train.update([*t.split(), None])
    n, v = sum(train.values()), len(train)
    out = []
    for d, t in texts:
        words = [*t.split(), None]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words)
        out.append((d, ctw.held_out(d), len(words), sum(train[w] > 0 for w in words), n, base, sum(math.log10(p(*s)) for s in steps(t))))
    return out


def same(got, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
    want = sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5, atol=1e-5)


ROWS = [(1, "the cat sat on the mat"), (2, "The cat sat.\nthe dog"), (3, None), (4, ""), (None, "äöü the"), (5, "the cat sat on the mat"), (5, "the cat sat on the mat"), *((i, f"the {'cat dog mat'.split()[i % 3]} {i} sat") for i in range(10, 40))]


@pytest.mark.parametrize("depth", [2, 3, 5])
@pytest.mark.parametrize("block", [60, 1 << 20])
def test_equals_a_walk_over_nodes(spark, depth, block):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    same(ctw.score_documents(docs, depth, block).collect(), slow_scores(ROWS, depth))


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ctw.score_documents(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = [(held, "ab c")]
    r = ctw.score_documents(spark.createDataFrame(alone, "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert math.isclose(r.score, 5 * 8 * math.log10(0.5), rel_tol=1e-6)


@pytest.mark.parametrize("buckets,shards", [(1, 1), (3, 2), (64, 7)])
def test_hot_pair_long_text_and_other_columns(spark, buckets, shards):
    """One two-byte pair fills most texts, one text is long, and columns are named like those of the intermediate tables."""
    rows = [*((i, "ab" * 50) for i in range(20)), (20, "ab" * 3000), (21, "ba ab the ab"), (22, None), (23, "\u00e9\u4e2d " * 7)]
    docs = spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], "doc_id long, text string, kind string, bucket int, block binary").repartition(3)
    same(ctw.score_documents(docs, 5, 500, most_buckets=buckets, most_shards=shards).collect(), slow_scores(rows, 5))


def test_buckets_split_what_shards_hold():
    """A pair's strings are one shard and many buckets."""
    keys = np.arange(1 << 12, dtype=np.uint64) << np.uint64(24) | np.uint64(0x652000)
    assert len(set(ctw.shard_of(keys, 512))) == 1
    assert np.bincount(ctw.bucket_of(keys, 16).astype(int), minlength=16).max() < 2 * len(keys) / 16


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.5, 8, 100.5, 1e9])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


def test_beats_the_base_on_held_out_rows(spark):
    """Held-out accuracy needs some text to learn from: 25 MB of it."""
    rows = ctw.score_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
