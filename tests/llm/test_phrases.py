import re
from collections import Counter

import numpy as np
import pytest

from oscilla.llm import phrases
from oscilla.llm.queries import QUERIES


def slow(rows, least, most=5, top=2000):
    """Every phrase of every row counted by itself."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if a >= least}
    dropped = {(lang, w[i:j]) for (lang, w), a in found.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and found[lang, w[i:j]] == a}
    out = []
    for lang in total:
        own = []
        for (x, w), a in found.items():
            if x == lang and len(w) > 1 and (x, w) not in dropped:
                score, _, left, right = min((1000 * a * total[lang] // (f[x, w[:k]] * f[x, w[k:]]), k, f[x, w[:k]], f[x, w[k:]]) for k in range(1, len(w)))
                own.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def told(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def corpus(n=400):
    rng = np.random.default_rng(5)
    words = ["of", "the", "New", "york", "Ünder", "x" * 70, "b", "c", "日本", "d e"]
    rows = []
    for i in range(n):
        text = "".join(words[int(x)] + str(rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "!"])) for x in rng.zipf(1.3, 60).clip(1, 10) - 1)
        rows.append((i if i % 9 else None, text, ["en", "fr", None, "und"][i % 4]))
    rows += [(9000 + i, "alpha beta gamma delta epsilon zeta", "en") for i in range(30)]
    return [*rows, (1, None, "en"), (2, "", None), (3, " \n.", "fr"), (4, "a b " * 3000, "de"), (4, "a b " * 3000, "de")]


@pytest.mark.parametrize("how", [{}, {"sample": 3, "sample_count": 9, "block": 700}, {"sample": 2, "sample_count": 10**6}, {"sample": 1, "sample_count": 20, "bits": 6, "block": 100}, {"sample": 2, "sample_count": 60}])
def test_equals_counting_everything(spark, how):
    """With samples that propose much, little or nothing, tables of bits that say yes too often, and blocks shorter than a text."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as n", "2 as phrase", "3 as mark").repartition(5)
    assert told(phrases.collocations(docs, min_count=20, **how)) == slow([(r[2], r[1]) for r in rows], 20)


def test_cut_to_the_first_of_a_language(spark):
    rows = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = told(phrases.collocations(docs, min_count=5, top=7))
    assert got == slow([(r[2], r[1]) for r in rows], 5, top=7) and max(r[1] for r in got) == 7


def test_empty_table_and_no_frequent_phrase(spark):
    docs = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    assert told(phrases.collocations(docs)) == [] and told(phrases.collocations(docs.where("false"))) == []


def test_whole_table(spark, data):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert told(QUERIES["op11_phrases"](spark, data)) == slow(rows, 100)
