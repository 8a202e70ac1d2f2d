import importlib.util

import duckdb
import pytest

from oscilla.llm import quality
from oscilla.llm.queries import ORACLE, QUERIES



def duck(docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return con


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.class_distance, r.word_distance) for r in df.collect()), key=str)


CASES = [
    (-1, "en", None),
    (-2, "en", ""),
    (-3, "en", "word " * 49),
    (-4, "en", "\x0b".join(f"w{i}" for i in range(60))),
    (-5, None, "the cat of the dog " * 30),
    (-6, "xx", "$$$ ### zz " * 60),
    (-7, "de", "der die und \n\n der die und\n" * 3),
    (-8, "fr", "é\U0001f600ñ İ le la\x1cde " * 40),
    (-8, "fr", "é\U0001f600ñ İ le la\x1cde " * 40),
    (None, "es", "a b c d a b c x a b c"),
    (-9, "en", "in of the and " + "long " * 20000),
    (-10, "en", "###$$$ %%% " * 90),
]


def test_cases_equal_sql(spark, data):
    whole = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "text")
    docs = whole.unionByName(spark.createDataFrame(CASES, "doc_id long, lang string, text string")).repartition(3)
    got = rows(quality.quality_report(docs))
    want = duck(docs.toPandas()).execute(quality.report_sql()).fetchall()
    assert got == sorted(want, key=str)
    by = {r[0]: r for r in got}
    assert by[-4][1] == 60 and by[-5][5] == 150 and by[None][5] == 9 and by[-7][4] == 4
    assert quality.quality_report(docs.where("false")).count() == 0


def test_clean_documents_stay(spark, data):
    """Of labelled documents of good quality that pass the base rules, the distances reject none."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.quality_report(docs).join(labels, "doc_id").where("not base_failed")
    good = judged.where("quality = 1").groupBy("kept").count().collect()
    assert {r.kept for r in good} == {True}
    assert judged.where("quality = 0 and not kept").count() > 0


def test_columns_stay_and_extra_ones_do_no_harm(spark):
    docs = spark.createDataFrame([(1, "en", " ".join(f"the w{i} of" for i in range(30)), "m", 5, 7), (2, "en", "no", "m", 5, 7)], "doc_id long, lang string, text string, m string, kept int, row int")
    assert quality.keep_quality(docs).collect() == docs.where("doc_id = 1").collect()


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline_against_a_plain_version(spark, data):
    import corpus_pipeline
    from test_lines_chat import slow_lines
    from test_near import slow_near, slow_set
    from test_packing import check
    from test_wordpiece_leaks import plain
    from tokenizers import Tokenizer

    from oscilla.llm import wordbpe

    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet").collect()
    verdicts = duck(docs.toPandas()).execute(quality.report_sql()).fetchall()
    kept = {r[0] for r in verdicts if r[7]}
    texts = slow_lines([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept])
    ids = sorted(texts)
    sets, root = [slow_set(texts[i]) for i in ids], list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if root[i] != root[j] and slow_near(sets[i], sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    ids = [i for k, i in enumerate(ids) if root[k] == k]
    words = {i: f" {' '.join(plain(texts[i]))} " for i in ids}
    ids = [i for i in ids if not any(f" {' '.join(plain(x.text))} " in words[i] for x in items)]
    pieces = corpus_pipeline.run(spark, data).collect()
    assert {p.doc_id for p in pieces} == set(ids) and len(ids) < docs.count()
    tokenizer = Tokenizer.from_file(wordbpe.tokenizer_path())
    check([(i, texts[i]) for i in ids], pieces, tokenizer, 4096)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_dedup", "decontamination", "packing"]


def test_queries_and_sql_match_by_name():
    assert set(ORACLE) <= set(QUERIES) and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline_edges(spark, tmp_path):
    """Null and empty texts, an empty table and columns of any name."""
    import corpus_pipeline

    names = "doc_id long, text string, lang string, source string, n_chars long, row int, mark int, __own int, __doc int, key string, `a.b` int"
    long = " ".join(f"word{i}" for i in range(20000))
    rows = [(1, None, "en"), (2, "", "en"), (None, long, None), (3, long, "en"), (3, long, "en"), (4, "short", "en")]
    for name, some in (("rows", rows), ("none", [])):
        spark.createDataFrame([(*r, "s", 1, 1, 2, 3, 4, "k", 5) for r in some], names).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "What is the capital of the small green island?")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/rows").collect()
    assert {p.doc_id for p in pieces} == {3} and sum(p.length for p in pieces) == pieces[0].doc_tokens
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
