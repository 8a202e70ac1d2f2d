import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oscilla.llm import decontaminate, wordpiece

LETTERS = "abcd▁"


def slow_count(vocabulary, word, longest=14):
    """Longest match from the left, building pieces; longest: the length of the longest piece, or more."""
    n = at = 0
    while at < len(word):
        for to in range(min(len(word), at + longest), at, -1):
            if word[at:to] in vocabulary:
                n, at = n + 1, to
                break
        else:
            n, at = n + len(word[at].encode()), at + 1
    return n


@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=5), max_size=12), st.lists(st.text(alphabet="abcé", max_size=14), max_size=6))
@settings(max_examples=400, deadline=None)
def test_counts_equal_slow_greedy(vocabulary, words):
    automaton = wordpiece.Automaton(vocabulary)
    for w in words:
        assert automaton.count(w) == slow_count(vocabulary, w), (vocabulary, w)


def test_whole_table(spark, data):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=wordpiece.model_path())
    pieces = {model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    longest = max(map(len, pieces))
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (-1, ""), (-2, "\U0001f600 x\x00y ÿ"), (-3, "z" * 30000), (-3, "z" * 30000), (-4, "the" * 9000 + "é日" * 500), (-5, "in tern ation " * 40000)]
    got = wordpiece.token_counts(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")).collect()
    want = []
    for d, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        want.append((d, len(words), len((t or "").encode()), sum(slow_count(pieces, "▁" + w, longest) for w in words)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert wordpiece.token_counts(docs.where("false")).count() == 0


PAD = "some quite ordinary words stand here before and after it all"
ITEMS = [
    (1, "A train leaves Boston at 60 km per hour and after 3 hours it meets the train from Boston to Chicago."),
    (2, "What is the capital of the small green island?"),
    (3, "Too short."),
    (4, "one two three four five"),
    (5, None),
    (6, "Compute 3 + 4 * 5 - 6 / 2 = 7"),
    (7, "1776 1789 1815 1848 1871 1914 1939 1945 1989"),
    (8, "Paris"),
    (9, "..."),
]
DOCS = [
    (1, f"{PAD}. {ITEMS[0][1]} {PAD}", {1}),
    (2, f"{PAD}. A train leaves Denver at 75 km per hour and after 8 hours it meets the train from Denver to Omaha. {PAD}", {1}),
    (3, f"{PAD}. A train leaves Denver at 75 km per hour and after 8 hours it meets the train from Dallas to Omaha. {PAD}", set()),
    (4, "what is the CAPITAL of the small, green island", {2}),
    (5, f"{PAD} what is the capital of the small green island {PAD}", {2}),
    (6, "Too short. Too short.", {3}),
    (12, f"{PAD} too short and not alone", set()),
    (13, f"{PAD} compute 3 + 4 * 5 - 6 / 2 = 7 {PAD}", {6}),
    (14, f"{PAD}\n{ITEMS[6][1]} {PAD}", {7}),
    (15, f"- Paris\n{PAD}", {8}),
    (16, f"{PAD} Paris {PAD}", set()),
    (17, ITEMS[1][1].title(), {2}),
    (7, "zero one two three four five six", {4}),
    (8, None, set()),
    (9, "", set()),
    (10, PAD * 2000, set()),
    (11, f"{PAD}. A train leaves Denver at 75 km per hour and after 8 hours.", set()),
]


def test_templates(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in DOCS] + [(1, DOCS[0][1], "again"), (None, ITEMS[1][1], "n")], "doc_id long, text string, item_id string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for bits in (6, 12, 24):
        got = decontaminate.leaks(docs, items, filter_bits=bits).collect()
        by = {}
        for r in got:
            by.setdefault(r.doc_id, set()).add(r.item_id)
        assert by == {d: leak for d, _, leak in DOCS if leak} | {None: {2}}
        assert {r.doc_id: r.exact for r in got if r.item_id == 1} == {1: True, 2: False}
    kept = [r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()]
    assert sorted(kept) == sorted(d for d, _, leak in DOCS if not leak)
    assert decontaminate.leaks(docs, items.where("false")).count() == 0 and decontaminate.leaks(docs.where("false"), items).count() == 0


def test_every_item_is_found_verbatim(spark, data):
    """Each item pasted between other words (under four words: as a line of its own)."""
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    rows = [(r.item_id, f"{PAD}\n{r.text}\n{PAD}") for r in items.collect()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leak_report(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert {(i, i) for i, _ in rows} <= got


def test_dropping_leaves_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, ITEMS[1][1], 1, 2, 3, 4, 5), (2, PAD, 1, 2, 3, 4, 5)], "doc_id long, text string, __doc int, __mark int, mark int, row int, `a.b` int")
    assert decontaminate.drop_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == docs.where("doc_id = 2").collect()


def plain(text):
    return [w for w in re.findall(r"[^\W_]+", (text or "").lower())]


def test_verbatim_passages_are_found(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    texts = [(r.doc_id, " " + " ".join(plain(r.text)) + " ") for r in docs.collect()]
    want = {(d, r.item_id) for r in items.collect() for d, t in texts if f" {' '.join(plain(r.text))} " in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leak_report(docs, items).collect()}
    assert want and want <= got and len(got - want) <= 0.05 * len(want)


def test_what_many_items_share_is_found_where_it_covers_them(spark):
    """Against all windows of all pairs; no window that the leaking documents hold is in fewer than ten items."""
    part = lambda c, i: " ".join(f"{c}{i}{x}" for x in "abcdefghijklmno")
    tail = lambda k: " ".join(f"tail{k}{x}" for x in "abcdef")
    combined = [(i, j, k) for i in "pq" for j in "rst" for k in range(10)]
    items = [(n, f"{part('x', i)} {part('y', j)} {tail(k)}{i}{j}") for n, (i, j, k) in enumerate(combined)]
    docs = [f"{part('x', i)} {part('y', j)}" for i in "pq" for j in "rst"] + [part("x", "p"), f"{PAD} {part('y', 'r')} {part('x', 'p')}", f"{part('x', 'q')} {part('y', 's')[:-9]} {tail(4)}"]
    windows = lambda t: {tuple(w): range(k, k + 8) for k in range(len(t.split()) - 7) if (w := t.split()[k : k + 8])}
    want = set()
    for d, t in enumerate(docs):
        for n, x in items:
            covered = {at for w, own in windows(x).items() if w in windows(t) for at in own}
            if len(covered) >= 0.8 * len(x.split()):
                want.add((d, n))
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leak_report(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) == 70
