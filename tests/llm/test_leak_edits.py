import pytest
from test_wordpiece_leaks import plain

from oscilla.llm import decontaminate

PAD = "some quite ordinary words stand here before and after it all"
COPY = "the old miller of the green valley takes his grain to market on every second monday and sells it for 40 dollars to the same merchant in Boston before he walks home"
PEOPLE = "Tom has 5 apples in his bag. Anna gives him 3 more of them. How many apples does he hold? Then Tom gives half to Anna and eats the rest."
ITEMS = [(1, COPY), (2, PEOPLE), (3, "Paul Smith, Mary Jones, Peter Brown and Susan White met Carl Black in Rome on May 3 1990")]
EDITS = [
    ("added", COPY.replace("every second", "every single second"), {1}),
    ("dropped", COPY.replace("on every second", "every second"), {1}),
    ("longer name", COPY.replace("Boston", "New York City").replace("40", "55"), {1}),
    ("half", COPY[: len(COPY) // 2], set()),
    ("apart", COPY.replace("every second", "every " + f"{PAD} " * 30 + "second"), set()),
]
CASES = [("upper", COPY.upper(), {1}), ("one capital", COPY.replace("market", "Market"), {1}), ("names", ITEMS[2][1], {3}), ("names upper", ITEMS[2][1].upper(), {3}), ("other names", "Carl Jones, Mary Black met Paul White in Rome on May 3 1990", set())]
STARTS = [
    ("names first", PEOPLE.replace("Tom", "Bob").replace("Anna", "Lisa").replace("5", "7").replace("3", "2"), {2}),
    ("mixed", PEOPLE.replace("Then Tom", "Then Carl").replace("Tom", "Bob").replace("Anna gives", "Lisa gives").replace("to Anna", "to Eve").replace("5", "7"), set()),
]


@pytest.mark.parametrize("cases", [EDITS, CASES, STARTS], ids=["edits", "case", "starts"])
def test_leaks(spark, cases):
    docs = spark.createDataFrame([(i, f"{PAD}. {t} {PAD}") for i, (_, t, _) in enumerate(cases)], "doc_id long, text string")
    got = {}
    for r in decontaminate.leak_report(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect():
        got.setdefault(cases[r.doc_id][0], set()).add(r.item_id)
    assert got == {name: want for name, _, want in cases if want}


def test_one_capital_does_not_hide_a_copy(spark):
    docs = spark.createDataFrame([(4, "what is the CAPITAL of the small, green island")], "doc_id long, text string")
    items = spark.createDataFrame([(2, "What is the capital of the small green island?")], "item_id long, text string")
    assert [(r.item_id, r.coverage, r.exact) for r in decontaminate.leak_report(docs, items).collect()] == [(2, 1.0, True)]


def test_verbatim_passages_of_the_larger_table_are_found(spark):
    """In any case of letters."""
    d = "/root/testdata/sf0.1"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    texts = [(r.doc_id, f" {' '.join(plain(r.text))} ") for r in docs.collect()]
    own = [(r.item_id, f" {' '.join(plain(r.text))} ") for r in items.collect()]
    want = {(d, i) for i, x in own for d, t in texts if x in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leak_report(docs, items).collect()}
    print(len(want), len(got), len(want - got))
    assert want and want <= got


NUMBERS = [(1, "Compute 3 + 4 * 5 - 6 / 2 + 7 - 8 * 9 and tell what it makes."), (2, "Sum 15, 22, 31, 44, 58 and 63."), (3, "Is 17 * 23 + 12 more than 400 - 9 or not?")]


def test_items_of_mostly_numbers_are_found_with_other_numbers(spark):
    """The same numbers where the item has the same; tables of numbers and like sentences are left alone."""
    cases = [
        ("Compute 13 + 14 * 15 - 16 / 12 + 17 - 18 * 19 and tell what it makes.", {1}),
        ("Sum 5, 2, 3, 4, 8 and 6.", {2}),
        ("Is 11 * 21 + 31 more than 500 - 7 or not?", {3}),
        ("Sum 5, 2, 5, 4, 8 and 6.", set()),
        ("Compute 1 + 1 * 2 - 3 / 4 + 5 - 6 * 7 and tell what it makes.", set()),
        ("12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29 30", set()),
        ("we met 5, 2, 3, 4, 8 and 6 of them.", set()),
    ]
    docs = spark.createDataFrame([(i, f"{PAD}. {t} {PAD}.") for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {}
    for r in decontaminate.leak_report(docs, spark.createDataFrame(NUMBERS, "item_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    assert got == {i: want for i, (_, want) in enumerate(cases) if want}


def test_what_stands_in_every_item_makes_no_pairs(spark):
    """Boilerplate alone is no candidate; beside the item's own words it is covered, and items that are all alike are still found."""
    plate = "please read the next question with care and then give a short answer of yes or no to it all"
    own = lambda i: f"does the w{i}a river reach the w{i}b town before w{i}c winter begins in earnest"
    items = [(i, f"{plate} {own(i)}") for i in range(60)] + [(100 + i, "how many legs do seven spiders and one old dog have together if none is hurt") for i in range(20)]
    docs = [(i, f"{PAD} {plate} {PAD}") for i in range(50)] + [(100, f"{PAD} {items[5][1]} {PAD}"), (101, f"{PAD} {items[70][1]} {PAD}")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leak_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(100, 5)} | {(101, 100 + i) for i in range(20)}


def test_many_repeats_in_one_text_take_time_in_proportion():
    """Places are tried against those near them only."""
    from time import perf_counter

    def hits(n):
        return [{"shift": 100 * k + 9 * (k % 2), "forms": 0, "at": 10 * (k % 2), "till": 10 * (k % 2) + 8, "equal": True, "pairs": []} for k in range(n)]

    took = []
    for n in (4000, 16_000):
        began = perf_counter()
        assert decontaminate.agreeing(hits(n), 30) is None
        took.append(perf_counter() - began)
    assert took[1] < 12 * took[0]
