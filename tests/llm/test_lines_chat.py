import duckdb
import pytest

from oscilla.llm import chat, lines


def duck(table, path):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{path}'")
    return con


def test_lines_equal_sql(spark, data):
    got = sorted(map(tuple, lines.line_report(spark.read.parquet(f"{data}/documents.parquet")).collect()))
    assert got == sorted(duck("documents", f"{data}/documents.parquet").execute(lines.REPORT_SQL).fetchall())
    assert any(r[2] for r in got)


def slow_lines(rows):
    """First occurrences by walking all windows in order of (doc_id, mark); distinct rows with unlike doc_ids only."""
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ls = (text or "").split("\n")
        held = [(i, x) for i, x in enumerate(ls) if x.strip(" \t\n\r\x0b\x0c")]
        gone = set()
        for w in zip(held, held[1:], held[2:]):
            key = tuple(x for _, x in w)
            first = seen.setdefault(key, (doc, w[0][0], w[2][0]))
            if first[:2] != (doc, w[0][0]):
                gone.update(i for i, _ in w if first[0] != doc or i > first[2])
        out[doc] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


ROWS = [(1, "a\nb\nc\nd"), (2, "x\na\nb\n\nc\ny"), (3, "a\na\na\na\na"), (4, None), (5, ""), (None, "b\nc\nd\nz"), (6, "q\nb\nc\nd\n"), (7, "\n".join(f"line {i % 50}" for i in range(3000))), (8, "a\nb")]


def test_lines_brute_force_and_edges(spark):
    docs = spark.createDataFrame([(*r, "s", 3) for r in ROWS], "doc_id long, text string, mark string, gone int").repartition(3)
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    want = slow_lines(ROWS)
    assert {k: r.text or "" for k, r in got.items()} == want
    assert got[4].text is None and got[1].mark == "s" and got[1].gone == 3
    assert lines.dedup_lines(docs.where("false")).count() == 0
    again = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "z\na\nb\nc")], "doc_id long, text string")
    assert sorted(r.text for r in lines.dedup_lines(again).collect()) in (["a\nb\nc", "a\nb\nc", "z"], ["", "", "z\na\nb\nc"])


def test_chat_equals_sql(spark, data):
    got = sorted(map(tuple, chat.chat_report(spark.read.parquet(f"{data}/conversations.parquet")).collect()))
    assert got == sorted(duck("conversations", f"{data}/conversations.parquet").execute(chat.REPORT_SQL).fetchall())


EVENTS = [
    (1, 1, 1, "open", "user", "Hi"),
    (1, 2, 1, "delta", None, " there"),
    (1, 4, 2, "delta", None, "draft"),
    (1, 3, 2, "open", "assistant", ""),
    (1, 5, 2, "regenerate", None, None),
    (1, 6, 2, "delta", None, "fin"),
    (1, 6, 2, "delta", None, "fin"),
    (1, 7, 2, "delta", None, "al"),
    (1, 8, 3, "open", "user", "typo"),
    (1, 9, 3, "edit", None, "fixed"),
    (1, 10, 3, "unknown", None, "x"),
    (None, 1, 1, "delta", None, "no open"),
]


def test_fold(spark):
    got = chat.fold(spark.createDataFrame(EVENTS, "conv_id long, seq long, msg long, kind string, role string, text string").repartition(3)).collect()
    assert {(r.conv_id, r.msg): (r.role, r.text) for r in got} == {(1, 1): ("user", "Hi there"), (1, 2): ("assistant", "final"), (1, 3): ("user", "fixed"), (None, 1): ("", "no open")}


@pytest.mark.parametrize("text", ["", "\\", "\\\\h", "###", "####\\h\\t", "</turn></turn>", "\\### Assistant: </turn> ok", "a: b\n", "\\\\\\h###</turn>\\c: ", "</turn", "é\U0001f600 #"])
def test_marks_are_reversible(spark, text):
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, f"r: {text}", "x"), (1, 3, "assistant", "tail")]
    messages = spark.createDataFrame(rows, "conv_id long, msg long, role string, text string")
    r = chat.parse(chat.render(messages)).first()
    assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in rows]
    assert r.loss_text == text + "tail"


def test_chat_edges(spark):
    rows = [(5, None, None, None), (5, None, None, None), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (None, 0, "assistant", "n"), (6, 0, "user", "y" * 50000)]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(2000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int").repartition(3)
    got = {r.conv_id: r for r in chat.chat_report(df).collect()}
    assert got[5].n_turns == 4 and got[5].loss_chars == 2 and got[None].loss_chars == 1 and got[-7].n_turns == 2 and got[6].loss_chars == 0
    assert got[9].n_turns == 2000 and got[9].loss_chars == sum(len(f"t{i}") for i in range(1, 2000, 2))
    assert chat.chat_report(df.where("false")).count() == 1


def test_line_dedup_leaves_columns_of_any_name(spark):
    text = "one a\ntwo b\nthree c\n" + "long line " * 50000
    docs = spark.createDataFrame([(1, text, 1, 2, 3, 4, 5), (2, text, 1, 2, 3, 4, 5), (3, None, 1, 2, 3, 4, 5)], "doc_id long, text string, __gone int, __doc int, mark int, row int, `a.b` int")
    got = lines.dedup_lines(docs).orderBy("doc_id").collect()
    assert [r.text for r in got] == [text, "", None] and {tuple(r)[2:] for r in got} == {(1, 2, 3, 4, 5)}
    assert lines.dedup_lines(docs.where("false")).count() == 0
