"""Line dedup: windows of three consecutive lines, found again anywhere, are removed after their first occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _numbered(text):
    """The lines that hold a word, as (number, line)."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.filter(lines, lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, first, mid, last, h1, h2): the windows of each document, with two 64-bit hashes of their lines.

    Lines without a word are passed over. ``mark`` is a hash of the text: rows that share a doc_id but not
    the text are documents of their own.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("mark"), _numbered(text).alias("s")).where(F.size("s") >= WINDOW)
    three = lambda i, f: [F.get("s", i + k)[f] for k in range(WINDOW)]
    windows = F.transform(F.sequence(F.lit(0), F.size("s") - WINDOW), lambda i: F.struct(
        *[c.alias(n) for c, n in zip(three(i, "i"), ("first", "mid", "last"), strict=True)], F.xxhash64(*three(i, "x")).alias("h1"), F.xxhash64(F.lit(1), *three(i, "x")[::-1]).alias("h2")
    ))
    return held.select("doc", "mark", F.explode(windows).alias("w")).select("doc", "mark", "w.*")


def covered_lines(windows: DataFrame) -> DataFrame:
    """(doc, mark, gone): the numbers of the lines that later occurrences cover, merged.

    The first occurrence is that of the least (doc, mark, line). Of a window that overlaps its own first occurrence
    only the lines after that go. Only minima and counts are gathered by hash; the join back is on the same key.
    """
    place = F.struct("doc", "mark", "first", "last")
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1")
    later = windows.join(repeated, ["h1", "h2"]).where(place > F.col("least"))
    same = F.col("doc").eqNullSafe(F.col("least.doc")) & (F.col("mark") == F.col("least.mark"))
    lines = F.filter(F.array("first", "mid", "last"), lambda x: ~same | (x > F.col("least.last")))
    return later.select("doc", "mark", F.explode(lines).alias("line")).groupBy("doc", "mark").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with later occurrences of repeated three-line windows taken out of the text; all rows and columns stay, whatever these are called.

    Null texts stay null and empty ones empty; an empty table stays empty. A long text is one row like any other: its lines
    and windows are worked on by its own task. Lines are compared exactly. Rows that repeat with the same doc_id and text
    count as one document and keep the same lines. ``counts`` adds n_lines and n_removed.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("own"))
    joined = rows.join(covered_lines(line_windows(rows, "id", "text")), F.col("id").eqNullSafe(F.col("doc")) & (F.col("own") == F.col("mark")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains("gone", s["i"])), lambda s: s["x"]), "\n")
    out = [F.col("row").getField(c).alias(c) if c != text_col else F.when(F.col("gone").isNull(), F.col("row").getField(c)).otherwise(kept).alias(c) for c in docs.columns]
    if counts:
        out += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed")]
    return joined.select(*out)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that stays (null: of nothing)."""
    return dedup_lines(docs.select("doc_id", "text"), counts=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: The same by window functions over strings; {docs} is a table with doc_id and text. Gives doc_id, mark, gone.
COVERED_SQL = r"""
numbered as (select doc_id, text mark, i, x from (select doc_id, text, unnest(l) x, generate_subscripts(l, 1) - 1 i from (select doc_id, text, string_split(coalesce(text, ''), chr(10)) l from {docs}))
  where regexp_matches(x, '[^\x20\x09-\x0D]')),
windows as (select doc_id, mark, i a, x, lead(i) over w b, lead(x) over w x2, lead(i, 2) over w c, lead(x, 2) over w x3 from (select distinct * from numbered) window w as (partition by doc_id, mark order by i)),
firsts as (select *, first_value(doc_id) over k fd, first_value(mark) over k fm, first_value(a) over k fa, first_value(c) over k fc from windows where c is not null window k as (partition by x, x2, x3 order by doc_id, mark, a)),
covered as (select distinct doc_id, mark, l from (select *, unnest([a, b, c]) l from firsts where (doc_id, mark, a) <> (fd, fm, fa)) where (doc_id, mark) <> (fd, fm) or l > fc)
"""

REPORT_SQL = (
    "with "
    + COVERED_SQL.format(docs="documents")
    + """, kept as (select doc_id, mark, n, (select string_agg(x, chr(10) order by i) from (select unnest(l) x, generate_subscripts(l, 1) - 1 i) where not list_contains(gone, i)) t
  from (select d.doc_id, d.text mark, string_split(coalesce(d.text, ''), chr(10)) l, len(string_split(coalesce(d.text, ''), chr(10))) n, coalesce(g.gone, []) gone
    from documents d left join (select doc_id, mark, list(l) gone from covered group by all) g on d.doc_id = g.doc_id and d.text = g.mark))
select kept.doc_id, cast(n as bigint) n_lines, cast(coalesce(r.k, 0) as bigint) n_removed, sha256(coalesce(t, '')) text_sha256
from kept left join (select doc_id, mark, count(*) k from covered group by all) r on kept.doc_id = r.doc_id and kept.mark = r.mark
"""
)
