"""Chat formatting: event logs are folded into final messages and rendered with a loss mask, by DataFrame functions only.

A log has conv_id, seq, msg (number of the message), kind, role and text. Kinds: ``open`` starts a message with a role
and a first text, ``delta`` adds to the text, ``edit`` replaces it, ``regenerate`` empties it (deltas that follow fill it again).

A turn is rendered as ``### role: text</turn>`` and a line end. Inside roles and texts a backslash is doubled,
``###`` becomes ``\\h`` and ``</turn>`` becomes ``\\t`` (in roles also ``: `` becomes ``\\c``), so the marks stand for turns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

HEAD, END = "### ", "</turn>\n"
RESETS = ("open", "edit", "regenerate")


def escape(c: Column, role: bool = False) -> Column:
    for a, b in (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t"), *([(": ", "\\c")] if role else [])):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, role: bool = False) -> Column:
    """Doubled backslashes split the text; in what is between them a backslash begins an escape."""

    def part(p):
        for a, b in (("\\h", "###"), ("\\t", "</turn>"), *([("\\c", ": ")] if role else [])):
            p = F.replace(p, F.lit(a), F.lit(b))
        return p

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): the final messages of an event log.

    Events count in order of seq; events that repeat in full count once, and others of one seq in order of kind and
    text. A message without ``open`` has an empty role. Null texts and roles are empty, unknown kinds do nothing.
    """
    reset = F.col("kind").isin(*RESETS)
    e = events.select("conv_id", "msg", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where(reset | (F.col("kind") == "delta"))
    place = F.struct("seq", "kind", "text")
    grouped = e.groupBy("conv_id", "msg").agg(
        F.array_sort(F.collect_set(F.struct("seq", "kind", "text"))).alias("log"),
        F.max(F.when(reset, place)).alias("last"),
        F.max_by("role", F.when(F.col("kind") == "open", F.struct("seq", "role"))).alias("role"),
    )
    live = F.filter("log", lambda x: F.col("last").isNull() | (x >= F.col("last")))
    return grouped.select("conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(live, lambda x: F.when(x["kind"] == "regenerate", "").otherwise(x["text"])), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): a conversation's text and the spans (start, length in code points, of texts) that count for the loss."""
    head = F.concat(F.lit(HEAD), escape(F.col("role"), True), F.lit(": "))
    turns = messages.select("conv_id", "msg", (F.col("role") == loss_role).alias("own"), F.length(head).alias("head"), escape(F.col("text")).alias("body"), head.alias("start"))
    turns = turns.withColumn("turn", F.concat("start", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.col("head"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "turn", "own", F.col("at").cast("long").alias("at"), F.length("body").cast("long").alias("n")))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["own"]), lambda x: F.struct(x["at"].alias("start"), x["n"].alias("length")))
    return held.select("conv_id", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss"))


def parse(rendered: DataFrame) -> DataFrame:
    """rendered with turns (role, text), read back from the formatted text, and loss_text, read from the spans."""
    turns = F.transform(F.filter(F.split("formatted", END, -1), lambda x: x != ""), lambda x: F.substring(x, F.lit(len(HEAD) + 1), F.length(x)))
    split = F.transform(turns, lambda x: F.struct(unescape(F.substring_index(x, ": ", 1), True).alias("role"), unescape(F.substring(x, F.length(F.substring_index(x, ": ", 1)) + 3, F.length(x))).alias("text")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return rendered.withColumn("turns", split).withColumn("loss_text", loss)


def as_events(conversations: DataFrame) -> DataFrame:
    """An event log of a table of turns: texts stream in as deltas, assistant turns after a draft that is regenerated, others after an edit.

    Messages are numbered by turn, rows of one turn by role and text; rows that repeat are messages of their own.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("msg", F.row_number().over(order).cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    event = lambda i, kind, text: F.struct((F.col("msg") * 10 + i).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = [event(0, "open", F.lit("")), event(1, "delta", second), event(2, "regenerate", F.lit("")), event(3, "delta", first), event(4, "delta", second)]
    edited = [event(0, "open", first), event(1, "edit", first), event(2, "delta", second)]
    log = F.when(F.col("role") == "assistant", F.array(*streamed)).otherwise(F.array(*edited))
    return rows.select("conv_id", "msg", "role", F.explode(log).alias("e")).select("conv_id", "msg", "role", "e.*")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own marks."""
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))


def chat_report(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the written output.

    A null conv_id is a conversation too. Of an empty table only conversation -7 is told; very long texts and conversations are formatted whole, a conversation in one row.
    """
    table = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rendered = written(render(fold(as_events(table.unionByName(probe(conversations.sparkSession))))), "chat")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parse(rendered).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


REPORT_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped as (select *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') as body,
  replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ': ', '\c') as head from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('### ' || head || ': ' || body || '</turn>' || chr(10))) as bigint) as formatted_chars
from escaped group by conv_id
"""
