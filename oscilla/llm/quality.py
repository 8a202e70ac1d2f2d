"""Quality rules: counts of words, symbols and repeats, and divergence from language references.

A document's histograms of character classes and of common words are compared with those of each reference language
by the Jensen-Shannon distance (base 2, square root). The references are sums over all documents of that
language; a document passes if it is near to one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# The commonest function words of each reference language.
COMMON = {
    "en": "the of and in to for that is on with by at an as it he was be are this not or have from re".split(),
    "fr": "le la de et les des en un une du que qui dans pour par sur au aux avec il elle est ne pas ou".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}

# Character classes, taken from the text in this order; what none takes is the last class.
CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "space": r"[\x20\x09-\x0D]", "letter": r"\p{L}", "digit": r"\p{N}", "stop": r"""[.,;:!?'"()-]""", "symbol": r"[#*$%&|<>]"}

MIN_WORDS = 50
MIN_TOKENS = 100
MIN_CHARS = 200
MAX_CLASS_DISTANCE = 0.31
MAX_WORD_DISTANCE = 0.34


def _is_one_of(words: list[str]):
    return lambda x: x.isin(words)


def _times_in(column: str):
    return lambda w: (F.size(column) - F.size(F.array_remove(column, w))).cast("long")


def _windows(words):
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _with_repeats(t: DataFrame) -> DataFrame:
    """Adds __repeats: words covered by windows whose hash (in __h, in order) occurs twice or more.

    Each step is a column of its own: inside a lambda an expression would be worked out anew for every element.
    """
    t = t.withColumn("__s", F.array_sort(F.transform("__h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    again = lambda e, j: F.when((F.get("__s", j - 1)["x"] == e["x"]) | (F.get("__s", j + 1)["x"] == e["x"]), e["i"])
    t = t.withColumn("__p", F.array_sort(F.array_compact(F.transform("__s", again))))
    steps = F.transform("__p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("__p", i + 1) - x, F.lit(3))))
    return t.withColumn("__repeats", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column ``m``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, classes, tokens, common."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    t = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # every space as \x20: a split at one plain character needs no pattern
    plain = F.col("__t")
    for c in "\t\n\v\f\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    t = t.select(*keep, "__t", F.array_remove(F.split(plain, " "), "").alias("__w"), lines.alias("__l"), F.array_remove(F.split(F.lower("__t"), r"\P{L}+"), "").alias("__k"))
    # each class is counted by what is left when it is taken out
    at = F.col("__t")
    for i, pattern in enumerate(CLASSES.values()):
        t = t.withColumn(f"__c{i}", F.regexp_replace(at, f"{pattern}+", ""))
        at = F.col(f"__c{i}")
    n = len(CLASSES)
    sizes = [F.length("__t"), *[F.length(f"__c{i}") for i in range(n)]]
    classes = F.array(*[(sizes[i] - sizes[i + 1]).cast("long") for i in range(n)], sizes[n].cast("long"))
    # no other class holds a space or a symbol, so these two count all of them
    names = list(CLASSES)
    t = t.withColumn("__classes", classes).withColumn("__symbols", F.get("__classes", F.lit(names.index("symbol"))))
    t = t.withColumn("__chars", F.length("__t").cast("long") - F.get("__classes", F.lit(names.index("space"))))
    t = t.withColumn("__dups", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    t = t.select(*keep, "__w", "__k", "__classes", "__symbols", "__chars", "__dups", _windows(F.col("__w")).alias("__h"))
    t = t.withColumn("__h", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.col("__h")).otherwise(F.array().cast("array<bigint>")))
    t = _with_repeats(t).withColumn("__n", F.size("__w").cast("long"))
    every = sorted({w for ws in COMMON.values() for w in ws})
    t = t.withColumn("__u", F.filter("__k", _is_one_of(every)))
    common = []
    for lang, ws in COMMON.items():
        own = f"__u_{lang}"
        t = t.withColumn(own, F.filter("__u", _is_one_of(ws)))
        common.append(F.transform(F.array(*map(F.lit, ws)), _times_in(own)).alias(lang))
    failed = (F.col("__n") < MIN_WORDS) | (100 * F.col("__repeats") > 50 * F.col("__n"))
    return t.select(*keep, F.struct(F.col("__n").alias("n_words"), F.col("__chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"), F.col("__dups").alias("n_dup_lines"), F.col("__repeats").alias("n_repeat_words"), failed.alias("base_failed"), F.col("__classes").alias("classes"), F.size("__k").cast("long").alias("tokens"), F.struct(*common).alias("common")).alias("m"))


def references(measured: DataFrame, lang_col: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """lang -> (class shares, common-word shares with the rest last), over all measured documents of each reference language."""
    sums = [F.sum(F.get("m.classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    sums += [F.sum("m.tokens").alias("tokens")]
    longest = max(map(len, COMMON.values()))
    own = F.coalesce(*[F.when(F.col("lang") == k, F.col(f"m.common.{k}")) for k in COMMON])
    sums += [F.sum(F.get("own", F.lit(i))).alias(f"w{i}") for i in range(longest)]
    rows = measured.select(F.col(lang_col).cast("string").alias("lang"), "m").where(F.col("lang").isin(list(COMMON))).withColumn("own", own).groupBy("lang").agg(*sums).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.lang):
        chars, n = sum(r[f"c{i}"] for i in range(len(CLASSES) + 1)), len(COMMON[r.lang])
        if chars and r.tokens:
            ws = [r[f"w{i}"] for i in range(n)]
            out[r.lang] = [r[f"c{i}"] / chars for i in range(len(CLASSES) + 1)], [x / r.tokens for x in [*ws, r.tokens - sum(ws)]]
    return out


def _distance(counts, total, shares: list[float]):
    """Jensen-Shannon distance of counts / total from the shares; null where the total is 0."""
    part = lambda x, of: F.when(x > 0, x * F.log2(2 * x / of)).otherwise(0.0)
    terms = F.zip_with(counts, F.array(*map(F.lit, shares)), lambda c, q: part(c / total, c / total + q) + part(q, c / total + q))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def verdict(measured: DataFrame, refs: dict, lang_col: str = "lang") -> DataFrame:
    """measured with class_distance and word_distance (to the nearest reference, 6 decimals; null where not judged) and kept."""
    lang = F.col(f"`{lang_col}`").cast("string")
    known = lang.isNull() | lang.isin(list(refs)) if refs else F.lit(False)
    chars = F.aggregate("m.classes", F.lit(0).cast("long"), lambda a, x: a + x)
    d = measured.withColumn("__chars", chars)
    of_class = [_distance(F.col("m.classes"), F.col("__chars"), c) for c, _ in refs.values()]
    of_words = []
    for k, (_, w) in refs.items():
        own = F.col(f"m.common.{k}")
        rest = F.col("m.tokens") - F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
        of_words.append(_distance(F.concat(own, F.array(rest)), F.col("m.tokens"), w))
    nearest = lambda xs, guard: F.round(F.when(known & guard, F.least(*xs) if len(xs) > 1 else xs[0]), 6) if xs else F.lit(None).cast("double")
    d = d.withColumn("class_distance", nearest(of_class, F.col("__chars") >= MIN_CHARS)).withColumn("word_distance", nearest(of_words, F.col("m.tokens") >= MIN_TOKENS))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return d.drop("__chars").withColumn("kept", ~F.col("m.base_failed") & near)


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the two distances.

    Null texts are empty and fail. A document is judged by its characters from 200 on and by its words from 100 on,
    if its language has a reference or is null. Rows that repeat are judged each; an empty table gives no rows; other columns are ignored.
    A very long text is measured whole, in one row of a few times its size.
    """
    measured = written(measure(docs.select("doc_id", "lang", "text")).drop("text"), "measured")
    return verdict(measured, references(measured)).select("doc_id", *[F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept", "class_distance", "word_distance")


def keep_quality(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows that pass, with their columns. The measures are written beside the rows, so each text is measured once."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    measured = written(measure(rows).drop("text"), "measured")
    return verdict(measured, references(measured)).where("kept").select("row.*")


def report_sql() -> str:
    """quality_report() over ``documents`` as DuckDB SQL."""
    space = r"[\x20\x09-\x0D]"
    removed, left = [], "t"
    for p in CLASSES.values():
        p = p.replace("'", "''")
        left = f"regexp_replace({left}, '{p}+', '', 'g')"
        removed.append(left)
    sizes = ["length(t)", *[f"length({x})" for x in removed]]
    classes = ", ".join([f"{a} - {b}" for a, b in zip(sizes, sizes[1:], strict=False)] + [sizes[-1]])
    listed = ", ".join(f"('{lang}', {i}, '{w}')" for lang, ws in COMMON.items() for i, w in enumerate(ws))
    langs = ", ".join(f"'{x}'" for x in COMMON)
    term = "(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end)"
    distance = f"sqrt(greatest(sum({term}) / 2, 0))"
    return rf"""
with base as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as t from documents),
words as (select r, w, row_number() over (partition by r order by i) as i from (select r, unnest(l) as w, generate_subscripts(l, 1) as i from (select r, regexp_split_to_array(t, '{space}+') as l from base)) where w <> ''),
trigrams as (select r, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as g from words window o as (partition by r order by i)),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as n from trigrams where g is not null) where n > 1),
repeats as (select r, count(distinct i + k) as n from again, (select unnest([0, 1, 2]) as k) group by r),
lines as (select r, unnest(string_split(t, chr(10))) as l from base),
dups as (select r, count(*) - count(distinct l) as n from lines where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
counts as (select r, count(*) as n, sum(length(w)) as c from words group by r),
measured as (select b.r, doc_id, lang, length(t) as chars, coalesce(c.n, 0) as n_words, cast(coalesce(c.c, 0) as bigint) as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(d.n, 0) as n_dup_lines, coalesce(p.n, 0) as n_repeat_words, [{classes}] as cls
  from base b left join counts c on c.r = b.r left join dups d on d.r = b.r left join repeats p on p.r = b.r),
toks as (select r, k, count(*) as n from (select r, unnest(regexp_split_to_array(lower(t), '\P{{L}}+')) as k from base) where k <> '' group by r, k),
total as (select r, sum(n) as n from toks group by r),
listed as (select * from (values {listed}) as x(ref, i, w)),
own as (select t.r, ref, i, t.n from toks t join listed on listed.w = t.k),
cells as (select t.r, x.ref, x.i, coalesce(o.n, 0) as n from total t cross join (select ref, i from listed) x left join own o on o.r = t.r and o.ref = x.ref and o.i = x.i),
bins as (select r, ref, i, n from cells union all select c.r, c.ref, 1000, max(t.n) - sum(c.n) from cells c join total t on t.r = c.r group by c.r, c.ref),
known as (select distinct lang as ref from measured m join total t on t.r = m.r where lang in ({langs})),
wref as (select b.ref, b.i, sum(b.n) / sum(sum(b.n)) over (partition by b.ref) as q from bins b join measured m on m.r = b.r and m.lang = b.ref group by b.ref, b.i),
wdist as (select r, min(d) as d from (select b.r, b.ref, {distance} as d from (select b.r, b.ref, b.n / t.n as p, q from bins b join total t on t.r = b.r join wref on wref.ref = b.ref and wref.i = b.i) b group by b.r, b.ref) group by r),
cbins as (select r, lang, unnest(cls) as n, generate_subscripts(cls, 1) as i, chars from measured where chars > 0),
cref as (select lang as ref, i, sum(n) / sum(sum(n)) over (partition by lang) as q from cbins where lang in (select ref from known) group by lang, i),
cdist as (select r, min(d) as d from (select r, ref, {distance} as d from (select r, ref, n / chars as p, q from cbins join cref on cref.i = cbins.i) group by r, ref) group by r),
judged as (select m.*, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed,
  case when (m.lang is null or m.lang in (select ref from known)) and m.chars >= {MIN_CHARS} then round(c.d, 6) end as class_distance,
  case when (m.lang is null or m.lang in (select ref from known)) and coalesce(t.n, 0) >= {MIN_TOKENS} then round(w.d, 6) end as word_distance
  from measured m left join cdist c on c.r = m.r left join wdist w on w.r = m.r left join total t on t.r = m.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(class_distance, 0) <= {MAX_CLASS_DISTANCE} and coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} as kept, class_distance, word_distance
from judged
"""
