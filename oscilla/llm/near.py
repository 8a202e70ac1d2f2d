"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates meet first by ball hashing, as in ``simhash``: the fingerprints of their sets of shingles differ in three bits at most. Such a pair is
linked if its texts are near copies. Since the fingerprints of most pairs of similarity 0.8 differ in more, what is of different components then
meets at bands of five minima of permuted shingle hashes, of which a document has 20: a pair of similarity 0.8 shares one with probability 0.9996. Bands of up to SMALL members are compared whole. In a larger one members first meet a few leaders,
members of the component that has most of the band: a number of pairs in proportion to the documents, which merges copies of one
text. Then every member that is still of another component is compared with the whole band, in blocks of bounded size, by
exact overlaps; so no link in a band is missed, however large it is, and what a block tells is no more than a spanning forest of its links.

A pair from a small band or with a leader must agree in size and in at least 56 of 100 one-byte minima (one of similarity 0.8 falls
short with probability below 1e-7); then both whole texts are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, written
from .components import connected_components
from .simhash import ball_links, majority

SEED = 42
WIDTH = 5
BANDS, ROWS = 20, 5
#: Bands of up to SMALL members are compared whole; in a larger one members meet up to LEADERS leaders in each of TURNS rounds, before blocks of BLOCK members are compared whole.
SMALL, LEADERS, TURNS, BLOCK = 9, 3, 3, 256
#: Shingles of a block that are counted at a time.
COLUMNS = 4096
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
#: The least number of equal one-byte minima of a pair whose texts are compared.
LEAST_EQUAL = 56
_RANDOM = np.random.default_rng(SEED)
_FLIP, _TIMES = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)[:, None] for _ in range(2))
_TIMES |= np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The distinct XXH64 of five lower-case words in a row, ascending; of all words of a shorter text, none of an empty one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - WIDTH + 1, 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(WIDTH, len(words)) - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, n))


def minima(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 512):
        least = np.minimum(least, ((own[at : at + 512] ^ _FLIP) * _TIMES).min(axis=1))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A hash of each band's minima."""
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, node, n, minima, bands, fp) of every row: a hash of the text, one of its set of shingles, their number, one byte of each minimum, the bands, and the fingerprint."""

    def run(batches):
        for b in batches:
            sets = [shingles(t) for t in text_bytes(b.column(1))]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            least = [minima(s) for s in sets]
            short = pa.array([(x >> np.uint64(56) ^ x >> np.uint64(20)).astype(np.uint8).tobytes() for x in least], pa.binary())
            own = pa.array([bands(x).view(np.int64) for x in least], pa.list_(pa.int64()))
            fps = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), short, own, fps], names=["doc_id", "mark", "node", "n", "minima", "bands", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark")).mapInArrow(run, "doc_id long, mark long, node long, n long, minima binary, bands array<long>, fp long")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) with LEAST_EQUAL equal minima."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for k in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= LEAST_EQUAL))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("minima").alias(f"m{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are near copies."""

    def run(batches):
        last: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                b, told = whole.slice(at, 100), []
                for a, c, at_, ct in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)), text_bytes(b.column(3)), strict=True):
                    if len(last) > 50:
                        last.clear()
                    for k, t in ((a, at_), (c, ct)):
                        if k not in last:
                            last[k] = shingles(zstandard.decompress(t))
                    told.append(near(last[a], last[c]))
                yield b.select(["a", "b"]).filter(pa.array(told, pa.bool_()))

    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after more links (a, b): only the components that these touch are merged."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    touched = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = written(connected_components(touched), "moved")
    known = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return known.unionByName(moved.join(roots, "node", "left_anti").select("node", "root"))


def _squeezed(batches):
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        for at in range(0, b.num_rows, 500):
            own = b.slice(at, 500)
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([z.compress(x) for x in text_bytes(own.column(1))], pa.binary())], names=["node", "text"])


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each other one of ``right`` (numbers of sets)."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    # what only one has is in no overlap
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        some = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[some], column[some] - at] = 1
        out += has[left] @ has[right].T
    return out.astype(np.int64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Numbers of the pairs (a, b) that a spanning forest of n nodes needs."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    needed = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        i, j = top(i), top(j)
        if i != j:
            root[i] = j
            needed.append(k)
    return needed


def _cell(key, t):
    """Links of a block's members, or between two blocks', that are of different components so far."""
    node, root, right = (t.column(c).to_numpy() for c in ("node", "root", "right"))
    sets = [shingles(zstandard.decompress(x)) for x in t.column("text").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    a, b = (np.arange(len(node)),) * 2 if not right.any() and key[2].as_py() == key[3].as_py() and not key[1].as_py() else (np.flatnonzero(right == 0), np.flatnonzero(right == 1))
    both = overlaps(sets, a, b)
    hit = (LEAST[1] * both >= LEAST[0] * (sizes[a][:, None] + sizes[b] - both)) & (root[a][:, None] != root[b])
    i, j = np.nonzero(hit)
    needed = np.array(_forest(len(node), a[i], b[j]), np.int64)
    return pa.table({"a": pa.array(node[a[i[needed]]], pa.int64()), "b": pa.array(node[b[j[needed]]], pa.int64())})


def _rooted(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    return keyed.select("node", "n", "band").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _split(rooted: DataFrame, turn: int) -> DataFrame:
    """Of each band with more than one component: main (that of most members), members of it and of others, and leaders of main."""
    by = [F.min(F.struct(F.xxhash64("node", F.lit(turn), F.lit(k)).alias("h"), "node", "n")).alias(f"l{k}") for k in range(LEADERS)]
    parts = rooted.groupBy("band", "root").agg(F.count("*").alias("m"), *by)
    most = F.max(F.struct("m", F.xxhash64("root", F.lit(turn)).alias("h"), "root", F.array_distinct(F.array(*[f"l{k}" for k in range(LEADERS)])).alias("of"))).alias("x")
    bands = parts.groupBy("band").agg(most, F.sum("m").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    return bands.select("band", F.col("x.root").alias("main"), F.col("x.m").alias("mine"), (F.col("all") - F.col("x.m")).alias("others"), "x.of")


def _rest(rooted: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between members of one band that are of different components, by blocks: of the others among them, and with main's members."""
    split = _split(rooted, TURNS).drop("of")
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK).cast("int"), F.lit(1))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    cell = lambda main, i, j, right: F.struct(F.lit(main).alias("with_main"), i.alias("i"), j.alias("j"), right.cast("int").alias("right"))
    own = F.col("own")
    rows = rooted.join(split, "band").withColumn("is_main", F.col("root") == F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("is_main"), blocks("mine")).otherwise(blocks("others"))).cast("int"))
    of_main = each(blocks("others"), lambda i: cell(True, i, own, F.lit(1)))
    of_other = F.concat(each(blocks("mine"), lambda j: cell(True, own, j, F.lit(0))), each(blocks("others"), lambda j: cell(False, F.least(own, j), F.greatest(own, j), own > j)))
    dealt = rows.select("band", "node", "root", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_other)).alias("cell")).select("band", "node", "root", "cell.*")
    return dealt.join(texts, "node").groupBy("band", "with_main", "i", "j").applyInArrow(_cell, "a long, b long")


def _pair(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _like_size(x, y):
    return LEAST[1] * F.least(x, y) >= LEAST[0] * F.greatest(x, y)


def ball_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of like size whose fingerprints are at most three bits apart: stars around one node of a fingerprint, and pairs of those that ball_links() tells. nodes: node, n, fp."""
    # a fingerprint's first node, and whether it has others
    first = written(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("members")), "first")
    stars = nodes.join(first.where("members > 1").select("fp", "first"), "fp").select(F.col("first.node").alias("x"), F.col("first.n").alias("xn"), F.col("node").alias("y"), F.col("n").alias("yn"))
    of = lambda c, k: first.select(F.col("fp").alias(c), F.col("first.node").alias(k), F.col("first.n").alias(f"{k}n"))
    between = ball_links(first).join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "xn", "y", "yn")
    return stars.unionByName(between).where((F.col("x") != F.col("y")) & _like_size(F.col("xn"), F.col("yn"))).select(*_pair("x", "y")).distinct()


def near_links(keyed: DataFrame, nodes: DataFrame, texts: DataFrame, balls: DataFrame) -> DataFrame:
    """(node, root) of every linked node. keyed: node, n, band, members (of the band); nodes: node, minima, bands; texts: node, text (compressed); balls: ball_pairs()."""
    small, large = keyed.where(F.col("members") <= SMALL), keyed.where(F.col("members") > SMALL)
    roots = written(connected_components(written(_verified(_alike(balls, nodes), texts), "links")), "roots")
    # what balls have made one is not compared again
    left = _rooted(small, roots)
    other = left.select("band", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("root").alias("root2"))
    within = left.join(other, "band").where((F.col("node") < F.col("node2")) & (F.col("root") != F.col("root2")) & _like_size("n", "n2")).select(*_pair("node", "node2"))
    for turn in range(TURNS):
        rooted = _rooted(large, roots)
        met = rooted.join(_split(rooted, turn), "band").where("root <> main")
        met = met.select("node", F.filter("of", lambda x: _like_size(x["n"], F.col("n"))).alias("of")).where(F.size("of") > 0)
        # of all the leaders that a member meets a few, the same ones for many members: the count is bounded by the members, not by their bands
        few = met.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("of")))).alias("of"))
        pairs = few.select("node", F.explode(F.slice("of", 1, LEADERS)).alias("l")).select(*_pair("node", "l.node"))
        pairs = written((pairs if turn else pairs.unionByName(within)).distinct(), "pairs")
        new = written(_verified(_alike(pairs, nodes), texts), "links")
        if not new.isEmpty():
            roots = written(_merged(roots, new), "roots")
    rest = written(_rest(_rooted(large, roots), texts), "links")
    return roots if rest.isEmpty() else written(_merged(roots, rest), "roots")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near copies: that of the least doc_id (nulls last; of one doc_id, of the least hash of the text).

    Texts of under five words, null or empty are near copies of those with the same words only. Rows that repeat with one
    doc_id and text are one. An empty table stays empty; columns of any name stay as they are. Very long texts are compared whole.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    # a row's key: its id as text (none for null) and a hash of its text
    key = lambda doc, mark: (F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("key"), F.col(mark).alias("mark"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    nodes = written(sketches(rows), "sketches").groupBy("node").agg(F.min(place).alias("place"), F.first("n").alias("n"), F.first("minima").alias("minima"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    nodes = written(nodes, "nodes")
    balls = written(ball_pairs(nodes), "balls")
    # only bands that two share are paired, and only texts of their nodes and those of balls are read
    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = nodes.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    keyed = written(banded.join(shared, "band"), "bands")
    met = written(nodes.join(keyed.select("node").unionByName(balls.select(F.explode(F.array("a", "b")).alias("node"))).distinct(), "node", "left_semi").select("node", "place", "minima", "bands"), "met")
    marked = rows.withColumn("mark", F.xxhash64("text"))
    texts = marked.select(*key("doc_id", "mark"), "text").join(met.select("node", *key("place.doc_id", "place.mark")), ["key", "mark"])
    texts = texts.dropDuplicates(["key", "mark"]).select("node", "text").mapInArrow(_squeezed, "node long, text binary")
    roots = near_links(keyed, met, written(texts, "texts"), balls)
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("place").alias("place")).select(*key("place.doc_id", "place.mark"))
    return marked.select("row", *key("doc_id", "mark")).join(kept, ["key", "mark"], "left_semi").dropDuplicates(["key", "mark"]).select("row.*")
