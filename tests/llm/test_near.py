import numpy as np
import pytest

from oscilla.llm import near, simhash
from oscilla.llm.components import connected_components


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def slow_near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_edited_copies_go(spark):
    """Copies with single words changed: 0.8 or more, though the fingerprints differ in more than three bits."""
    rng = np.random.default_rng(3)
    rows, groups = [], 25
    for g in range(groups):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((g, " ".join(words)))
        for k in range(3):
            other = list(words)
            for at in rng.choice(200, 4, replace=False):
                other[at] = f"x{rng.integers(0, 9999)}"
            rows.append((1000 + 10 * g + k, " ".join(other)))
        far = list(words)
        far[::9] = [f"y{x}" for x in rng.integers(0, 9999, len(far[::9]))]
        rows.append((5000 + g, " ".join(far)))
    rows += [(7000, None), (7001, ""), (7002, "a b c"), (7003, "A  b\nc"), (7004, "a b d"), (None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in near.drop_near_copies(docs).collect()}
    assert got == set(range(groups)) | set(range(5000, 5000 + groups)) | {7000, 7002, 7004}
    assert near.drop_near_copies(docs.where("false")).count() == 0


def test_chain_of_copies_is_one_component(spark):
    """Each text is near the next only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 100])) for i in range(31)]
    sets = [slow_set(t) for _, t in rows]
    assert slow_near(sets[0], sets[1]) and not slow_near(sets[0], sets[2])
    got = near.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in got] == [0]


def test_whole_table(spark, data):
    """Against all pairs."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    sets, root = [slow_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if slow_near(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r.doc_id for r in near.drop_near_copies(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert got == {rows[r][0] for r in root}


def test_large_band_and_columns_of_any_name(spark):
    """More than SMALL copies that share bands, with repeats and clashing columns."""
    rng = np.random.default_rng(9)
    words, rows = [f"w{i}" for i in range(300)], []
    for k in range(60):
        other = list(words)
        other[int(rng.integers(0, 300))] = f"x{k}"
        rows.append((k, " ".join(other), 1, "m", "k", 2, 3))
    docs = spark.createDataFrame([*rows, rows[0], (99, "quite another text of six words", 1, "m", "k", 2, 3)], "doc_id long, text string, __own int, mark string, key string, row int, `a.b` int").repartition(3)
    got = near.drop_near_copies(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 99]


def components(rows):
    """The least id of each row's component, by comparing all pairs."""
    sets, root = [slow_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and slow_near(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {rows[r][0] for r in root}


def family(n, words, edits, seed, twins=0):
    """Texts of one template with words changed; twins: pairs that differ from each other in two words only."""
    rng = np.random.default_rng(seed)
    template, rows = [f"w{i}" for i in range(words)], []
    for k in range(n):
        own = list(template)
        for at in rng.choice(words, int(rng.integers(*edits)), replace=False):
            own[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((len(rows), " ".join(own)))
        if k < twins:
            own[int(rng.integers(words))] = f"y{k}"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize(("rows", "block"), [(family(400, 200, (2, 9), 1), 256), (family(400, 200, (2, 9), 1), 20), (family(150, 200, (9, 12), 2, twins=150), 64), (family(200, 120, (1, 12), 3, twins=50), 16)])
def test_families_of_one_template(spark, monkeypatch, rows, block):
    """Many copies about as far from each other as a link allows, so that leaders miss links: equal to all pairs, also over many blocks."""
    monkeypatch.setattr(near, "BLOCK", block)
    got = {r.doc_id for r in near.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == components(rows) and len(got) < len(rows)


def test_overlaps():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, int(n)).astype(np.uint64)) for n in rng.integers(0, 8000, 12)]
    got = near.overlaps(sets, np.arange(5), np.arange(5, 12))
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[5:]] for x in sets[:5]]
    assert near.overlaps([sets[0][:0]] * 2, np.arange(2), np.arange(2)).tolist() == [[0, 0], [0, 0]]


def test_balls_meet_first(spark):
    """Components of the ball pairs are those of all pairs at most three bits apart, and link near copies that share no band."""
    from pyspark.sql import functions as F

    rows = [(i, " ".join(f"w{(7 * i + k) % 9973}" for k in range(3000)) if k == 0 else f"{' '.join(f'w{(7 * i + k) % 9973}' for k in range(2999))} x{k}") for i in range(0, 900, 100) for k in range(2)]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near.sketches(docs).cache()
    fps = {r.node: r.fp & (1 << 64) - 1 for r in nodes.collect()}
    for r in nodes.collect():
        hashes = near.shingles(rows[r.doc_id][1].encode()).tolist()
        assert fps[r.node] == sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    pairs = near.ball_pairs(nodes)
    close = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS]
    together = lambda edges: {frozenset(x) for x in edges.groupBy("root").agg(F.collect_list("node")).toPandas().iloc[:, 1]}
    assert close and together(connected_components(pairs)) == together(connected_components(spark.createDataFrame(close, "a long, b long")))
    texts = docs.join(nodes, "doc_id").select("node", "text").mapInArrow(near._squeezed, "node long, text binary")
    none = nodes.select("node", "n", F.lit(0).cast("long").alias("band"), F.lit(0).alias("members")).where("false")
    roots = near.near_links(none, nodes, texts, pairs)
    assert {len(x) for x in together(roots)} == {2}
    assert sorted(r.doc_id for r in near.drop_near_copies(docs).collect()) == list(range(0, len(rows), 2))
