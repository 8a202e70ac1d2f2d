import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from oscilla.llm import simhash
from oscilla.llm.components import connected_components


def slow_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """Least index reachable over pairs of at most three bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


@given(st.text(alphabet="abcAB \n\t\x1c\xa0é", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_near_balls_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)]
    for base in fps[:30]:
        for _ in range(8):
            x = base
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long").repartition(3)
    roots = {r.node: r.root for r in connected_components(simhash.ball_links(df)).collect()}
    own = [roots.get(int(np.uint64(x).astype(np.int64)), int(np.uint64(x).astype(np.int64))) for x in fps]
    slow = slow_components(fps)
    assert len(set(zip(own, slow))) == len(set(own)) == len(set(slow))


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1400)]
    edges = spark.createDataFrame(path + star + [(5, 5), (0, 1)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[i] for i in range(1000, 1400)}) == 1
    assert got[0] != got[1000] and len(got) == 301 + 400


def test_rows(spark):
    rows = [(3, "one two three four"), (2, "ONE two\nthree four"), (9, None), (7, ""), (None, "one two three four"), (3, "one two three four"), (11, "x " * 3000)]
    got = sorted(simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert len(got) == 7
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[(9, "0" * 16)] == by[(7, "0" * 16)] == 7
    assert {c for (d, f), c in by.items() if d in (2, 3, None)} == {2}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(empty).count() == 0


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    fps = [slow_fingerprint(texts[i]) for i in ids]
    slow = slow_components(fps)
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, slow)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == want
