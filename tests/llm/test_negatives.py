import math

import numpy as np
import pytest

from oscilla.llm import negatives
from oscilla.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def cut(x):
    return max(-(1 << 63), min((1 << 63) - 1, x))


def slow(rows):
    """All anchors against all rows, by Python's integers."""
    live = {}
    for vec, x, label in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None), key=lambda r: r[0]):
        if all(v is not None and math.isfinite(v) for v in x):
            label = (label + 1) % 10 if vec % 7 == 0 else label
            own = (label, [math.floor(256 * float(np.float32(v))) for v in x])
            live[vec] = min(live.get(vec, own), own)
    out = []
    for a in [v for v in live if v % 100 == 0]:
        score = {v: cut(sum(i * j for i, j in zip(live[a][1], live[v][1], strict=False))) for v in live if v != a}
        first = lambda vs: sorted(vs, key=lambda v: (-score[v], v))[:5]
        for p in first(v for v in score if live[v][0] == live[a][0]):
            for rank, n in enumerate(first(v for v in score if live[v][0] != live[a][0] and 80 * score[p] <= 100 * score[v] <= 100 * score[p]), 1):
                out.append((a, p, rank, n, score[p], score[n]))
    return sorted(out)


def told(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and dict(df.dtypes)["rank"] == "int"
    return sorted(map(tuple, df.collect()))


def vectors(n, d, seed=1, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, d))
    return [(i, (centres[i % 10] * spread + rng.normal(size=d)).astype(np.float32).tolist(), int(i % 10)) for i in range(n)]


@pytest.mark.parametrize("d", [1, 7, 64, 100])
def test_equals_all_pairs(spark, d):
    rows = vectors(700, d)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as anchor_id", "2 as part", "3 as `group`").repartition(3)
    assert told(negatives.hard_negatives(df, queries_a_group=3, rows_a_group=50)) == slow(rows)


def test_odd_rows(spark):
    rows = vectors(300, 8)
    rows += [(1000, None, 1), (1001, [1.0] * 8, None), (1002, [1.0, None] * 4, 1), (1003, [float("nan")] + [0.0] * 7, 1), (1100, [float("inf")] * 8, 1), (None, [1.0] * 8, 1)]
    rows += [(1200, [], 3), (1300, [0.0] * 8, 4), (1400, [1.0, -2.0], 5), (-100, [-1.0] * 8, 6), (1500, None, None)]
    rows += [(2000 + i, [0.5] * 8, i % 3) for i in range(60)]  # one common vector, of three labels
    rows += [(2100, [0.5] * 8, 1), (2100, [0.5] * 8, 1), (2100, [0.25] * 8, 1), (2100, [0.1] * 8, 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert told(negatives.hard_negatives(df)) == slow(rows)
    assert told(negatives.hard_negatives(df.where("false"))) == [] and told(negatives.hard_negatives(df.where("vec_id % 100 <> 0"))) == []


@pytest.mark.parametrize("size", [1e5, 1e8, 1e15])
def test_large_components_are_scored_exactly(spark, size):
    rows = [(i, [x * size for x in v], label) for i, v, label in vectors(220, 5, 3)]
    assert told(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == slow(rows) != []


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_intervals_hold_and_rule_out(spread):
    """Every score lies in its interval, and most rows are ruled out without their integers, also where vectors are hardly alike."""
    v = np.floor(256 * np.array([x for _, x, _ in vectors(500, 64, 4, spread)]))
    _, low, high = negatives.Queries(v[:50]).intervals(np.arange(50), *negatives.coded(v))
    exact = v[:50] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high < np.sort(exact, axis=1)[:, -6:-5]).mean() > 0.6
    assert negatives.coded(np.zeros((1, 3)))[3].tolist() == [0.0]


def test_whole_table(spark, data):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert told(QUERIES["op13_negatives"](spark, data)) == slow(rows) != []
