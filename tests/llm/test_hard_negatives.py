"""Hard negatives against all scores, with blocks cut small and awkward rows."""

import math
import random

import pytest

from tidemark.llm import hard_negatives


def plain(rows, every=100, positives=5, negatives=5, low=80, high=100):
    """rows: (id, label, vector)"""
    good = [(i, k, [max(-(1 << 26), min(1 << 26, math.floor(256 * x))) for x in v]) for i, k, v in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, k, v in good:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in good)
        for ps, p, _ in [x for x in scored if x[2] == k and x[1] != a][:positives]:
            fit = [x for x in scored if x[2] != k and low * -ps <= 100 * -x[0] <= high * -ps][:negatives]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "vec_id long, label int, embedding array<double>, id int, block string").repartition(parts)
    return sorted(tuple(r) for r in hard_negatives.mine(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture
def small(monkeypatch):
    for name, value in (("ROWS", 24), ("ANCHORS", 3), ("CHUNK", 3), ("TOGETHER", 2)):
        monkeypatch.setattr(hard_negatives, name, value)


def some(n, dims, labels, seed, scale=1.0):
    rng = random.Random(seed)
    return [(i, rng.choice(labels), [rng.gauss(0, scale) for _ in range(dims)]) for i in range(n)]


def test_small_blocks(spark, small):
    rows = some(240, 7, [0, 0, 0, 1, 2], 1)
    assert found(spark, rows, every=20) == plain(rows, every=20)


def test_ties_and_one_large_label(spark, small):
    rng = random.Random(2)
    rows = [(i, 0 if i % 3 else i % 5, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(160)]
    assert found(spark, rows, every=10) == plain(rows, every=10)


def test_other_windows(spark, small):
    rows = some(120, 5, [1, 2], 3)
    assert found(spark, rows, every=10, positives=2, negatives=7, low=30, high=90) == plain(rows, 10, 2, 7, 30, 90)


def test_awkward_rows(spark, small):
    rows = some(60, 4, [0, 1], 4)
    rows += [(None, 0, [1.0] * 4), (1000, None, [1.0] * 4), (1001, 0, None), (1002, 0, [1.0, None, 0.0, 0.0]), (1003, 0, [float("nan")] * 4), (1004, 1, [float("inf")] * 4), (1005, 1, []), (1100, 0, [2.0]), (1006, 1, [3.0, 1.0]), (1200, 1, [1e300, -1e300, 1e12, 0.0]), (1007, 1, [1e300, 1.0, 1.0, 1.0]), (1008, 0, [1e300] * 4), (-100, 0, [0.5] * 6), (1300, 7, [1.0] * 4)]
    assert found(spark, rows, every=20) == plain(rows, every=20)


def test_repeated_rows(spark, small):
    rows = some(40, 4, [0, 1], 5) + [(0, 0, [1.0] * 4)] * 3 + [(41, 1, [0.9] * 4)] * 2 + [(42, 0, [0.9] * 4)] * 2
    assert found(spark, rows, every=20) == plain(rows, every=20)


def test_no_anchor_and_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []
    assert found(spark, [(100, 0, [1.0]), (2, 1, [1.0])]) == []
