"""The batched grid search against one set at a time and step by step."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.config import feature_columns
from tidemark.operators import boosting, features, forecast, models, splits


def rows(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 30, n), rng.normal(size=n), np.arange(n) % 24, np.full(n, 3.0)]).astype(float)
    return x, 5 * np.sin(x[:, 2] / 4) + x[:, 0] * 0.3 + rng.normal(size=n)


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_sets_together_equal_sets_alone(depth):
    x, y = rows()
    codes, cuts = boosting.binned(x)
    cells = np.array([len(c) + 1 for c in cuts])
    sets = [boosting.DEFAULTS | {"learning_rate": lr, "max_depth": depth, "min_child_weight": w, "subsample": s, "colsample_bytree": c} for lr in (0.05, 0.3) for w, s, c in ((1, 1.0, 1.0), (10, 0.7, 0.5), (200, 1.0, 1.0))]
    both = boosting.boost(codes, cells, y, sets, 25)
    for i, s in enumerate(sets):
        alone = boosting.boost(codes, cells, y, [s], 25)
        for k in (1, 10, 25):
            at = np.full(len(x), i), np.full(len(x), k)
            assert np.allclose(boosting.predict(both, cuts, x, *at), boosting.predict(alone, cuts, x, np.zeros(len(x), int), at[1]))
        if s["subsample"] == 1:
            plain = models.BoostedTrees(25, s["learning_rate"], depth, min_child_weight=s["min_child_weight"]).fit(x, y)
            assert np.allclose(plain.predict(x), boosting.predict(both, cuts, x, np.full(len(x), i), np.full(len(x), 25)))


def test_more_trees_begin_with_fewer():
    x, y = rows()
    codes, cuts = boosting.binned(x)
    cells = np.array([len(c) + 1 for c in cuts])
    s = [boosting.DEFAULTS | {"subsample": 0.8, "colsample_bytree": 0.8}]
    long, short = (boosting.boost(codes, cells, y, s, n) for n in (30, 12))
    assert all(np.array_equal(long[k][:12], short[k]) for k in ("feature", "cut", "leaf"))


def test_batches_keep_every_set_once():
    grid = models.parameter_grid({"n_estimators": [3, 5], "learning_rate": [0.1, 0.2], "max_depth": [2, 4], "min_child_weight": [1, 2, 3, 4]}, "g")
    made = boosting.batches(grid)
    assert sorted(n for b in made for n, _ in b) == sorted(n for n, _ in grid)
    assert all(len({p["max_depth"] for _, p in b}) == 1 and len({str({k: v for k, v in p.items() if k != "n_estimators"}) for _, p in b}) <= boosting.TOGETHER for b in made)
    with pytest.raises(ValueError):
        boosting.batches([("x", {"depth": 3})])


@pytest.mark.parametrize("kind", ["basic", "advanced"])
def test_forecasts_equal_a_plain_recursion(spark, kind):
    """Every set and fold, with a short last block, against one fitted model stepped by ``recursive_forecast``."""
    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    y = [float(20 + 8 * np.sin(h / 24 * 2 * np.pi) + rng.integers(0, 6)) for h in range(420)]
    s = spark.createDataFrame([(start + dt.timedelta(hours=h), v) for h, v in enumerate(y)], "timestamp timestamp, trip_count double").repartition(3)
    grid = [("a", {"n_estimators": 8, "max_depth": 2}), ("b", {"n_estimators": 20, "max_depth": 2}), ("c", {"n_estimators": 9, "max_depth": 3, "min_child_weight": 4})]
    got = boosting.grid_cv(s, splits.cv_rows(s, 2, 40), grid, kind, 24).collect()
    assert len(got) == 3 * 2 * 40
    found = {(r["parameter_set_id"], r["fold"], r["timestamp"]): r for r in got}
    matrix = {r["timestamp"]: r for r in features.feature_matrix(s, kind).collect()}

    columns, times = feature_columns(kind), [start + dt.timedelta(hours=h) for h in range(420)]
    for fold, first in ((1, 340), (2, 380)):
        train = [matrix[t] for t in times[:first] if t in matrix]
        x, target = np.array([[r[c] for c in columns] for r in train], float), np.array([r["trip_count"] for r in train])
        for name, p in grid:
            codes, cuts = boosting.binned(x)
            trees = boosting.boost(codes, np.array([len(c) + 1 for c in cuts]), target, [boosting.DEFAULTS | p], p["n_estimators"])
            one = np.zeros(1, int), np.array([p["n_estimators"]])
            for block, at in enumerate(range(first, first + 40, 24), 1):
                ahead = range(at, min(at + 24, first + 40))

                path = forecast.recursive_forecast(lambda row: boosting.predict(trees, cuts, row.reshape(1, -1), *one)[0], np.array(y[:at]), [pd.Timestamp(times[h]) for h in ahead], kind)
                for step, (h, v) in enumerate(zip(ahead, path), 1):
                    r = found[name, fold, times[h]]
                    assert abs(r["predicted"] - v) < 1e-9 and (r["actual"], r["horizon_step"], r["origin_block"]) == (y[h], step, block)
