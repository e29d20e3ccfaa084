"""Shapley values from paths against the definition."""

import itertools
from math import comb

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import boosting, models, shapley


def expected(tree, x, known, at=0):
    feature, cut, left, right, leaf, rows, *_ = tree[at]
    if feature < 0:
        return np.full(len(x), leaf)
    a, b = (expected(tree, x, known, k) for k in (left, right))
    if feature in known:
        return np.where(x[:, feature] <= cut, a, b)
    return (tree[left][5] * a + tree[right][5] * b) / rows


def by_definition(trees, x):
    """Every coalition of the features that a tree uses."""
    out, base = np.zeros(x.shape), 0.0
    for t in trees:
        used = sorted({n[0] for n in t if n[0] >= 0})
        value = {s: expected(t, x, set(s)) for k in range(len(used) + 1) for s in itertools.combinations(used, k)}
        base += float(value[()].mean())
        for f in used:
            rest = [u for u in used if u != f]
            for k in range(len(used)):
                for s in itertools.combinations(rest, k):
                    out[:, f] += (value[tuple(sorted((*s, f)))] - value[s]) / (len(used) * comb(len(used) - 1, k))
    return base, out


def data(n=400, width=6, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=(n, width - 2)), rng.integers(0, 4, n), np.ones(n)])
    return x, x[:, 0] * 2 + np.sin(3 * x[:, 1]) * (x[:, 4] > 1) + x[:, 2] * x[:, 3] + rng.normal(scale=0.1, size=n)


def test_equal_to_the_definition():
    x, y = data()
    for depth in (1, 2, 4, 6):
        m = models.BoostedTrees(6, 0.3, depth, min_child_weight=3).fit(x, y)
        base, phi = m.shap(x[:40])
        want_base, want = by_definition(m.trees, x[:40])
        assert np.allclose(phi, want, atol=1e-10) and abs(base - m.base - want_base) < 1e-10
        assert np.allclose(base + phi.sum(axis=1), m.predict(x[:40]))


def test_trees_of_the_grid_search_and_blocks_of_rows(monkeypatch):
    x, y = data()
    codes, cuts = boosting.binned(x)
    sets = [boosting.DEFAULTS | {"max_depth": d} for d in (5,)] + [boosting.DEFAULTS | {"max_depth": 5, "min_child_weight": 60}]
    made = boosting.boost(codes, np.array([len(c) + 1 for c in cuts]), y, sets, 5)
    for which in (0, 1):
        trees = boosting.listed(made, cuts, which)
        base, phi = shapley.values(shapley.path_table(trees), x)
        _, want = by_definition(trees, x)
        assert np.allclose(phi, want, atol=1e-10)
        assert np.allclose(float(made["base"]) + base + phi.sum(axis=1), boosting.predict(made, cuts, x, np.full(len(x), which), np.full(len(x), 5)))
        monkeypatch.setattr(shapley, "HELD", 1)
        assert np.allclose(shapley.values(shapley.path_table(trees), x[:7])[1], phi[:7])
        monkeypatch.undo()


def test_a_leaf_alone_and_no_trees():
    assert shapley.values(shapley.path_table([[(-1, 0.0, 0, 0, 2.5, 10.0)]]), np.ones((3, 2)))[0] == 2.5
    assert not shapley.values(shapley.path_table([]), np.ones((3, 2)))[1].any()


def test_rows_in_tasks(spark):
    x, y = data(200)
    names = [f"f{i}" for i in range(x.shape[1])]
    m = models.BoostedTrees(20, 0.2, 7, min_child_weight=2).fit(x, y)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "timestamp long, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {r["timestamp"]: r for r in shapley.shap_rows(df, m.trees, names).collect()}
    want = m.shap(x)[1]
    assert len(got) == 200 and all(np.allclose([got[i][f"shap__{n}"] for n in names], want[i]) for i in range(200))
    imp = models.shap_importance(shapley.shap_rows(df, m.trees, names), names).agg(F.sum("share")).first()[0]
    assert abs(imp - 1) < 1e-9
