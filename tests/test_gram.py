"""Additive models from Gram matrices against fits on the rows."""

import datetime as dt

import numpy as np
import pytest

from tidemark.config import PROPHET_SPACE, feature_columns
from tidemark.operators import features, gram, models, ordered, regressors, splits

START = dt.datetime(2024, 1, 1)


def hours(spark, n=500, seed=1, keys=("a",)):
    rng = np.random.default_rng(seed)
    rows = [(k, START + dt.timedelta(hours=h), float(30 + 9 * np.sin(h / 24 * 2 * np.pi) + 0.02 * h + rng.integers(0, 7))) for k in keys for h in range(n)]
    return spark.createDataFrame(rows, "k string, timestamp timestamp, trip_count double").repartition(3)


def beta_of(model):
    return np.concatenate([np.asarray(model.beta[k]) for k in ("trend", "daily", "weekly", "regressors") if k in model.beta])


def test_every_set_and_fold(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SECONDS", 100 * 3600)
    s = hours(spark, keys=("a", None))
    cv = splits.cv_rows(s, 3, 60, series=["k"])
    grid = models.parameter_grid(PROPHET_SPACE, "p")
    grams = gram.fold_grams(cv, s, (), ["k"])
    assert grams.count() == 2 * 3
    got = gram.fit_sets(grams, grid, (), ["k"]).collect()
    assert len(got) == 2 * 3 * 24
    rows = {k: sorted(((r["timestamp"], r["trip_count"]) for r in s.collect() if r["k"] == k)) for k in ("a", None)}
    for r in got:
        n = 320 + 60 * (r["fold"] - 1)
        assert r["n_train_rows"] == n
        own = rows[r["k"]][:n]
        plain = models.AdditiveModel(dict(grid)[r["parameter_set_id"]]).fit(np.array([t for t, _ in own], "datetime64[ns]"), np.array([v for _, v in own]))
        made = models.AdditiveModel.from_json(bytes(r["body"]))
        assert np.allclose(beta_of(made), beta_of(plain), rtol=1e-6, atol=1e-8) and abs(made.noise - plain.noise) < 1e-6 and made.length == plain.length


def test_with_regressors(spark):
    s = hours(spark).drop("k")
    cv, columns = splits.cv_rows(s, 2, 60), tuple(feature_columns("basic"))
    matrix = features.feature_matrix(s, "basic")
    grid = [("x", {}), ("m", {"seasonality_mode": "multiplicative", "seasonality_prior_scale": 1.0})]
    got = {(r["fold"], r["parameter_set_id"]): models.AdditiveModel.from_json(bytes(r["body"])) for r in gram.fit_sets(gram.fold_grams(cv, matrix, columns), grid, columns).collect()}
    want = {(r["fold"], r["parameter_set_id"]): models.AdditiveModel.from_json(bytes(r["body"])) for r in regressors.fit_regressors(cv, matrix, grid).collect()}
    assert got.keys() == want.keys()
    for k, m in want.items():
        assert np.allclose(beta_of(got[k]), beta_of(m), rtol=1e-5, atol=1e-7) and np.allclose(got[k].x_mean, m.x_mean) and np.allclose(got[k].x_std, m.x_std)


def test_forecasts_equal_fits_on_rows(spark):
    s = hours(spark).drop("k")
    cv = splits.cv_rows(s, 2, 50)
    grid = models.parameter_grid({"changepoint_prior_scale": [0.05, 0.5], "seasonality_mode": ["additive", "multiplicative"]}, "p")
    got = {(r["fold"], r["parameter_set_id"], r["timestamp"]): r for r in gram.additive_cv(cv, grid, 24).collect()}
    rows = cv.collect()
    assert len(got) == 2 * 4 * 50
    for fold in (1, 2):
        train = sorted((r["timestamp"], r["trip_count"]) for r in rows if r["fold"] == fold and r["role"] == "train")
        val = sorted((r["timestamp"], r["trip_count"]) for r in rows if r["fold"] == fold and r["role"] == "validation")
        for name, p in grid:
            m = models.AdditiveModel(p).fit(np.array([t for t, _ in train], "datetime64[ns]"), np.array([v for _, v in train]))
            for i, ((t, v), y) in enumerate(zip(val, m.predict(np.array([t for t, _ in val], "datetime64[ns]")))):
                r = got[fold, name, t]
                assert r["predicted"] == pytest.approx(y, abs=1e-6) and (r["actual"], r["origin_block"], r["horizon_step"]) == (v, i // 24 + 1, i % 24 + 1)


def test_nulls_and_empty(spark):
    s = hours(spark).drop("k")
    cv = splits.cv_rows(s, 2, 50)
    holes = s.unionByName(spark.createDataFrame([(None, 3.0), (START, None)], "timestamp timestamp, trip_count double"))
    a, b = (sorted((r["segment"], r["n"]) for r in gram.fold_grams(cv, d).collect()) for d in (s, holes))
    assert a == b == [(0, 400), (1, 50)]
    assert gram.fit_sets(gram.fold_grams(cv.limit(0), s.limit(0)), [("x", {})]).count() == 0
