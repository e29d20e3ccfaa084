"""Models with regressors, retraining and the final test of every model, against plain versions."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import LOCAL_TZ, feature_columns
from tidemark.operators import analysis, contracts, features, gram, models, regressors, splits
from tidemark.plans import retraining


@pytest.fixture(scope="module")
def hours(spark):
    t = pd.date_range("2024-02-20", periods=24 * 24, freq="h")  # the clocks go forward on March 10
    rng = np.random.default_rng(3)
    y = np.round(100 + 40 * np.sin(np.arange(len(t)) * 2 * np.pi / 24) + rng.normal(0, 5, len(t)))
    pdf = pd.DataFrame({"timestamp": t, "trip_count": y.astype(int)})
    return pdf, spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def plain_features(y: list, at: pd.Timestamp) -> list:
    local = at.tz_localize("UTC").tz_convert(LOCAL_TZ)
    return [y[-1], y[-24], y[-168], local.hour, local.dayofweek]


def plain_forecast(pdf, n_train, n_test, params, horizon=24):
    t, y = list(pdf.timestamp), list(map(float, pdf.trip_count))
    x = np.array([plain_features(y[:i], t[i]) for i in range(168, n_train)])
    m = models.AdditiveModel(params, tuple(feature_columns("basic"))).fit(np.array(t[168:n_train], "datetime64[ns]"), np.array(y[168:n_train]), x)
    out = []
    for s in range(n_train, n_train + n_test, horizon):
        known = y[:s]
        for i in range(s, min(s + horizon, n_train + n_test)):
            known.append(float(m.predict(np.array([t[i]], "datetime64[ns]"), np.array([plain_features(known, t[i])]))[0]))
            out.append(known[-1])
    return out


def test_regressor_final_equals_plain_recursion(hours):
    pdf, df = hours
    params = {"changepoint_prior_scale": 0.1, "seasonality_mode": "multiplicative"}
    got = regressors.regressor_final(df, 2, params).orderBy("timestamp").toPandas()
    want = plain_forecast(pdf, len(pdf) - 48, 48, params)
    assert np.allclose(got.predicted, want, rtol=1e-9) and list(got.horizon_step) == [*range(1, 25)] * 2
    assert np.allclose(got.actual, pdf.trip_count[-48:])


def test_regressor_grid_by_fold(hours):
    _, df = hours
    cv = splits.cv_rows(df, 2, 48)
    grid = models.parameter_grid({"changepoint_prior_scale": [0.05, 0.5]}, "r")
    matrix = features.feature_matrix(df, "basic")
    fitted = regressors.fit_regressors(cv, matrix, grid).toPandas()
    assert sorted(zip(fitted.fold, fitted.parameter_set_id)) == [(1, "r_001"), (1, "r_002"), (2, "r_001"), (2, "r_002")]
    p = regressors.regressor_cv(df, cv, grid).toPandas()
    assert len(p) == 2 * 2 * 48 and np.isfinite(p.predicted).all()


def test_future_row_and_model_text(hours):
    pdf, _ = hours
    y = pdf.trip_count.to_numpy(float)
    row = regressors.future_row(y[:200], pd.Timestamp(pdf.timestamp[200], tz="UTC"))
    assert row["ds"] == pdf.timestamp[200] and row["lag_1"] == y[199] and row["lag_168"] == y[32] and all(isinstance(row[c], float) for c in feature_columns("basic"))
    m = models.AdditiveModel().fit(pdf.timestamp.to_numpy(), y)
    again = models.AdditiveModel.from_json(m.to_json())
    assert np.array_equal(m.predict(pdf.timestamp.to_numpy()), again.predict(pdf.timestamp.to_numpy()))


def test_retrain_and_final_test_of_every_model(spark, hours, tmp_path):
    _, df = hours
    out = str(tmp_path)
    chosen = {"prophet": {}, "prophet_regressor_basic": {}, "xgb_basic": {"n_estimators": 5}, "xgb_advanced": {"n_estimators": 5}}
    for key, spec in retraining.specifications(out).items():
        (tmp_path / key).mkdir()
        (tmp_path / key / "best_params.json").write_text(json.dumps({"parameter_set_id": "p_001", "params": chosen[key], "metrics": {"mae": 1.0}}))
    train, test = splits.holdout(df, 2)
    plans = retraining.retrain_plans(["all"], train, out)
    assert [p["train_val_rows"] for p in plans] == [528] * 4 and not any(p["final_test_used"] for p in plans)
    made = retraining.retrain(train, plans)
    assert [p["n_train_rows"] for p in made] == [528, 360, 360, 360]
    assert retraining.save_retraining(made, out).count() == 4
    registry, used = json.loads((tmp_path / "registry.json").read_text()), json.loads((tmp_path / "best_params_used.json").read_text())
    contracts.artefact_paths(registry, {k: s["model_path"] for k, s in retraining.specifications(out).items()})
    final = retraining.final_predictions(df, retraining.final_plans(["all"], registry, used), 2)
    contracts.require(contracts.models_aligned(final, 4, rows_per_model=48))
    direct = regressors.regressor_final(df, 2, {}).orderBy("timestamp").toPandas()
    stored = final.filter("model_label = 'Prophet-Regressor-Basic'").orderBy("timestamp").toPandas()
    assert np.allclose(direct.predicted, stored.predicted) and list(direct.forecast_origin) == list(stored.forecast_origin)
    plain = gram.additive_cv(regressors.final_rows(df, 2), [("b", {})]).orderBy("timestamp").toPandas()
    prophet = final.filter("model_label = 'Prophet'").orderBy("timestamp").toPandas()
    assert np.allclose(plain.predicted, prophet.predicted) and list(plain.origin_block) == list(prophet.origin_block) and list(prophet.forecast_origin) == list(stored.forecast_origin)
    (tmp_path / "metadata" / "prophet.json").write_text(json.dumps({"final_test_used": True}))
    with pytest.raises(ValueError):
        retraining.final_plans(["prophet"], registry, used)
    with pytest.raises(ValueError):
        contracts.artefact_paths(registry, {"prophet": "elsewhere"})


def test_selection():
    assert retraining.selection([" XGB_basic", "prophet", "xgb_basic"]) == ["xgb_basic", "prophet"] and len(retraining.selection(["ALL"])) == 4
    for bad in ([], ["all", "prophet"], ["arima"]):
        with pytest.raises(ValueError):
            retraining.selection(bad)


def test_manifests_and_seasonal(spark, hours, tmp_path):
    _, df = hours
    retraining.save_feature_columns(str(tmp_path / "columns.json"))
    assert json.loads((tmp_path / "columns.json").read_text())["basic"] == feature_columns("basic")
    grid = models.parameter_grid({"a": [1, 2, 3]}, "g", 2)
    retraining.save_tuning_parameters(str(tmp_path / "t.json"), "n", "m", "basic", {"a": [1, 2, 3]}, grid, 2, {"n_folds": 5}, note="x")
    kept = json.loads((tmp_path / "t.json").read_text())
    assert kept["n_parameter_sets_planned"] == 2 and kept["parameter_sets"][1] == {"parameter_set_id": "g_002", "params": {"a": 2}} and kept["note"] == "x"
    retraining.save_stage_summary({"rows": 3, "bad": float("nan")}, str(tmp_path), "s")
    assert json.loads((tmp_path / "s.json").read_text()) == {"rows": 3, "bad": None} and "rows: 3" in (tmp_path / "s.txt").read_text()
    retraining.save_tables({"x": df.limit(3), "y": df.limit(2)}, str(tmp_path / "d"))
    assert spark.read.option("header", True).csv(str(tmp_path / "d" / "y")).count() == 2
    assert retraining.seasonal_feature_set("(1, 0, 1, 24)") == "univariate_auto_sarima_m24" and retraining.seasonal_feature_set("") == "univariate_auto_sarima"
    assert retraining.seasonal_evaluation()["train_window_policy"] == "full_train_val"
    train, test = splits.holdout(df, 2)
    row = retraining.seasonal_runtime(models.seasonal_ar_predictions(train, test), 528, 1.0, 2.0, 0.5).first()
    assert row.feature_set == "univariate_auto_sarima_m24" and row.n_prediction_rows == 48 and row.total_runtime_seconds == 3.5


def test_frames(spark, hours):
    _, df = hours
    naive = df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    with pytest.raises(TypeError):
        contracts.require_utc(naive)
    assert contracts.require_utc(naive, allow_naive=True).select("timestamp").exceptAll(df.select("timestamp")).count() == 0
    with pytest.raises(TypeError):
        contracts.future_index(spark, ["2024-01-01T00:00:00"])
    with pytest.raises(ValueError):
        contracts.future_index(spark, ["2024-01-01T00:00:00+00:00"] * 2)
    v = contracts.validation_frame(spark, [("2024-01-01T02:00:00+00:00", 2), ("2024-01-01T01:00:00+00:00", None)]).orderBy("timestamp").collect()
    assert [r.trip_count for r in v] == [None, 2.0]
    assert contracts.validation_frame(spark, df.select("timestamp")).filter("trip_count IS NOT NULL").count() == 0
    contracts.require(contracts.time_frame_contract(df))
    with pytest.raises(ValueError):
        contracts.require(contracts.time_frame_contract(df.union(df)))
    matrix = features.feature_matrix(df, "basic")
    contracts.require(contracts.regressor_frame_contract(matrix, df))
    with pytest.raises(ValueError):
        contracts.require(contracts.regressor_frame_contract(matrix.withColumn("lag_1", F.lit(float("nan"))), df))
    small = spark.createDataFrame([("a", 1), ("b", 2)], "m string, n int")
    assert analysis.the_row(small, m="b").n == 2
    with pytest.raises(LookupError):
        analysis.the_row(small, m="b", n=1)
