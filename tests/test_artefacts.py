"""Stored artefacts under their contracts: round trips through files, and every way to break one."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import artefacts as a

LABELS = ["XGBoost-Basic", "other", "Prophet"]


def metrics(spark, **more):
    row = {"model_label": "x", "model_key": "k", "feature_set": "basic", "parameter_set_id": "p1", "prediction_time_seconds": "1.5", "retraining_train_time_seconds": "slow", "used_actual_future_for_features": "no", "final_test_used_for_tuning": " FALSE ", "mae": "1", "rmse": "2e0", "mape": "", "smape": "4"} | more
    return spark.createDataFrame([tuple((row | {"model_label": m}).values()) for m in LABELS], ", ".join(f"`{c}` string" for c in row))


def predictions(spark, **more):
    row = {"timestamp": "2024-07-01T03:00:00+00:00", "actual": "5", "predicted": "7.5", "model_label": "x", "model_key": "k", "feature_set": "basic", "parameter_set_id": "p1", "horizon_step": "1", "origin_block": "2.0", "prediction_time_seconds": "0.1", "used_actual_future_for_features": "0"} | more
    return spark.createDataFrame([tuple((row | {"model_label": m}).values()) for m in LABELS], ", ".join(f"`{c}` string" for c in row))


def stored(df, path):
    df.coalesce(1).write.option("header", True).csv(str(path))
    return str(path)


def test_metrics_and_runtime(spark, tmp_path):
    path = stored(metrics(spark, total_runtime_seconds="9", extra="z"), tmp_path / "m")
    got = a.load(spark, path, a.FINAL_METRICS).collect()
    assert {(r["mae"], r["rmse"], r["mape"], r["prediction_time_seconds"], r["retraining_train_time_seconds"], r["total_runtime_seconds"], r["final_test_used_for_tuning"], r["extra"]) for r in got} == {(1.0, 2.0, None, 1.5, None, 9.0, False, "z")}
    assert [r["model_label"] for r in a.load(spark, path, a.ANALYSED_METRICS).collect()] == ["Prophet", "XGBoost-Basic", "other"]
    runtime = metrics(spark, model_load_time_seconds="1", total_runtime_seconds="2", retraining_train_time_seconds="3", status="success")
    path = stored(runtime, tmp_path / "r")
    assert a.load(spark, path, a.FINAL_RUNTIME).first()["retraining_train_time_seconds"] == 3.0
    assert a.load(spark, path, a.ANALYSED_RUNTIME).first()["model_label"] == "Prophet"
    with pytest.raises(ValueError, match="3 values of total_runtime_seconds are no number, such as 'two'"):
        a.load(spark, stored(runtime.withColumn("total_runtime_seconds", F.lit("two")), tmp_path / "r2"), a.FINAL_RUNTIME)


def test_predictions(spark, tmp_path):
    path = stored(predictions(spark), tmp_path / "p")
    r = a.load(spark, path, a.FINAL_PREDICTIONS).first()
    assert (r["model_label"], r["residual"], r["absolute_error"], r["squared_error"], r["horizon_step"], r["origin_block"], r["local_hour"], r["local_day_of_week"], r["local_is_weekend"]) == ("Prophet", -2.5, 2.5, 6.25, 1, 2, 23, 6, 1)
    r = a.load(spark, path, a.ANALYSED_PREDICTIONS).first()
    assert (r["local_month"], r["local_day_name"]) == (6, "Sunday")
    kept = a.load(spark, stored(predictions(spark, residual="1", local_hour="4", local_day_of_week="2"), tmp_path / "q"), a.ANALYSED_PREDICTIONS).first()
    assert (kept["residual"], kept["absolute_error"], kept["local_hour"], kept["local_day_name"], kept["local_is_weekend"]) == (1.0, 1.0, 4, "Wednesday", 0)


@pytest.mark.parametrize("column, value", [("timestamp", "noon"), ("actual", "x"), ("horizon_step", "1.5"), ("origin_block", None), ("used_actual_future_for_features", "maybe"), ("used_actual_future_for_features", None), ("residual", "?")])
def test_faults_are_errors(spark, tmp_path, column, value):
    with pytest.raises(ValueError, match=f"3 values of {column} are no"):
        a.load(spark, stored(predictions(spark, **{column: value}), tmp_path / "p"), a.FINAL_PREDICTIONS)


def test_absent_files_and_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        a.load(spark, str(tmp_path / "no"), a.FINAL_METRICS)
    with pytest.raises(ValueError, match="missing columns.*predicted"):
        a.load(spark, stored(predictions(spark).drop("predicted"), tmp_path / "p"), a.FINAL_PREDICTIONS)


def test_tuning_run(spark, tmp_path):
    folder = tmp_path / "run"
    sets = spark.createDataFrame([("p1", "1"), ("p2", "2")], "parameter_set_id string, fold string")
    stored(sets.withColumns({m: F.lit("3") for m in ("mae", "rmse", "mape", "smape")}), folder / "cv_metrics.csv")
    for n in ("cv_metrics_summary", "runtime_summary"):
        stored(sets, folder / f"{n}.csv")
    with pytest.raises(FileNotFoundError, match="best_params"):
        a.load_tuning(spark, str(folder), "m")
    (folder / "best_params.json").write_text(json.dumps({"parameter_set_id": "p2", "params": {"x": 1}, "selection_rule": "least mae"}))
    (folder / "experiment_metadata.json").write_text("{}")
    got = a.load_tuning(spark, str(folder), "m")
    assert got["params"] == {"x": 1} and [(r["parameter_set_id"], r["fold"], r["mae"]) for r in got["best_metrics"].collect()] == [("p2", 2, 3.0)] and got["best_summary"].count() == got["best_runtime"].count() == 1
    with pytest.raises(FileNotFoundError, match="cv_predictions"):
        a.load_tuning(spark, str(folder), "m", predictions=True)
    stored(predictions(spark, parameter_set_id="p2", model_name="n", fold="2", residual="99"), folder / "cv_predictions.csv")
    r = a.load_tuning(spark, str(folder), "m", predictions=True)["best_predictions"].first()
    assert (r["model_label"], r["fold"], r["residual"], r["local_hour"]) == ("m", 2, -2.5, 23)
    (folder / "best_params.json").write_text(json.dumps({"parameter_set_id": "p9"}))
    with pytest.raises(ValueError, match="p9"):
        a.load_tuning(spark, str(folder), "m")
