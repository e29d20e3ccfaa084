"""Retraining the best sets and testing every model: specifications, plans, registry, artefacts, summaries."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LOCAL_TZ, METRICS, TARGET, TIMESTAMP, SarimaSettings, feature_columns
from ..operators import features, forecast, models, regressors, splits, timeaxis
from ..sources import tables, tracking

#: Key, label, family and feature set of each model.
MODELS = [
    ("prophet", "Prophet", "prophet", "none"),
    ("prophet_regressor_basic", "Prophet-Regressor-Basic", "prophet_regressor", "basic"),
    ("xgb_basic", "XGBoost-Basic", "xgboost", "basic"),
    ("xgb_advanced", "XGBoost-Advanced", "xgboost", "advanced"),
]


def specifications(output: str) -> dict[str, dict]:
    """Label, family, feature set and paths by model key."""
    names = ("model_key", "model_label", "model_name", "feature_set")
    root = Path(output)
    paths = lambda key: {"best_params_path": root / key / "best_params.json", "model_path": root / "models" / key, "metadata_path": root / "metadata" / f"{key}.json"}
    return {m[0]: dict(zip(names, m)) | {k: str(p) for k, p in paths(m[0]).items()} for m in MODELS}


def selection(names: list[str], known: list[str] = tuple(m[0] for m in MODELS)) -> list[str]:
    """Model keys in the order given, once each; ``all`` stands alone for every one."""
    wanted = list(dict.fromkeys(n.strip().lower() for n in names))
    if not wanted or ("all" in wanted and len(wanted) > 1):
        raise ValueError("give model keys, or 'all' alone")
    if unknown := set(wanted) - {*known, "all"}:
        raise ValueError(f"unknown models: {sorted(unknown)}")
    return list(known) if wanted == ["all"] else wanted


def retrain_plans(selected: list[str], train: DataFrame, output: str) -> list[dict]:
    """Specification, best parameters and training span of each model; the final test is never read."""
    span = train.agg(F.count(F.lit(1)).alias("train_val_rows"), F.min(TIMESTAMP).alias("train_start"), F.max(TIMESTAMP).alias("train_end")).first().asDict()
    out, specs = [], specifications(output)
    for key in selection(selected):
        spec = specs[key]
        best = tracking.best_parameters(spec["best_params_path"])
        columns = feature_columns(spec["feature_set"]) if spec["feature_set"] != "none" else []
        out.append(spec | span | {"parameter_set_id": best["parameter_set_id"], "params": best["params"], "best_cv_metrics": best.get("metrics", {}), "feature_columns": columns, "final_test_used": False})
    return out


def payload(plan: dict, train_rows: int, seconds: float, **extra) -> dict:
    """The record of one trained model."""
    return plan | {"status": "success", "n_train_rows": int(train_rows), "train_time_seconds": float(seconds), "prediction_time_seconds": 0.0, "total_runtime_seconds": float(seconds), "final_test_used": False, "tuning_added": False} | extra


def retrain(train: DataFrame, plans: list[dict], tz: str = LOCAL_TZ, target: str = TARGET, overwrite: bool = False) -> list[dict]:
    """Fits each plan on the whole training stretch and writes its model as a table of one row; a payload each."""
    spark, out = train.sparkSession, []
    for plan in plans:
        kind, params = plan["feature_set"], plan["params"]
        if plan["model_name"] == "xgboost":
            rows = train.withColumn("role", F.lit("train")).withColumn("fold", F.lit(0))
            fitted = models.fit_grid(rows, features.feature_matrix(train, kind, tz=tz, target=target), [(plan["parameter_set_id"], params)], kind, target=target).drop("fold", "parameter_set_id")
        else:
            fitted = regressors.retrain_additive(train, params, None if kind == "none" else kind, tz, target)
        tables.write(fitted, plan["model_path"], overwrite=overwrite)
        row = spark.read.parquet(plan["model_path"]).select("n_train_rows", "train_time_seconds").first()
        out.append(payload(plan, row["n_train_rows"], row["train_time_seconds"]))
    return out


def save_retraining(payloads: list[dict], output: str) -> DataFrame:
    """Metadata by model, the registry, the parameters used and the runtime summary; the summary is returned."""
    for p in payloads:
        tracking.write_json(p, p["metadata_path"])
    keys = ("model_label", "model_name", "feature_set", "model_path", "metadata_path", "feature_columns")
    tracking.write_json({p["model_key"]: {k: p[k] for k in keys} | {"artifact_format": "parquet"} for p in payloads}, f"{output}/registry.json")
    tracking.write_json({p["model_key"]: {k: p[k] for k in ("parameter_set_id", "params", "best_cv_metrics")} for p in payloads}, f"{output}/best_params_used.json")
    columns = [("model_key", "string"), ("model_label", "string"), ("feature_set", "string"), ("parameter_set_id", "string"), ("n_train_rows", "bigint"), ("train_time_seconds", "double"), ("status", "string")]
    return SparkSession.active().createDataFrame([tuple(p[c] for c, _ in columns) for p in payloads], ", ".join(f"{c} {t}" for c, t in columns))


def final_plans(selected: list[str], registry: dict, used: dict) -> list[dict]:
    """Registered models with their parameters; one that has seen the final test is an error."""
    out = []
    for key in selection(selected, list(registry)):
        if key not in used:
            raise ValueError(f"no parameters of {key}")
        entry = registry[key]
        if gone := [entry[p] for p in ("model_path", "metadata_path") if not Path(entry[p]).exists()]:
            raise FileNotFoundError(f"no such file: {gone}")
        if tracking.read_json(entry["metadata_path"]).get("final_test_used", True):
            raise ValueError(f"{key} has seen the final test")
        out.append({"model_key": key} | entry | used[key])
    return out


def final_predictions(series: DataFrame, plans: list[dict], test_days: int, horizon: int = 24, tz: str = LOCAL_TZ, target: str = TARGET) -> DataFrame:
    """Every planned model's forecast of the final test, from its stored artefact, with actuals handed over after each block."""
    spark, test = series.sparkSession, forecast.holdout_rows(series, test_days)
    parts = []
    for plan in plans:
        body = spark.read.parquet(plan["model_path"]).select(F.lit(0).alias("fold"), F.lit(plan["parameter_set_id"]).alias("parameter_set_id"), "body")
        args = (series, test, body)
        if plan["model_name"] == "xgboost":
            rows = forecast.fitted_predictions(*args, models.load_tree, plan["feature_set"], plan["model_label"], horizon, tz=tz, target=target)
        elif plan["model_name"] == "prophet_regressor":
            rows = regressors.regressor_predictions(*args, plan["feature_set"], plan["model_label"], horizon, tz=tz, target=target)
        else:
            rows = direct_final(series, test, body, plan["model_label"], horizon, target)
        parts.append(rows)
    return tables.union_by_name(*parts).withColumnRenamed("model_name", "model_label")


def direct_final(series: DataFrame, test: DataFrame, model: DataFrame, label: str, horizon: int = 24, target: str = TARGET) -> DataFrame:
    """The final test by a model without lags, one call for all blocks; the same columns as the recursive forecasts."""
    stored = models.AdditiveModel.from_json(bytes(model.first()["body"]))  # one model of about 40 numbers
    at = splits.with_position(series).withColumn("forecast_origin", F.lag(TIMESTAMP).over(timeaxis.over_time([]))).select(TIMESTAMP, "forecast_origin")
    blocks = splits.origin_blocks(test, horizon).join(at, TIMESTAMP)
    first = blocks.groupBy("fold", "origin_block").agg(F.min_by("forecast_origin", "horizon_step").alias("forecast_origin"))
    rows = blocks.drop("forecast_origin").join(first, ["fold", "origin_block"]).join(model.select("fold", "parameter_set_id"), "fold")

    @F.pandas_udf("double")
    def yhat(t: pd.Series) -> pd.Series:
        return pd.Series(stored.predict(t.to_numpy()))

    return rows.select(TIMESTAMP, F.col(target).cast("double").alias("actual"), yhat(F.col(TIMESTAMP)).alias("predicted"), F.lit(label).alias("model_name"), F.lit("none").alias("feature_set"), "parameter_set_id", "fold", "forecast_origin", "horizon_step", "origin_block", F.lit(False).alias("used_actual_future_for_features"))


# --- manifests and summaries


def save_feature_columns(path: str) -> None:
    tracking.write_json({kind: feature_columns(kind) for kind in ("basic", "advanced")}, path)


def save_tuning_parameters(path: str, name: str, model: str, kind: str, space: dict, grid: list[tuple[str, dict]], limit: int | None, cv: dict, primary: str = METRICS[0], secondary: str = METRICS[1], **extra) -> None:
    """The search space and the sets that a run takes from it."""
    sets = [{"parameter_set_id": i, "params": p} for i, p in grid]
    made = {"experiment_name": name, "model_name": model, "feature_set": kind, "search_space": space, "max_parameter_sets": limit, "n_parameter_sets_planned": len(sets), "parameter_sets": sets}
    tracking.write_json(made | {"cv_config": cv, "primary_metric": primary, "secondary_metric": secondary} | extra, path)


def save_tables(frames: dict[str, DataFrame], folder: str, format: str = "csv", overwrite: bool = False) -> None:
    """A table by name, such as those of the residual diagnostics."""
    for name, df in frames.items():
        tables.write(df, f"{folder.rstrip('/')}/{name}", format, overwrite)


def save_stage_summary(summary: dict, folder: str, name: str) -> None:
    """A stage's summary as JSON and as lines of text."""
    tracking.write_json(summary, f"{folder}/{name}.json")
    Path(folder, f"{name}.txt").write_text("\n".join(f"{k}: {v}" for k, v in tracking.plain(summary).items()) + "\n")


def feature_summary(source: DataFrame, matrices: dict[str, DataFrame], tz: str = LOCAL_TZ, target: str = TARGET) -> DataFrame:
    """A row by feature set: rows, columns, rows lost to the look-back, period, steps that aren't an hour, leakage."""
    n = source.agg(F.count(F.lit(1)).alias("source_rows"))
    parts = []
    for kind, m in matrices.items():
        step = F.unix_timestamp(TIMESTAMP) - F.unix_timestamp(F.lag(TIMESTAMP).over(timeaxis.over_time([])))
        row = m.withColumn("step_", step).agg(F.count(F.lit(1)).alias("n_rows"), F.min(TIMESTAMP).alias("period_start"), F.max(TIMESTAMP).alias("period_end"), F.count_if(F.col("step_") != 3600).alias("non_hourly_steps"))
        leaks = features.leakage_check(m, source, kind, tz=tz).agg(F.sum("mismatches").cast("bigint").alias("leakage_mismatches"))
        own = row.join(leaks).join(n).withColumn("dropped_rows_due_to_history", F.col("source_rows") - F.col("n_rows"))
        parts.append(own.select(F.lit(kind).alias("feature_set"), F.lit(len(m.columns)).alias("n_columns"), F.lit(len(feature_columns(kind))).alias("n_feature_columns"), "*"))
    return tables.union_by_name(*parts)


def dm_run_summary(predictions: DataFrame, by_block: DataFrame, by_step: DataFrame, by_time: DataFrame, n_comparisons: int, seconds: float = 0.0) -> DataFrame:
    """One row: predictions, models, comparisons and tests of a Diebold-Mariano run."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    own = predictions.agg(F.count(F.lit(1)).alias("n_prediction_rows"), F.count_distinct("model_label").alias("n_models"))
    tests = count(by_block, "n_block_level_tests").join(count(by_step, "n_by_horizon_tests")).join(count(by_time, "n_timestamp_level_tests"))
    return own.join(tests).select(F.lit("Diebold-Mariano").alias("statistical_test"), "*", F.lit(n_comparisons).alias("n_comparisons"), F.lit(2).alias("n_loss_types"), F.lit(float(seconds)).alias("total_runtime_seconds"), F.lit("success").alias("status"))


def seasonal_feature_set(seasonal_order: str) -> str:
    """The feature-set name of a seasonal model, with the period parsed from ``(P, D, Q, m)``."""
    parts = [p.strip() for p in seasonal_order.strip().strip("()").split(",")]
    return "univariate_auto_sarima" + (f"_m{parts[3]}" if len(parts) == 4 else "")


def seasonal_evaluation(settings: SarimaSettings | None = None, horizon: int = 24) -> dict:
    """Window, horizon and update policy of the seasonal model's test."""
    s = settings or SarimaSettings()
    window = "tail_train_val_window" if s.max_train_rows > 0 else "full_train_val"
    return {"max_train_rows": s.max_train_rows, "train_window_policy": window, "forecast_horizon_hours": horizon, "rolling_origin_block_hours": horizon, "update_with_actuals_after_each_block": True, "update_maxiter": s.update_maxiter, "final_test_used_for_tuning": False}


def seasonal_runtime(predictions: DataFrame, n_train_rows: int, train_seconds: float, forecast_seconds: float, update_seconds: float = 0.0) -> DataFrame:
    """One row: sizes and times of the seasonal model's run."""
    order = F.concat(F.lit("("), F.concat_ws(", ", F.from_json("params_json", "seasonal_order array<int>")["seasonal_order"]), F.lit(")"))
    own = predictions.agg(F.count(F.lit(1)).alias("n_prediction_rows"), F.first(order).alias("seasonal_order"), F.first("model_label").alias("model_label"))
    took = forecast_seconds + update_seconds
    values = {"n_train_rows": n_train_rows, "train_time_seconds": train_seconds, "prediction_time_seconds": took, "forecast_time_seconds": forecast_seconds, "update_time_seconds": update_seconds, "total_runtime_seconds": train_seconds + took, "status": "success", "error_message": ""}
    period = F.trim(F.element_at(F.split(F.regexp_replace("seasonal_order", "[()]", ""), ","), 4))
    return own.withColumn("feature_set", F.concat(F.lit("univariate_auto_sarima_m"), period)).select("*", *(F.lit(v).alias(k) for k, v in values.items()))
