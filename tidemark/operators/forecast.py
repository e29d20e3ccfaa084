"""Rolling-origin forecasts.

With actuals handed over after each block, blocks don't depend on each other: every block is one
row holding its last 168 actuals, and all blocks of all series, folds and models run in parallel.
Closed-form models run as an ``aggregate`` over an array inside the JVM; any object with
``predict(features) -> float`` runs in ``applyInPandas``, one group per block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CALENDAR, LAGS, LOCAL_TZ, MEAN_WINDOWS, STD_WINDOWS, TARGET, TIMESTAMP, feature_columns, feature_set, required_history
from .splits import origin_blocks, with_position
from .timeaxis import over_time

PREDICTION_COLUMNS = ["timestamp", "actual", "predicted", "model_name", "feature_set", "parameter_set_id", "fold", "forecast_origin", "horizon_step", "origin_block", "used_actual_future_for_features"]


def block_rows(history: DataFrame, validation: DataFrame, horizon: int = 24, series: list[str] = (), target: str = TARGET, look_back: int | None = None) -> DataFrame:
    """One row per fold and block: its steps (timestamp, actual) in order and the ``look_back`` actuals before it.

    ``history``: the whole series; ``validation``: rows of ``cv_rows`` with role validation, or any
    rows with ``pos``, ``val_start`` and ``fold``.
    """
    keys, back = list(series), look_back or required_history()
    y = F.col(target).cast("double")
    w = over_time(keys)
    past = history.select(*keys, TIMESTAMP, F.collect_list(y).over(w.rowsBetween(-back, -1)).alias("history"), F.lag(TIMESTAMP).over(w).alias("forecast_origin"))
    blocks = origin_blocks(validation, horizon)
    steps = blocks.groupBy(*keys, "fold", "origin_block").agg(F.array_sort(F.collect_list(F.struct("horizon_step", TIMESTAMP, y.alias("actual")))).alias("steps"), F.min(TIMESTAMP).alias(TIMESTAMP))
    return steps.join(past, [*keys, TIMESTAMP]).drop(TIMESTAMP)


def _long(predicted: DataFrame, keys: list[str], model: str, kind: str, parameter_set_id: str) -> DataFrame:
    """Blocks with an array ``path`` of predictions to the long form."""
    rows = predicted.select(*keys, "fold", "origin_block", "forecast_origin", F.explode(F.arrays_zip("steps", "path")).alias("x"))
    return rows.select(*keys, F.col(f"x.steps.{TIMESTAMP}").alias(TIMESTAMP), F.col("x.steps.actual").alias("actual"), F.col("x.path").alias("predicted"), F.lit(model).alias("model_name"), F.lit(kind).alias("feature_set"), F.lit(parameter_set_id).alias("parameter_set_id"), "fold", "forecast_origin", F.col("x.steps.horizon_step").alias("horizon_step"), "origin_block", F.lit(False).alias("used_actual_future_for_features"))


def recursive_path(step: Callable[[Column], Column]) -> Column:
    """Predictions of a block: ``step(history) -> next value``, each appended to the history."""
    n = F.size("steps")
    return F.slice(F.aggregate(F.sequence(F.lit(1), n), F.col("history"), lambda h, _: F.concat(h, F.array(step(h)))), -n, n)


def naive_path(period: int = 1) -> Column:
    """The value ``period`` rows back; beyond the origin that is a prediction."""
    return recursive_path(lambda h: F.element_at(h, -period))


def ar_path(intercept: float, lags: dict[int, float]) -> Column:
    """A fixed autoregression."""

    def step(h: Column) -> Column:
        out = F.lit(float(intercept))
        for k, c in lags.items():
            out = out + F.lit(float(c)) * F.element_at(h, -k)
        return out

    return recursive_path(step)


def closed_form(history: DataFrame, validation: DataFrame, model: str, path: Column, horizon: int = 24, series: list[str] = (), target: str = TARGET, parameter_set_id: str = "", kind: str = "none") -> DataFrame:
    blocks = block_rows(history, validation, horizon, series, target).withColumn("path", path)
    return _long(blocks, list(series), model, kind, parameter_set_id)


#: The closed-form models and their periods.
CLOSED_FORM = {"naive_1": 1, "seasonal_24": 24, "seasonal_168": 168}


def closed_form_predictions(history: DataFrame, validation: DataFrame, models: dict[str, int] = CLOSED_FORM, horizon: int = 24, series: list[str] = (), target: str = TARGET) -> DataFrame:
    """The long form of all closed-form models; blocks are made once and carry one array of models."""
    keys = list(series)
    blocks = block_rows(history, validation, horizon, keys, target)
    paths = F.array(*(F.struct(F.lit(m).alias("model"), naive_path(k).alias("path")) for m, k in models.items()))
    every = blocks.withColumn("m", F.explode(paths)).withColumn("path", F.col("m.path")).withColumn("model", F.col("m.model"))
    rows = every.select(*keys, "fold", "origin_block", "forecast_origin", "model", F.explode(F.arrays_zip("steps", "path")).alias("x"))
    return rows.select(*keys, F.col(f"x.steps.{TIMESTAMP}").alias(TIMESTAMP), F.col("x.steps.actual").alias("actual"), F.col("x.path").alias("predicted"), F.col("model").alias("model_name"), F.lit("none").alias("feature_set"), F.lit("").alias("parameter_set_id"), "fold", "forecast_origin", F.col("x.steps.horizon_step").alias("horizon_step"), "origin_block", F.lit(False).alias("used_actual_future_for_features"))


def next_features(history: np.ndarray, at: pd.Timestamp, kind: str, tz: str = LOCAL_TZ) -> np.ndarray:
    """The feature row of one step: lags and windows end at the last known or predicted value."""
    s = feature_set(kind)
    local = at.tz_localize("UTC").tz_convert(tz) if at.tzinfo is None else at.tz_convert(tz)
    made = {"hour": local.hour, "day_of_week": local.dayofweek, "is_weekend": int(local.dayofweek >= 5), "month": local.month}
    out = [history[-k] for k in LAGS[s]] + [history[-w:].mean() for w in MEAN_WINDOWS[s]] + [history[-w:].std(ddof=1) for w in STD_WINDOWS[s]] + [made[c] for c in CALENDAR[s]]
    row = np.array(out, float)
    if len(row) != len(feature_columns(s)) or not np.isfinite(row).all():
        raise ValueError("a feature is missing or not finite")
    return row


def recursive_forecast(predict: Callable[..., float], history: np.ndarray, times: list[pd.Timestamp], kind: str, tz: str = LOCAL_TZ, timed: bool = False) -> list[float]:
    """Predicts step by step; each prediction joins the history of the next step.

    ``timed`` models get the step's time beside its features: ``predict(features, time)``.
    """
    known, out = np.asarray(history, float)[-required_history() :], []
    if len(known) < required_history() or not np.isfinite(known).all():
        raise ValueError(f"the history needs {required_history()} finite values")
    for at in times:
        row = next_features(known, at, kind, tz)
        value = float(predict(row, at) if timed else predict(row))
        if not np.isfinite(value):
            raise ValueError("a prediction is not finite")
        out.append(value)
        known = np.append(known[1:], value)
    return out


def fitted_predictions(history: DataFrame, validation: DataFrame, predictors: DataFrame, load: Callable[[bytes], Callable[[np.ndarray], float]], kind: str, model: str, horizon: int = 24, series: list[str] = (), tz: str = LOCAL_TZ, target: str = TARGET, update_with_actuals: bool = True, timed: bool = False) -> DataFrame:
    """Recursive forecasts of fitted models.

    ``predictors``: rows ``(series..., fold, parameter_set_id, body binary)``; ``load(body)`` gives
    the predict function.  Each (series, fold, parameter set, block) is one group; with
    ``update_with_actuals=False`` later blocks need earlier predictions, so a fold is one group.
    """
    keys = list(series)
    blocks = block_rows(history, validation, horizon, keys, target).join(predictors, [*keys, "fold"])
    by = [*keys, "fold", "parameter_set_id", *(["origin_block"] if update_with_actuals else [])]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, known = [], None
        for _, b in pdf.sort_values("origin_block").iterrows():
            times = [s[TIMESTAMP] for s in b["steps"]]
            past = np.asarray(b["history"], float) if known is None or update_with_actuals else known
            path = recursive_forecast(load(b["body"]), past, times, kind, tz, timed)
            known = np.concatenate((past, path))
            rows += [(*(b[k] for k in keys), t, s["actual"], p, model, kind, b["parameter_set_id"], b["fold"], b["forecast_origin"], s["horizon_step"], b["origin_block"], False) for t, s, p in zip(times, b["steps"], path)]
        return pd.DataFrame(rows, columns=[*keys, *PREDICTION_COLUMNS])

    kinds = ", ".join(f"`{k}` {history.schema[k].dataType.simpleString()}" for k in keys)
    schema = (kinds + ", " if kinds else "") + f"timestamp {history.schema[TIMESTAMP].dataType.simpleString()}, actual double, predicted double, model_name string, feature_set string, parameter_set_id string, fold int, forecast_origin timestamp, horizon_step int, origin_block int, used_actual_future_for_features boolean"
    return blocks.groupBy(*by).applyInPandas(run, schema)


def holdout_rows(df: DataFrame, test_days: int, series: list[str] = ()) -> DataFrame:
    """The final test as validation rows of fold 0."""
    from .splits import with_split

    keys = list(series)
    rows = with_position(with_split(df, test_days, keys), keys).filter("split = 'final_test'")
    return rows.withColumn("val_start", F.min("pos").over(Window.partitionBy(*(keys or [F.lit(0)])))).withColumn("fold", F.lit(0))


def prediction_audit(predictions: DataFrame, by: list[str], horizon: int = 24) -> DataFrame:
    """Per group: rows, distinct timestamps, non-finite predictions, steps in range, leakage flags."""
    p = F.col("predicted")
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(TIMESTAMP).alias("n_timestamps"), F.count_if(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))).alias("n_not_finite"),
        F.bool_and(F.col("horizon_step").between(1, horizon)).alias("steps_in_range"), F.bool_or("used_actual_future_for_features").alias("used_actual_future"),
    )
