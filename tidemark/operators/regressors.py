"""The additive model with lag and calendar regressors: folds, grids and recursive forecasts.

Lags of a future step rest on earlier predictions, so forecasts run step by step, as with trees;
blocks whose actuals are handed over run in parallel.  All parameter sets of one (series, fold) are
fitted in the group that holds its rows, so the matrix is shuffled once and never copied by set.
"""

from __future__ import annotations

import json
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LOCAL_TZ, TARGET, TIMESTAMP, feature_columns
from .features import feature_matrix
from .forecast import fitted_predictions, next_features, recursive_forecast
from .gram import fit_sets, fold_grams
from .models import AdditiveModel
from .splits import with_position, with_split


def future_row(history: np.ndarray, at: pd.Timestamp, kind: str = "basic", tz: str = LOCAL_TZ) -> dict:
    """One future step: ``ds`` without zone, in UTC, and a float for each regressor."""
    naive = at.tz_convert("UTC").tz_localize(None) if at.tzinfo else at
    return {"ds": naive} | dict(zip(feature_columns(kind), map(float, next_features(history, at, kind, tz))))


def load_regressor(body: bytes):
    """``predict(features, time)`` of a stored model."""
    model = AdditiveModel.from_json(body)

    def predict(row: np.ndarray, at: pd.Timestamp) -> float:
        naive = at.tz_convert("UTC").tz_localize(None) if at.tzinfo else at
        return model.predict(np.array([naive.to_datetime64()]), row.reshape(1, -1))[0]

    return predict


def recursive_regressor_forecast(model: AdditiveModel, history: np.ndarray, times: list[pd.Timestamp], kind: str = "basic", tz: str = LOCAL_TZ) -> list[float]:
    """Predicts step by step; each prediction feeds the regressors of the next step."""
    return recursive_forecast(load_regressor(model.to_json().encode()), history, times, kind, tz, timed=True)


def fit_regressors(cv: DataFrame, matrix: DataFrame, grid: list[tuple[str, dict]], kind: str = "basic", series: list[str] = (), target: str = TARGET) -> DataFrame:
    """``(series..., fold, parameter_set_id, body, train_time_seconds, n_train_rows)``: a fitted model for each set and fold."""
    keys, columns, sets = list(series), feature_columns(kind), list(grid)
    folds = cv.filter("role = 'train'").select(*keys, "fold", TIMESTAMP)
    rows = matrix.join(folds, [*keys, TIMESTAMP]).select(*keys, "fold", TIMESTAMP, target, *columns)
    kinds = "".join(f"`{k}` {matrix.schema[k].dataType.simpleString()}, " for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIMESTAMP)
        ds, y, x = pdf[TIMESTAMP].to_numpy(), pdf[target].to_numpy(float), pdf[columns].to_numpy(float)
        out = []
        for name, params in sets:
            began = time.perf_counter()
            body = AdditiveModel(params, tuple(columns)).fit(ds, y, x).to_json().encode()
            out.append((*(pdf[k].iloc[0] for k in [*keys, "fold"]), name, body, time.perf_counter() - began, len(pdf)))
        return pd.DataFrame(out, columns=[*keys, "fold", "parameter_set_id", "body", "train_time_seconds", "n_train_rows"])

    return rows.groupBy(*keys, "fold").applyInPandas(run, f"{kinds}fold int, parameter_set_id string, body binary, train_time_seconds double, n_train_rows bigint")


def regressor_predictions(history: DataFrame, validation: DataFrame, models: DataFrame, kind: str = "basic", model: str = "prophet_regressor", horizon: int = 24, series: list[str] = (), tz: str = LOCAL_TZ, target: str = TARGET, update_with_actuals: bool = True) -> DataFrame:
    """Rolling-origin forecasts of fitted models in the long form."""
    return fitted_predictions(history, validation, models, load_regressor, kind, model, horizon, series, tz, target, update_with_actuals, timed=True)


def regressor_cv(source: DataFrame, cv: DataFrame, grid: list[tuple[str, dict]], kind: str = "basic", horizon: int = 24, series: list[str] = (), tz: str = LOCAL_TZ, target: str = TARGET) -> DataFrame:
    """Long-form predictions of every (set, fold); all fits come from one pass over the matrix."""
    columns = tuple(feature_columns(kind))
    fitted = fit_sets(fold_grams(cv, feature_matrix(source, kind, series, tz, target), columns, series, target), grid, columns, series)
    return regressor_predictions(source, cv.filter("role = 'validation'"), fitted.drop("n_train_rows"), kind, horizon=horizon, series=series, tz=tz, target=target)


def final_rows(df: DataFrame, test_days: int, series: list[str] = ()) -> DataFrame:
    """All rows as one fold, 0: the final test validates and all before it trains."""
    keys = list(series)
    rows = with_position(with_split(df, test_days, keys), keys)
    rows = rows.withColumn("role", F.when(F.col("split") == "final_test", "validation").otherwise("train")).withColumn("fold", F.lit(0))
    starts = rows.filter("role = 'validation'").groupBy(*keys).agg(F.min("pos").alias("val_start"))
    return rows.join(starts, keys) if keys else rows.join(F.broadcast(starts))  # a row per series, one without


def regressor_final(source: DataFrame, test_days: int, params: dict, kind: str = "basic", parameter_set_id: str = "best", horizon: int = 24, series: list[str] = (), tz: str = LOCAL_TZ, target: str = TARGET) -> DataFrame:
    """One fit on all rows before the final test, one forecast of it by blocks."""
    return regressor_cv(source, final_rows(source, test_days, series), [(parameter_set_id, params)], kind, horizon, series, tz, target)


def retrain_additive(train: DataFrame, params: dict, regressors: str | None = None, tz: str = LOCAL_TZ, target: str = TARGET, series: list[str] = ()) -> DataFrame:
    """``(series..., body, train_time_seconds, n_train_rows)``: the model of each whole series, with the regressors of a feature set or none."""
    keys = list(series)
    matrix = feature_matrix(train, regressors, series, tz, target) if regressors else train
    columns = feature_columns(regressors) if regressors else []
    kinds = "".join(f"`{k}` {train.schema[k].dataType.simpleString()}, " for k in keys)
    body = json.dumps(params)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        pdf = pdf.sort_values(TIMESTAMP)
        model = AdditiveModel(json.loads(body), tuple(columns)).fit(pdf[TIMESTAMP].to_numpy(), pdf[target].to_numpy(float), pdf[columns].to_numpy(float) if columns else None)
        return pdf[keys].iloc[:1].assign(body=model.to_json().encode(), train_time_seconds=time.perf_counter() - began, n_train_rows=len(pdf))

    rows = matrix.select(*keys, TIMESTAMP, target, *columns)
    return rows.groupBy(*(keys or [F.lit(0).alias("one")])).applyInPandas(run, f"{kinds}body binary, train_time_seconds double, n_train_rows bigint")
