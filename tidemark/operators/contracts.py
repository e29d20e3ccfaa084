"""Contracts: each is a one-row DataFrame of counts and flags; ``require`` raises on the driver."""

from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TARGET, TIMESTAMP, feature_columns, required_history
from .timeaxis import over_time


def require_columns(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def require(contract: DataFrame) -> None:
    """Columns named ``bad_...`` must be 0, those named ``ok_...`` true; all failures come in one error."""
    row = contract.first().asDict()
    failed = {k: v for k, v in row.items() if (k.startswith("bad_") and v) or (k.startswith("ok_") and not v)}
    if failed:
        raise ValueError(f"contract failed: {failed}")


def target_domain(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Missing, non-numeric, non-finite, negative and fractional targets."""
    raw = F.col(target)
    y = raw.try_cast("double")
    finite = y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))
    return df.agg(F.count_if(raw.isNull()).alias("bad_missing"), F.count_if(raw.isNotNull() & y.isNull()).alias("bad_non_numeric"), F.count_if(y.isNotNull() & ~finite).alias("bad_non_finite"), F.count_if(finite & (y < 0)).alias("bad_negative"), F.count_if(finite & (y != F.floor(y))).alias("bad_fractional"))


def loaded_profile(df: DataFrame, target: str = TARGET) -> DataFrame:
    y = F.col(target).try_cast("double")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.count_if(F.col(target).isNull()).alias("missing"), F.count_if(F.col(target).isNotNull() & y.isNull()).alias("non_numeric"), F.count_if(y < 0).alias("negative"), F.min(y).alias("target_min"), F.max(y).alias("target_max"))


def series_contract(df: DataFrame, target: str | None = TARGET, series: list[str] = ()) -> DataFrame:
    """Not empty, no null time or target, unique times."""
    keys = list(series)
    step = F.unix_micros(F.col(TIMESTAMP).cast("timestamp")) - F.unix_micros(F.lag(TIMESTAMP).over(over_time(keys)).cast("timestamp"))
    rows = df.withColumn("step_", step)
    extra = [F.count_if(F.col(target).isNull()).alias("bad_null_target")] if target else []
    return rows.agg((F.count(F.lit(1)) > 0).alias("ok_not_empty"), F.count_if(F.col(TIMESTAMP).isNull()).alias("bad_null_timestamp"), F.count_if(F.col("step_") <= 0).alias("bad_repeated_timestamp"), *extra)


def matrix_contract(df: DataFrame, kind: str, target: str = TARGET) -> DataFrame:
    """No null or non-finite feature or target, unique times."""
    cols = [target, *feature_columns(kind)]
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(f"bad_{c}") for c in cols]
    return df.agg((F.count(F.lit(1)) > 0).alias("ok_not_empty"), (F.count(F.lit(1)) - F.count_distinct(TIMESTAMP)).alias("bad_repeated_timestamp"), *bad)


def history_contract(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Enough finite rows for the longest look-back, whichever feature set is used."""
    y = F.col(target).cast("double")
    return df.agg((F.count(F.lit(1)) >= required_history()).alias("ok_long_enough"), F.count_if(y.isNull() | F.isnan(y)).alias("bad_target"), (F.count(F.lit(1)) - F.count_distinct(TIMESTAMP)).alias("bad_repeated_timestamp"))


def prediction_contract(predictions: DataFrame, expected: DataFrame, horizon: int = 24) -> DataFrame:
    """One model's rows: finite, one per expected time, steps in range, no future used."""
    p = F.col("predicted")
    own = predictions.agg(F.count_if(p.isNull() | F.isnan(p)).alias("bad_not_finite"), F.count_if(~F.col("horizon_step").between(1, horizon)).alias("bad_steps"), F.count_if(F.col("used_actual_future_for_features")).alias("bad_leakage"), (F.count(F.lit(1)) - F.count_distinct(TIMESTAMP)).alias("bad_repeated_timestamp"))
    both = expected.select(TIMESTAMP, F.lit(True).alias("e")).join(predictions.select(TIMESTAMP, F.lit(True).alias("p")), TIMESTAMP, "full").agg(F.count_if(F.col("p").isNull()).alias("bad_missing_time"), F.count_if(F.col("e").isNull()).alias("bad_unexpected_time"))
    return own.join(both)


def models_aligned(predictions: DataFrame, n_models: int, model: str = "model_label", rows_per_model: int | None = None) -> DataFrame:
    """All models predict the same times of the same actuals."""
    by = predictions.groupBy(TIMESTAMP).agg(F.count_distinct(model).alias("m"), F.count(F.lit(1)).alias("n"), (F.max("actual") - F.min("actual")).alias("spread"))
    out = by.agg(F.count_if((F.col("m") != n_models) | (F.col("n") != n_models)).alias("bad_models_at_time"), F.count_if(F.abs("spread") > 1e-9).alias("bad_actuals"), F.count(F.lit(1)).alias("n_timestamps"))
    return out.withColumn("ok_rows_per_model", F.lit(True) if rows_per_model is None else F.col("n_timestamps") == rows_per_model)


def same_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Set equality of a column of two tables."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return x.exceptAll(y).agg(F.count(F.lit(1)).alias("bad_only_in_first")).join(y.exceptAll(x).agg(F.count(F.lit(1)).alias("bad_only_in_second")))


def final_scope(train: DataFrame, test: DataFrame, least_rows: int = 24) -> DataFrame:
    """Train ends before the test begins; the test is long enough and its times unique."""
    a = train.agg(F.max(TIMESTAMP).alias("train_end"))
    b = test.agg(F.min(TIMESTAMP).alias("test_start"), F.count(F.lit(1)).alias("n"), F.count_distinct(TIMESTAMP).alias("d"))
    return a.join(b).select((F.col("train_end") < F.col("test_start")).alias("ok_ordered"), (F.col("n") >= least_rows).alias("ok_long_enough"), (F.col("n") - F.col("d")).alias("bad_repeated_timestamp"))


def matrix_inside(matrix: DataFrame, train: DataFrame) -> DataFrame:
    """A matrix holds only training times and ends where training ends."""
    outside = matrix.join(train.select(TIMESTAMP), TIMESTAMP, "left_anti").agg(F.count(F.lit(1)).alias("bad_outside"))
    ends = matrix.agg(F.max(TIMESTAMP).alias("m")).join(train.agg(F.max(TIMESTAMP).alias("t"))).select((F.col("m") == F.col("t")).alias("ok_same_end"))
    return outside.join(ends)


def joined_folds(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two models' cross-validation rows: same (fold, time) keys, same actuals."""
    met = a.select("fold", TIMESTAMP, F.col("actual").alias("x")).join(b.select("fold", TIMESTAMP, F.col("actual").alias("y")), ["fold", TIMESTAMP], "full")
    return met.agg(F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("bad_unmatched"), F.count_if(F.abs(F.col("x") - F.col("y")) > 1e-8 + 1e-5 * F.abs("y")).alias("bad_actuals"))


def feature_names(names: list[str], kind: str, target: str = TARGET) -> None:
    if list(names) != feature_columns(kind):
        raise ValueError("features differ from the catalogue in name or order")
    if target in names:
        raise ValueError("the target is among the features")


def ordered_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two series hold the same times in the same places."""
    w = Window.partitionBy(F.lit(0)).orderBy(TIMESTAMP)
    x, y = (d.select(TIMESTAMP, F.row_number().over(w).alias("pos")) for d in (a, b))
    return x.withColumn("x", F.lit(1)).join(y.withColumn("y", F.lit(1)), [TIMESTAMP, "pos"], "full").agg(F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("bad_places"))


def require_utc(df: DataFrame, column: str = TIMESTAMP, allow_naive: bool = False) -> DataFrame:
    """A table whose time column holds instants; times without a zone are an error or, if allowed, taken as UTC."""
    require_columns(df, [column])
    kind = df.schema[column].dataType.typeName()
    if kind == "timestamp":
        return df
    if kind != "timestamp_ntz" or not allow_naive:
        raise TypeError(f"{column} must be a time with zone, not {kind}")
    return df.withColumn(column, F.to_utc_timestamp(F.col(column).cast("string"), "UTC"))


def future_index(spark, values, column: str = TIMESTAMP, allow_naive: bool = False) -> DataFrame:
    """The times of a forecast, from a table or a list: not empty, unique, with zone; in order."""
    if not isinstance(values, DataFrame):
        times = [v if isinstance(v, datetime) else datetime.fromisoformat(str(v)) for v in values]
        if not allow_naive and any(t.tzinfo is None for t in times):
            raise TypeError("times must have a zone")
        times = [t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t for t in times]
        values = spark.createDataFrame([(t,) for t in times], f"`{column}` timestamp")
    out = require_utc(values, column, allow_naive).select(column)
    require(out.agg((F.count(F.lit(1)) > 0).alias("ok_not_empty"), F.count_if(F.col(column).isNull()).alias("bad_null"), (F.count(column) - F.count_distinct(column)).alias("bad_repeated")))
    return out.orderBy(column)


def validation_frame(spark, values, target: str = TARGET, allow_naive: bool = False) -> DataFrame:
    """A validation stretch from a table or from (time, value) pairs; a table without the target has null actuals."""
    if not isinstance(values, DataFrame):
        values = list(values)
        pairs = [v if isinstance(v, (tuple, list)) else (v, None) for v in values]
        times = future_index(spark, [t for t, _ in pairs], TIMESTAMP, allow_naive)
        order = sorted(((t if isinstance(t, datetime) else datetime.fromisoformat(str(t))), y) for t, y in pairs) if pairs else []
        rows = [(t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t, None if y is None else float(y)) for t, y in order]
        return times.join(spark.createDataFrame(rows, f"`{TIMESTAMP}` timestamp, `{target}` double"), TIMESTAMP)
    out = require_utc(values, TIMESTAMP, allow_naive)
    return out if target in out.columns else out.withColumn(target, F.lit(None).cast("double"))


def time_frame_contract(df: DataFrame, target: str | None = TARGET) -> DataFrame:
    """A frame for the additive model: zoned unique times, a finite target where one is asked for."""
    require_utc(df)
    extra = []
    if target:
        require_columns(df, [target])
        y = F.col(target).try_cast("double")
        extra = [F.count_if(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))).alias("bad_target")]
    return df.agg((F.count(F.lit(1)) > 0).alias("ok_not_empty"), F.count_if(F.col(TIMESTAMP).isNull()).alias("bad_null_timestamp"), (F.count(TIMESTAMP) - F.count_distinct(TIMESTAMP)).alias("bad_repeated_timestamp"), *extra)


def regressor_frame_contract(frame: DataFrame, source: DataFrame, kind: str = "basic", target: str = TARGET) -> DataFrame:
    """A training frame with regressors: finite, unique, inside its source and shorter than it by the look-back alone."""
    require_columns(frame, [TIMESTAMP, target, *feature_columns(kind)])
    n = source.agg(F.count(F.lit(1)).alias("n"))
    m = frame.agg(F.count(F.lit(1)).alias("m"))
    fewer = n.join(m).select((F.col("m") < F.col("n")).alias("ok_fewer_than_source"))
    return matrix_contract(frame, kind, target).join(matrix_inside(frame, source)).join(fewer)


def artefact_paths(registry: dict[str, dict], expected: dict[str, str]) -> None:
    """Every registered model lies where it is expected, and is there."""
    wrong = {k: registry.get(k, {}).get("model_path") for k, p in expected.items() if str(registry.get(k, {}).get("model_path")) != str(p)}
    if wrong:
        raise ValueError(f"models elsewhere than expected: {wrong}")
    if gone := [p for p in expected.values() if not Path(p).exists()]:
        raise FileNotFoundError(f"no such model: {gone}")
