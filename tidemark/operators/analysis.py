"""Error analysis of predictions in long form: enrichment, groupings, segments, extremes, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..config import LOCAL_TZ, MODEL_ORDER, TIMESTAMP
from ..functions.metrics import corrected_kurtosis, corrected_skewness, error_bundle, mae, percent_reduction, quantiles, rmse
from . import ordered
from .timeaxis import calendar, day_name

MODEL = "model_label"


def with_errors(predictions: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """Adds residual, absolute and squared error and the local calendar, where absent."""
    at = F.from_utc_timestamp(TIMESTAMP, tz)
    c = calendar(at)
    r = F.col("actual") - F.col("predicted")
    made = {"residual": r, "absolute_error": F.abs(r), "squared_error": r * r, "local_hour": c["hour"].cast("int"), "local_day_of_week": c["day_of_week"].cast("int"), "local_is_weekend": c["is_weekend"].cast("int"), "local_month": c["month"].cast("int"), "local_day_name": day_name(at)}
    return predictions.withColumns({k: v for k, v in made.items() if k not in predictions.columns})


def demand_quantiles(predictions: DataFrame, shares: dict[str, float], keys: list[str] = (TIMESTAMP,)) -> DataFrame:
    """One row of quantiles of the actuals, each key counted once: it is the same for all models."""
    once = predictions.groupBy(*keys).agg(F.first("actual").alias("actual"))
    return once.agg(*quantiles("actual", shares))


def time_of_day(hour: Column) -> Column:
    """Right-closed bins of the local hour."""
    out = F
    for last, name in ((5, "night_00_05"), (9, "morning_06_09"), (15, "midday_10_15"), (19, "evening_16_19"), (23, "late_20_23")):
        out = out.when(hour <= last, F.lit(name))
    return out


def enrich(predictions: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """Percentage errors, direction, period, time of day, rush and night flags, demand bands."""
    p = with_errors(predictions, tz).join(F.broadcast(demand_quantiles(predictions, {"p90_": 0.9, "p10_": 0.1})))  # one row
    a, f, e = F.col("actual"), F.col("predicted"), F.col("absolute_error")
    size = F.abs(a) + F.abs(f)
    high, low = a >= F.col("p90_"), a <= F.col("p10_")
    return p.withColumns(
        {
            "absolute_percentage_error": F.when(a != 0, F.try_divide(e, F.abs(a)) * 100), "symmetric_absolute_percentage_error": F.when(size != 0, F.try_divide(2 * e, size) * 100).otherwise(0.0),
            "error_direction": F.when(f > a, "overprediction").when(f < a, "underprediction").otherwise("exact"), "period_type": F.when(F.col("local_is_weekend") == 1, "weekend").otherwise("weekday"),
            "time_of_day_segment": time_of_day(F.col("local_hour")), "is_rush_hour": F.col("local_hour").isin(7, 8, 9, 16, 17, 18, 19), "is_night": F.col("local_hour").between(0, 5),
            "is_high_demand_p90": high, "is_low_demand_p10": low, "actual_demand_band": F.when(high, "high_demand_p90").when(low, "low_demand_p10").otherwise("middle_demand"),
        }
    ).drop("p90_", "p10_")


def errors_by(predictions: DataFrame, *columns: str) -> DataFrame:
    """Rows and the nine measures by model and any columns."""
    return predictions.groupBy(MODEL, *columns).agg(F.count(F.lit(1)).alias("n_predictions"), *error_bundle())


def short_errors_by(predictions: DataFrame, *columns: str) -> DataFrame:
    """Rows, MAE, RMSE and mean error by model and any columns, null keys left out."""
    a, p = F.col("actual"), F.col("predicted")
    return predictions.na.drop(subset=[*columns] or None).groupBy(MODEL, *columns).agg(F.count(F.lit(1)).alias("n_predictions"), mae(a, p).alias("mae"), rmse(a, p).alias("rmse"), F.avg(a - p).alias("mean_error"))


def errors_by_block(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(MODEL, "origin_block").agg(F.count(F.lit(1)).alias("n_predictions"), F.min(TIMESTAMP).alias("block_start"), F.max(TIMESTAMP).alias("block_end"), *error_bundle())


def residual_summary(predictions: DataFrame) -> DataFrame:
    a, p, r = F.col("actual"), F.col("predicted"), F.col("residual")
    return predictions.groupBy(MODEL).agg(
        F.count(F.lit(1)).alias("n_predictions"), F.avg(r).alias("mean_error"), F.median(r).alias("median_error"), F.stddev_samp(r).alias("std_error"), mae(a, p).alias("mae"), rmse(a, p).alias("rmse"),
        F.avg((p > a).cast("double")).alias("overprediction_rate"), F.avg((p < a).cast("double")).alias("underprediction_rate"), F.max(F.abs(r)).alias("max_absolute_error"), F.count_if(p < 0).alias("negative_prediction_count"),
    )


def residual_distribution(predictions: DataFrame) -> DataFrame:
    r = F.col("residual")
    return predictions.groupBy(MODEL).agg(
        F.count(F.lit(1)).alias("n_predictions"), F.avg(r).alias("mean"), F.median(r).alias("median"), F.stddev_samp(r).alias("std"), corrected_skewness("residual").alias("skewness"), corrected_kurtosis("residual").alias("excess_kurtosis"),
        *quantiles("residual", {"residual_p05": 0.05, "residual_p25": 0.25, "residual_p75": 0.75, "residual_p95": 0.95}), *quantiles("absolute_error", {"abs_error_p50": 0.5, "abs_error_p90": 0.9, "abs_error_p95": 0.95, "abs_error_p99": 0.99}),
    )


def residual_autocorrelation(predictions: DataFrame, max_lag: int) -> DataFrame:
    """Correlation of each model's residuals with themselves ``lag`` rows before, over the overlap, from sums by stretch."""
    g = ordered.lagged_sums(predictions, [MODEL], "residual", max_lag).filter("lag > 0")
    n = F.col("n")
    xx, yy, xy = (F.col(c) - F.col(a) * F.col(b) / n for c, a, b in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    return g.select(MODEL, "lag", F.try_divide(xy, F.sqrt(F.greatest(xx, F.lit(0.0)) * F.greatest(yy, F.lit(0.0)))).alias("autocorrelation"))


def segment_conditions(thresholds: bool = True, low: bool = True) -> dict[str, Column]:
    """Overlapping segments of enriched rows by name."""
    out = {
        "all": F.lit(True), "rush_hour_local_07_09_16_19": F.col("local_hour").isin(7, 8, 9, 16, 17, 18, 19), "night_local_00_05": F.col("local_hour").between(0, 5),
        "weekday_local": F.col("local_is_weekend") == 0, "weekend_local": F.col("local_is_weekend") == 1,
    }
    if thresholds:
        out["high_demand_spike_p90"] = F.col("actual") >= F.col("p90_")
        if low:
            out["low_demand_p10"] = F.col("actual") <= F.col("p10_")
    return out


def segment_errors(predictions: DataFrame, keys: list[str] = (TIMESTAMP,), low: bool = True) -> DataFrame:
    """The nine measures by model and segment; a row counts in every segment it lies in, empty segments are absent."""
    q = demand_quantiles(predictions, {"p90_": 0.9, "p10_": 0.1}, list(keys))
    rows = predictions.join(F.broadcast(q))  # one row
    names = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in segment_conditions(low=low).items())))
    out = rows.withColumn("segment", F.explode(names)).groupBy(MODEL, "segment").agg(F.count(F.lit(1)).alias("n_predictions"), F.max("p90_").alias("hi"), F.max("p10_").alias("lo"), *error_bundle())
    out = out.withColumn("spike_threshold_p90_actual", F.when(F.col("segment") == "high_demand_spike_p90", F.col("hi"))).withColumn("low_threshold_p10_actual", F.when(F.col("segment") == "low_demand_p10", F.col("lo")))
    return out.drop("hi", "lo")


def segment_pivot(segments: DataFrame, models: list[str], pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """MAE by segment and model, with percent reductions of (baseline, challenger) pairs."""
    wide = segments.groupBy("segment").pivot(MODEL, models).agg(F.first("mae"))
    return wide.withColumns({f"{c}_vs_{b}_reduction_pct": percent_reduction(F.col(f"`{b}`"), F.col(f"`{c}`")) for b, c in pairs})


def extreme_events(predictions: DataFrame) -> DataFrame:
    """Measures of demand tails by model; a model without such rows has a row of nulls."""
    q = demand_quantiles(predictions, {"p10": 0.1, "p90": 0.9, "p95": 0.95})
    events = q.select(F.explode(F.array(*(F.struct(F.lit(n).alias("event"), F.lit(op).alias("threshold_operator"), F.col(c).alias("actual_threshold")) for n, op, c in (("low_demand_p10", "<=", "p10"), ("high_demand_p90", ">=", "p90"), ("high_demand_p95", ">=", "p95"))))).alias("e")).select("e.*")
    spine = predictions.select(MODEL).distinct().join(F.broadcast(events))  # three events
    hit = predictions.join(F.broadcast(events), F.when(F.col("threshold_operator") == "<=", F.col("actual") <= F.col("actual_threshold")).otherwise(F.col("actual") >= F.col("actual_threshold")))
    got = hit.groupBy(MODEL, "event").agg(F.count(F.lit(1)).alias("n_predictions"), *error_bundle())
    return spine.join(got, [MODEL, "event"], "left").withColumn("n_predictions", F.coalesce("n_predictions", F.lit(0)))


def demand_tail(predictions: DataFrame, tail: str) -> DataFrame:
    """Rows of the upper or lower tenth of demand with the tail's name and threshold."""
    q = demand_quantiles(predictions, {"actual_threshold": 0.9 if tail == "high" else 0.1})
    rows = predictions.join(F.broadcast(q)).withColumn("demand_tail", F.lit(f"{tail}_demand_p{90 if tail == 'high' else 10}"))
    return rows.filter(F.col("actual") >= F.col("actual_threshold") if tail == "high" else F.col("actual") <= F.col("actual_threshold"))


def the_row(df: DataFrame, **values) -> Row:
    """The first row with these values; none is an error.  For small tables, such as metrics by model."""
    hit = df
    for k, v in values.items():
        hit = hit.filter(F.col(k) == F.lit(v))
    if (row := hit.first()) is None:
        raise LookupError(f"no row with {values}")
    return row


def top_errors(predictions: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest absolute errors of each model, ranked."""
    w = Window.partitionBy(MODEL).orderBy(F.desc("absolute_error"), TIMESTAMP)
    return predictions.withColumn("error_rank", F.row_number().over(w)).filter(F.col("error_rank") <= n)


def signed_extremes(predictions: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest under- and overpredictions of each model; exact predictions are neither."""
    kind = F.when(F.col("residual") > 0, "underprediction").when(F.col("residual") < 0, "overprediction")
    w = Window.partitionBy(MODEL, "error_type").orderBy(F.desc("absolute_error"), TIMESTAMP)
    return predictions.withColumn("error_type", kind).filter(F.col("error_type").isNotNull()).withColumn("error_rank", F.row_number().over(w)).filter(F.col("error_rank") <= n)


def negative_predictions(predictions: DataFrame) -> DataFrame:
    return predictions.filter(F.col("predicted") < 0)


def negative_counts(predictions: DataFrame) -> DataFrame:
    """Every model with its number of negative predictions, 0 included."""
    return predictions.groupBy(MODEL).agg(F.count_if(F.col("predicted") < 0).alias("negative_predictions"))


def safe_name(label: str) -> str:
    return label.replace("-", "_").replace(" ", "_")


def timestamp_consensus(predictions: DataFrame, models: list[str], n: int) -> DataFrame:
    """Timestamps where models err most on average, with each model's error beside."""
    wide = predictions.groupBy(TIMESTAMP).agg(
        F.first("actual").alias("actual"), F.avg("absolute_error").alias("mean_absolute_error"), F.max("absolute_error").alias("max_absolute_error"), F.count_distinct(MODEL).alias("n_models"),
        *(F.max(F.when(F.col(MODEL) == m, F.col(c))).alias(f"{c}_{safe_name(m)}") for m in models for c in ("absolute_error", "residual")),
    )
    return wide.orderBy(F.desc("mean_absolute_error"), TIMESTAMP).limit(n)


def model_order(label: Column, order: list[str] = MODEL_ORDER) -> Column:
    """The place in the catalogue, 999 for others."""
    at = F.array_position(F.array(*map(F.lit, order)), label)
    return F.when(at > 0, at).otherwise(F.lit(999))


def by_model(df: DataFrame, *ties: str, order: list[str] = MODEL_ORDER) -> DataFrame:
    return df.orderBy(model_order(F.col(MODEL), order), *(t for t in ties if t in df.columns))


def first_per_group(df: DataFrame, by: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("nth_", F.row_number().over(w)).filter("nth_ = 1").drop("nth_")


def worst_segment(segments: DataFrame) -> DataFrame:
    return first_per_group(segments.filter("segment <> 'all'"), [MODEL], F.desc("mae"), "segment")


def best_and_worst(errors: DataFrame, key: str) -> DataFrame:
    """Each model's keys of least and largest MAE."""
    low, high = (first_per_group(errors, [MODEL], o, key).select(MODEL, F.lit(n).alias("kind"), key, "mae") for n, o in (("best", F.asc("mae")), ("worst", F.desc("mae"))))
    return low.unionByName(high)


def residual_histogram(predictions: DataFrame, bins: int = 45) -> DataFrame:
    """Counts and density of residuals in equal bins of each model's own range, both ends included."""
    span = predictions.groupBy(MODEL).agg(F.min("residual").alias("lo"), F.max("residual").alias("hi"), F.count(F.lit(1)).alias("n"))
    rows = predictions.select(MODEL, "residual").join(span, MODEL)
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("residual") - F.col("lo"), width)), F.lit(0))).cast("int")
    out = rows.withColumn("bin", at).groupBy(MODEL, "bin").agg(F.count(F.lit(1)).alias("n_residuals"), F.max("lo").alias("lo"), F.max(width).alias("width"), F.max("n").alias("n"))
    return out.select(MODEL, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"), "n_residuals", F.try_divide(F.col("n_residuals").cast("double"), F.col("n") * F.col("width")).alias("density"))


def model_gaps(errors: DataFrame, key: str, baseline: str, challenger: str, n: int = 8) -> DataFrame:
    """Keys by the largest gap in MAE between two models, with the winner (a tie goes to the baseline)."""
    b, c = (errors.filter(F.col(MODEL) == m).select(key, F.col("mae").alias(k)) for m, k in ((baseline, "baseline_mae"), (challenger, "challenger_mae")))
    out = b.join(c, key).withColumn("gap", F.col("baseline_mae") - F.col("challenger_mae")).withColumn("winner", F.when(F.col("challenger_mae") < F.col("baseline_mae"), challenger).otherwise(baseline))
    return out.orderBy(F.desc(F.abs("gap")), key).limit(n)


def tail_summary(tail: DataFrame) -> DataFrame:
    """The nine measures of a demand tail (from ``demand_tail``) by model, in catalogue order."""
    out = tail.groupBy(MODEL, "demand_tail", "actual_threshold").agg(F.count(F.lit(1)).alias("n_predictions"), *error_bundle())
    return by_model(out)


def model_row(metrics: DataFrame, label: str) -> DataFrame:
    """The one row of a model; none or several are an error."""
    found = metrics.filter(F.col(MODEL) == label)
    if (n := found.count()) != 1:
        raise ValueError(f"{n} rows of model {label}")
    return found
