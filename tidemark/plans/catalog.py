"""The catalogue: every query runs whole tables; each that SQL can express has its SQL in ``oracle``.

The study's scaled parameters for the one-month event table: five days of final test, five folds of
72 rows, horizon 24.  Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import METRICS, PROPHET_SPACE, TARGET, TIMESTAMP, TREE_SPACE, feature_columns
from ..functions.metrics import cv_summary, grouped_metrics
from ..operators import analysis, boosting, comparison, features, forecast, gram, models, ordered, shapley, splits, stats, timeaxis
from ..sources.staging import shared_folder, staged
from ..streaming.forecast import fitted_states, state_updating_forecast
from .oracle import ORACLE_SQL  # noqa: F401

TEST_DAYS, FOLDS, VAL, HORIZON, UTC = 5, 5, 72, 24, "UTC"
MODELS = list(forecast.CLOSED_FORM)
PAIRS = [("a", "naive_1", "seasonal_24"), ("b", "seasonal_24", "seasonal_168"), ("c", "naive_1", "seasonal_168")]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    """Registers ``f(spark, sf_dir)``; doubles are rounded."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({n: F.round(F.col(f"`{n}`").cast("double"), 6) + 0.0 for n, t in df.dtypes if t in ("double", "float")})

    QUERIES[f.__name__] = run
    return f


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sparse(spark, d, series=()):
    return timeaxis.hourly_counts(table(spark, d, "events").select("ts", *series), series=list(series))


def series(spark, d, by=()):
    return timeaxis.dense(sparse(spark, d, by), list(by))


def cv(spark, d, by=()):
    return splits.cv_rows(series(spark, d, by), FOLDS, VAL, series=list(by))


def final_predictions(spark, d, by=()):
    s = series(spark, d, by)
    p = forecast.closed_form_predictions(s, forecast.holdout_rows(s, TEST_DAYS, by), horizon=HORIZON, series=by)
    return p.withColumnRenamed("model_name", "model_label")


def errors(spark, d):
    return analysis.with_errors(final_predictions(spark, d))


def cv_predictions(spark, d):
    s = series(spark, d)
    p = forecast.closed_form_predictions(s, splits.cv_rows(s, FOLDS, VAL).filter("role = 'validation'"), horizon=HORIZON)
    return p.withColumnRenamed("model_name", "model_label")


def cv_errors(spark, d):
    """Residuals of all folds: 360 hours in a row by model, enough for lags to 168."""
    return analysis.with_errors(cv_predictions(spark, d))


def cv_metrics(spark, d):
    return grouped_metrics(cv_predictions(spark, d), ["model_label", "fold"])


def final_metrics(spark, d):
    return grouped_metrics(final_predictions(spark, d), ["model_label"], diagnostics=False)


def pair_table(spark):
    return spark.createDataFrame(PAIRS, "comparison string, baseline string, challenger string")


@query
def hourly_counts(spark, d):
    return sparse(spark, d)


@query
def hourly_dense(spark, d):
    return series(spark, d)


@query
def hourly_by_type(spark, d):
    return series(spark, d, ("event_type",))


@query
def duplicate_audit(spark, d):
    return timeaxis.duplicate_audit(table(spark, d, "lineitem").select(F.col("l_shipdate").alias(TIMESTAMP))).drop("examples")


def order_days(spark, d):
    """The days of orders as timestamps: an hourly axis with gaps of its own."""
    return table(spark, d, "orders").select(F.date_trunc("day", "o_orderdate").cast("timestamp").alias(TIMESTAMP)).distinct()


@query
def missing_hours(spark, d):
    return timeaxis.missing_hours(order_days(spark, d))


@query
def missing_audit(spark, d):
    return timeaxis.missing_audit(order_days(spark, d)).drop("examples")


@query
def time_spacing(spark, d):
    return timeaxis.spacing(order_days(spark, d))


def order_hours(spark, d):
    """Every hour of the days with orders, taken for local times of New York."""
    return order_days(spark, d).select(F.explode(F.expr("sequence(timestamp, timestamp + interval 23 hour, interval 1 hour)")).alias(TIMESTAMP))


@query
def dst_localize(spark, d):
    local = order_hours(spark, d).filter(~timeaxis.is_nonexistent(F.col(TIMESTAMP)))
    return timeaxis.localize(local, strict=False).select(TIMESTAMP, F.col("timestamp_local_naive").cast("timestamp").alias("local"), "is_dst_ambiguous_local_hour")


@query
def dst_nonexistent(spark, d):
    return order_hours(spark, d).filter(timeaxis.is_nonexistent(F.col(TIMESTAMP)))


@query
def calendar_features(spark, d):
    return features.add_calendar(series(spark, d), ["hour", "day_of_week", "is_weekend", "month"]).drop(TARGET)


@query
def lag_features_basic(spark, d):
    return features.feature_matrix(series(spark, d), "basic", drop=False)


@query
def feature_matrix_basic(spark, d):
    return features.feature_matrix(series(spark, d), "basic")


@query
def feature_matrix_advanced(spark, d):
    return features.feature_matrix(series(spark, d), "advanced")


@query
def feature_matrix_by_type(spark, d):
    return features.feature_matrix(series(spark, d, ("event_type",)), "advanced", ["event_type"])


@query
def leakage_check(spark, d):
    s = series(spark, d)
    return features.leakage_check(features.feature_matrix(s, "advanced"), s, "advanced").drop("first_mismatch")


@query
def centred_rolling(spark, d):
    return features.centred_rolling(series(spark, d)).drop(TARGET)


@query
def feature_set_table(spark, d):
    """Groups of each feature set, with the rows and the distinct values that the series gives them."""
    counted = []
    for kind in ("basic", "advanced"):
        m = features.feature_matrix(series(spark, d), kind).unpivot([TIMESTAMP], [F.col(c).cast("double").alias(c) for c in feature_columns(kind)], "feature", "value")
        counted.append(m.withColumn("feature_group", features.feature_group(F.col("feature"))).groupBy("feature_group").agg(F.count("value").alias("n_values"), F.avg("value").alias("mean_value")).withColumn("feature_set", F.lit(kind)))
    return features.feature_set_table(spark).join(counted[0].union(counted[1]), ["feature_set", "feature_group"])


@query
def evenly_sampled(spark, d):
    return features.evenly_sampled(series(spark, d), 50).select(TIMESTAMP)


@query
def holdout_split(spark, d):
    return splits.period_summary(splits.with_split(series(spark, d), TEST_DAYS), by=["split"])


@query
def cv_folds(spark, d):
    return splits.fold_metadata(cv(spark, d), HORIZON).select("fold", "train_start", "train_end", "train_start_pos", "train_end_pos_exclusive", "n_train_rows", "validation_start", "validation_end", "validation_start_pos", "validation_end_pos_exclusive", "n_validation_rows", "observed_boundary_delta_hours", "observed_gap_hours", "n_origin_blocks", F.col("last_origin_block_rows").cast("bigint").alias("last_origin_block_rows"))


@query
def cv_audit(spark, d):
    return splits.cv_audit(splits.fold_metadata(cv(spark, d), HORIZON), FOLDS, VAL)


@query
def origin_blocks(spark, d):
    s = series(spark, d)
    return splits.block_table(s, splits.cv_rows(s, FOLDS, VAL), HORIZON)


@query
def rolling_origin_predictions(spark, d):
    return final_predictions(spark, d).select("model_label", TIMESTAMP, "actual", "predicted", "forecast_origin", "horizon_step", "origin_block")


@query
def recursive_ar_forecast(spark, d):
    s = series(spark, d)
    path = forecast.ar_path(0.5, {1: 0.6, 24: 0.3})
    return forecast.closed_form(s, forecast.holdout_rows(s, TEST_DAYS), "ar", path, HORIZON).select(TIMESTAMP, "predicted", "horizon_step", "origin_block")


@query
def metrics_seasonal(spark, d):
    return grouped_metrics(final_predictions(spark, d), ["model_label"])


@query
def metrics_by_type(spark, d):
    return grouped_metrics(final_predictions(spark, d, ("event_type",)), ["event_type", "model_label"], diagnostics=False)


@query
def metrics_by_fold(spark, d):
    return cv_metrics(spark, d)


@query
def cv_metric_summary(spark, d):
    return cv_summary(cv_metrics(spark, d), ["model_label"], METRICS)


@query
def cv_stability(spark, d):
    return comparison.cv_stability(cv_metrics(spark, d), ["mae", "rmse"])


@query
def fold_stability(spark, d):
    return comparison.fold_stability(cv_metrics(spark, d), MODELS, ["mae"])


@query
def fold_win_counts(spark, d):
    return comparison.win_counts(comparison.fold_stability(cv_metrics(spark, d), MODELS, ["mae"]))


@query
def fold_comparison(spark, d):
    return comparison.fold_comparison(cv_metrics(spark, d), "naive_1", "seasonal_24", ["mae"])


@query
def best_model(spark, d):
    return comparison.winner(final_metrics(spark, d))


@query
def metric_ranking(spark, d):
    return comparison.metric_ranking(final_metrics(spark, d))


@query
def rankings_long(spark, d):
    return comparison.rankings_long(final_metrics(spark, d))


@query
def ranking_pivot(spark, d):
    return comparison.ranking_pivot(comparison.rankings_long(final_metrics(spark, d)))


@query
def improvements(spark, d):
    return comparison.improvements(final_metrics(spark, d), pair_table(spark))


@query
def gap_to_best(spark, d):
    return comparison.gap_to_best(final_metrics(spark, d)).select("model_label", "mae", "percent_gap_to_best")


@query
def residual_summary(spark, d):
    return analysis.residual_summary(errors(spark, d))


@query
def residual_distribution(spark, d):
    return analysis.residual_distribution(errors(spark, d))


@query
def residual_autocorrelation(spark, d):
    return analysis.residual_autocorrelation(cv_errors(spark, d), 168)


@query
def residual_histogram(spark, d):
    return analysis.residual_histogram(errors(spark, d), 20)


@query
def errors_by_local_hour(spark, d):
    return analysis.errors_by(errors(spark, d), "local_hour")


@query
def errors_by_local_day(spark, d):
    return analysis.short_errors_by(errors(spark, d), "local_day_of_week")


@query
def errors_by_horizon(spark, d):
    return analysis.short_errors_by(errors(spark, d), "horizon_step")


@query
def errors_by_block(spark, d):
    return analysis.errors_by_block(errors(spark, d))


@query
def enriched_predictions(spark, d):
    e = analysis.enrich(final_predictions(spark, d))
    return e.select("model_label", TIMESTAMP, "absolute_percentage_error", "symmetric_absolute_percentage_error", "error_direction", "period_type", "time_of_day_segment", "is_rush_hour", "is_night", "actual_demand_band", "local_day_name")


@query
def errors_by_period(spark, d):
    return analysis.errors_by(analysis.enrich(final_predictions(spark, d)), "period_type")


@query
def segment_errors(spark, d):
    return analysis.segment_errors(errors(spark, d))


@query
def segment_pivot(spark, d):
    return analysis.segment_pivot(analysis.segment_errors(errors(spark, d)), MODELS, [("naive_1", "seasonal_24")])


@query
def extreme_events(spark, d):
    return analysis.extreme_events(errors(spark, d)).select("model_label", "event", "threshold_operator", "actual_threshold", "n_predictions", "mae", "rmse")


@query
def demand_tail_high(spark, d):
    return analysis.demand_tail(errors(spark, d), "high").select("model_label", TIMESTAMP, "actual", "predicted", "actual_threshold", "demand_tail")


@query
def demand_tail_low(spark, d):
    return analysis.demand_tail(errors(spark, d), "low").select("model_label", TIMESTAMP, "actual", "predicted", "actual_threshold", "demand_tail")


@query
def top_errors(spark, d):
    return analysis.top_errors(errors(spark, d), 10).select("model_label", "error_rank", TIMESTAMP, "absolute_error")


@query
def signed_extremes(spark, d):
    return analysis.signed_extremes(errors(spark, d), 5).select("model_label", "error_type", "error_rank", TIMESTAMP, "residual")


@query
def negative_counts(spark, d):
    return analysis.negative_counts(errors(spark, d).withColumn("predicted", F.col("predicted") - 8))


@query
def timestamp_consensus(spark, d):
    return analysis.timestamp_consensus(errors(spark, d), MODELS, 15)


@query
def model_gaps(spark, d):
    return analysis.model_gaps(analysis.short_errors_by(errors(spark, d), "local_hour"), "local_hour", "naive_1", "seasonal_24")


@query
def dm_by_block(spark, d):
    return stats.dm_by_block(stats.differentials(final_predictions(spark, d), PAIRS)).select("comparison", "loss_type", "n_obs", "mean_loss_difference", "variance_loss_difference", "statistic", "percent_reduction", "lower_loss")


@query
def dm_by_horizon(spark, d):
    return stats.dm_by_horizon(stats.differentials(final_predictions(spark, d), PAIRS)).select("comparison", "loss_type", "horizon_step", "n_obs", "mean_loss_difference", "statistic")


@query
def dm_by_timestamp(spark, d):
    return stats.dm_by_timestamp(stats.differentials(final_predictions(spark, d), PAIRS), 4).select("comparison", "loss_type", "n_obs", "mean_loss_difference", "long_run_variance", "statistic")


@query
def holm_and_bh(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 7 != 0, F.pmod(F.col("s_suppkey") * 37, F.lit(101)) / 101.0).alias("p_value"))
    return stats.adjusted(rows, ["s_nationkey"])


@query
def holm_and_bh_lines(spark, d):
    """One family of a p-value per line item, with ties, zeros and nulls."""
    key = F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(key % 50 != 0, F.pow((key % 9973) / 9973.0, F.lit(4))).alias("p_value"))
    return stats.adjusted(rows, [])


@query
def residual_acf(spark, d):
    return stats.acf(cv_errors(spark, d), "residual", ["model_label"], 168).select("model_label", F.col("lag").cast("bigint").alias("lag"), "acf", "bound", "exceeds")


@query
def ljung_box(spark, d):
    r = stats.acf(cv_errors(spark, d), "residual", ["model_label"], 168)
    return stats.ljung_box(r, ["model_label"]).select("model_label", F.col("lag").cast("bigint").alias("lag"), "statistic", "reject_white_noise_null")


@query
def jarque_bera(spark, d):
    return stats.jarque_bera(errors(spark, d), "residual", ["model_label"]).select("model_label", "statistic", "p_value")


@query
def centre_and_randomness(spark, d):
    return stats.centre_and_randomness(errors(spark, d), "residual", ["model_label"]).select("model_label", "n", "mean_zero_t_statistic", "positive_count", "negative_count", "runs_test_z_statistic")


@query
def parameter_grid(spark, d):
    """The fits of a search: every set of the space on every fold, with the fold's training rows."""
    g = models.parameter_frame(spark, models.parameter_grid(TREE_SPACE, "xgb_basic"))
    folds = cv(spark, d).filter("role = 'train'").groupBy("fold").agg(F.count(F.lit(1)).alias("n_train_rows"), F.sum(TARGET).alias("train_trips"))
    fits = folds.join(F.broadcast(g))  # the grid: its size is set by the caller
    return fits.select("parameter_set_id", "fold", "n_train_rows", "train_trips", F.col("param_n_estimators").cast("int").alias("n_estimators"), F.col("param_max_depth").cast("int").alias("max_depth"), F.col("param_min_child_weight").cast("int").alias("min_child_weight"))


@query
def daily_orders(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias(TIMESTAMP)).agg(F.count(F.lit(1)).alias(TARGET), F.sum("o_totalprice").alias("total_price"))


@query
def describe_target(spark, d):
    y = F.col(TARGET).cast("double")
    q = [F.percentile(y, F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    s = series(spark, d)
    one = s.agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.skewness(y).alias("skewness_pop"), F.kurtosis(y).alias("kurtosis_pop"), *q)
    iqr = F.col("q3") - F.col("q1")
    outliers = s.join(F.broadcast(one)).agg(F.count_if((y < F.col("q1") - 1.5 * iqr) | (y > F.col("q3") + 1.5 * iqr)).alias("outliers"))
    return one.join(outliers)


@query
def hour_by_day(spark, d):
    s = features.add_calendar(series(spark, d), ["hour", "day_of_week"])
    return s.groupBy("hour").pivot("day_of_week", list(range(7))).agg(F.avg(TARGET)).toDF("hour", *(f"d{k}" for k in range(7)))


@query
def peak_hours(spark, d):
    s = features.add_calendar(series(spark, d), ["hour"]).groupBy("hour").agg(F.avg(TARGET).alias("mean"))
    return s.agg(F.max_by("hour", F.struct("mean", -F.col("hour"))).alias("peak_hour"), F.min_by("hour", F.struct("mean", "hour")).alias("lowest_hour"), F.max("mean").alias("peak_mean"))


@query
def correlations(spark, d):
    t = table(spark, d, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = t.agg(*(F.corr(a, b).alias(f"{a}/{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}/{b}`").alias("r")) for a, b in pairs))).alias("x")).select("x.*")


@query
def daily_shipments_features(spark, d):
    """The same operators on a daily series of seven years, by return flag."""
    t = table(spark, d, "lineitem").groupBy("l_returnflag", F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias(TIMESTAMP)).agg(F.count(F.lit(1)).alias(TARGET))
    made = features.lag_columns([1, 7], ["l_returnflag"]) | features.rolling_columns([7], [7], ["l_returnflag"])
    return t.withColumns(made)


# --- without SQL: fitted models and recursions; tests hold them against plain versions


@query
def grid_cv(spark, d):
    """All 324 sets of the search space on all five folds."""
    s = series(spark, d)
    grid = models.parameter_grid(TREE_SPACE, "xgb_basic")
    p = models.grid_cv(s, cv(spark, d), grid, "basic", HORIZON)
    return comparison.tuning_summary(grouped_metrics(p, ["parameter_set_id", "fold"]), models.parameter_frame(spark, grid))


@query
def best_set_cv(spark, d):
    """One set of the search space on all five folds, by fold."""
    grid = [("xgb_basic_best", {"n_estimators": 300, "learning_rate": 0.03, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 1.0, "min_child_weight": 5})]
    return grouped_metrics(models.grid_cv(series(spark, d), cv(spark, d), grid, "basic", HORIZON), ["parameter_set_id", "fold"])


@query
def additive_cv(spark, d):
    """All 24 sets of the search space on all five folds."""
    grid = models.parameter_grid(PROPHET_SPACE, "prophet")
    return grouped_metrics(gram.additive_cv(cv(spark, d), grid, HORIZON), ["parameter_set_id", "fold"])


@query
def additive_sums(spark, d):
    """The sums of terms against targets from which every fold's coefficients are solved."""
    return gram.target_sums(gram.fold_grams(cv(spark, d), series(spark, d)))


@query
def additive_components(spark, d):
    s = features.feature_matrix(series(spark, d), "basic")
    regressors = tuple(feature_columns("basic"))
    c = gram.additive_components(s, s, regressors=regressors)
    return models.component_summary(c, ["trend", "daily", "weekly", *(f"regressor_{r}" for r in regressors)])


@query
def seasonal_ar_forecast(spark, d):
    train, test = splits.holdout(series(spark, d), TEST_DAYS)
    return models.seasonal_ar_predictions(train, test, HORIZON)


@query
def stream_seasonal_forecast(spark, d):
    """The same forecasts from a stream of the final test's actuals, with the known values in the state store."""
    train, test = splits.holdout(series(spark, d), TEST_DAYS)
    folder = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}"
    test.select(TIMESTAMP, TARGET).coalesce(1).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(test.select(TIMESTAMP, TARGET).schema).parquet(f"{folder}/in")
    answered = state_updating_forecast(arriving, staged(fitted_states(train)), HORIZON)
    answered.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(answered.schema).parquet(f"{folder}/out")


@query
def shap_importance(spark, d):
    """A model of the advanced set at depth 7, explained on 2,000 evenly spaced rows, or all where there are fewer."""
    m, cols = features.feature_matrix(series(spark, d), "advanced"), feature_columns("advanced")
    _, trees = boosting.fitted_trees(m, {"n_estimators": 300, "learning_rate": 0.05, "max_depth": 7, "subsample": 0.8, "colsample_bytree": 0.8, "min_child_weight": 5}, "advanced")
    return models.shap_importance(shapley.shap_rows(features.evenly_sampled(m, 2000).repartition(8), trees, cols), cols)


@query
def residual_diagnostics(spark, d):
    return stats.diagnostics_summary(cv_errors(spark, d), "residual", ["model_label"])


@query
def residual_pacf(spark, d):
    return stats.pacf(stats.acf(cv_errors(spark, d), "residual", ["model_label"], 168), ["model_label"])


@query
def dm_p_values(spark, d):
    rows = stats.differentials(final_predictions(spark, d), PAIRS)
    return stats.dm_conclusion(stats.dm_by_timestamp(rows, HORIZON))


@query
def normality_tests(spark, d):
    return stats.normality(cv_errors(spark, d), "residual", ["model_label"])


@query
def normality_statistics(spark, d):
    return stats.normality(cv_errors(spark, d), "residual", ["model_label"]).select("model_label", "test_name", "statistic")


@query
def shapiro_of_prices(spark, d):
    """Ranks of whole groups: the prices of the orders of each priority, many of them more than a task would hold at scale."""
    out = stats.shapiro(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])
    return out.select("o_orderpriority", "statistic")


@query
def exact_quantiles(spark, d):
    """Quantiles of whole groups from ranks, where a group's distinct values needn't fit one task."""
    return ordered.quantiles(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99})


@query
def qq_points(spark, d):
    return stats.qq_points(cv_errors(spark, d), "residual", ["model_label"]).drop("theoretical")


@query
def orders_runs(spark, d):
    """The runs test over all orders of a priority, by date and key, around the group's mean."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    o = ordered.with_group(o, ["o_orderpriority"], mean=F.avg("o_totalprice")).withColumn("gap", F.col("o_totalprice") - F.col("mean"))
    return stats.centre_and_randomness(o, "gap", ["o_orderpriority"], order="o_orderkey").select("o_orderpriority", "n", "positive_count", "negative_count", "runs_test_z_statistic")
