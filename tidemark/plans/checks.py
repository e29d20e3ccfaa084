"""Queries of contracts, joins and comparisons, each with its SQL; they extend the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PROPHET_SPACE, TARGET
from ..functions.metrics import grouped_metrics
from ..operators import analysis, comparison, contracts, features, gram, models, regressors, splits, stats, timeaxis
from ..sources import artefacts, tables
from .catalog import HORIZON, PAIRS, QUERIES, TEST_DAYS, cv, cv_metrics, cv_predictions, errors, final_metrics, final_predictions, pair_table, query, series, sparse, table
from .retraining import dm_run_summary, feature_summary
from .oracle import BUNDLE, DENSE, DIFF, FINAL, FM, FOLDED, HOURLY, LONG, M, ORACLE_SQL, PAIRS as PAIR_SQL, QUANT, at, dm, matrix

__all__ = ["ORACLE_SQL", "QUERIES"]


def halves(spark, d):
    return splits.holdout(series(spark, d), TEST_DAYS)


HALVES = DENSE + ", x AS (SELECT *, timestamp > (SELECT max(timestamp) FROM p) - INTERVAL 5 DAY AS late FROM p)"


def add(name: str, sql: str):
    """Registers a query with its SQL."""

    def register(f):
        f.__name__ = name
        ORACLE_SQL[name] = sql
        return query(f)

    return register


@add("target_domain_contract", """SELECT 0::BIGINT AS bad_missing, 0::BIGINT AS bad_non_numeric, 0::BIGINT AS bad_non_finite, count(*) FILTER (y < 0) AS bad_negative, count(*) FILTER (y <> floor(y)) AS bad_fractional
    FROM (SELECT l_discount::DOUBLE AS y FROM lineitem)""")
def _(spark, d):
    return contracts.target_domain(table(spark, d, "lineitem").select(F.col("l_discount").alias(TARGET)))


@add("loaded_data_profile", f"""SELECT count(*) AS n_rows, 2 AS n_columns, count(*) FILTER (c_acctbal IS NULL) AS missing, 0::BIGINT AS non_numeric, count(*) FILTER (c_acctbal < 0) AS negative, {at('min(c_acctbal)')} AS target_min, {at('max(c_acctbal)')} AS target_max FROM customer""")
def _(spark, d):
    return contracts.loaded_profile(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias(TARGET)))


@add("series_contract", f"""WITH {HOURLY}, g AS (SELECT *, date_diff('second', lag(timestamp) OVER (ORDER BY timestamp), timestamp) AS step FROM h)
    SELECT count(*) > 0 AS ok_not_empty, count(*) FILTER (timestamp IS NULL) AS bad_null_timestamp, count(*) FILTER (step <= 0) AS bad_repeated_timestamp, count(*) FILTER (trip_count IS NULL) AS bad_null_target FROM g""")
def _(spark, d):
    return contracts.series_contract(sparse(spark, d))


_MATRIX = matrix("basic")


@add("matrix_contract", f"""WITH m AS ({_MATRIX}) SELECT count(*) > 0 AS ok_not_empty, count(*) - count(DISTINCT timestamp) AS bad_repeated_timestamp,
    {', '.join(f'count(*) FILTER ({c} IS NULL OR NOT isfinite({c}::DOUBLE)) AS bad_{c}' for c in ('trip_count', 'lag_1', 'lag_24', 'lag_168', 'hour', 'day_of_week'))} FROM m""")
def _(spark, d):
    return contracts.matrix_contract(features.feature_matrix(series(spark, d), "basic"), "basic")


@add("history_contract", f"WITH {DENSE} SELECT count(*) >= 168 AS ok_long_enough, count(*) FILTER (y IS NULL OR isnan(y)) AS bad_target, count(*) - count(DISTINCT timestamp) AS bad_repeated_timestamp FROM p")
def _(spark, d):
    return contracts.history_contract(series(spark, d))


@add("models_aligned", f"""WITH {FINAL}, g AS (SELECT timestamp, count(DISTINCT model_label) AS m, count(*) AS n, max(actual) - min(actual) AS spread FROM e GROUP BY 1)
    SELECT count(*) FILTER (m <> 3 OR n <> 3) AS bad_models_at_time, count(*) FILTER (abs(spread) > 1e-9) AS bad_actuals, count(*) AS n_timestamps, count(*) = 120 AS ok_rows_per_model FROM g""")
def _(spark, d):
    return contracts.models_aligned(final_predictions(spark, d), 3, rows_per_model=TEST_DAYS * 24)


@add("same_labels", """SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS bad_only_in_first, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS bad_only_in_second""")
def _(spark, d):
    return contracts.same_values(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


@add("final_scope_contract", f"""WITH {HALVES} SELECT max(timestamp) FILTER (NOT late) < min(timestamp) FILTER (late) AS ok_ordered, count(*) FILTER (late) >= 24 AS ok_long_enough, count(*) FILTER (late) - count(DISTINCT timestamp) FILTER (late) AS bad_repeated_timestamp FROM x""")
def _(spark, d):
    return contracts.final_scope(*halves(spark, d))


@add("matrix_inside_training", f"""WITH {HALVES}, m AS ({_MATRIX}) SELECT (SELECT count(*) FROM m WHERE timestamp NOT IN (SELECT timestamp FROM x WHERE NOT late)) AS bad_outside,
    (SELECT max(timestamp) FROM m) = (SELECT max(timestamp) FROM x WHERE NOT late) AS ok_same_end""")
def _(spark, d):
    return contracts.matrix_inside(features.feature_matrix(series(spark, d), "basic"), halves(spark, d)[0])


@add("joined_folds", f"""WITH {FOLDED}, a AS (SELECT * FROM e WHERE model_label = 'naive_1'), z AS (SELECT * FROM e WHERE model_label = 'seasonal_24' AND fold <> 2)
    SELECT count(*) FILTER (a.fold IS NULL OR z.fold IS NULL) AS bad_unmatched, count(*) FILTER (abs(a.actual - z.actual) > 1e-8 + 1e-5 * abs(z.actual)) AS bad_actuals FROM a FULL JOIN z ON a.fold = z.fold AND a.timestamp = z.timestamp""")
def _(spark, d):
    p = cv_predictions(spark, d)
    return contracts.joined_folds(p.filter("model_label = 'naive_1'"), p.filter("model_label = 'seasonal_24' and fold <> 2"))


@add("ordered_equal", f"""WITH {HALVES}, a AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS pos FROM x), b AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS pos FROM x WHERE NOT late)
    SELECT count(*) FILTER (a.pos IS NULL OR b.pos IS NULL) AS bad_places FROM a FULL JOIN b ON a.timestamp = b.timestamp AND a.pos = b.pos""")
def _(spark, d):
    return contracts.ordered_equal(series(spark, d), halves(spark, d)[0])


@add("split_audit", f"""WITH {HALVES}, a AS (SELECT count(*) FILTER (NOT late) AS train_rows, min(timestamp) FILTER (NOT late) AS train_start, max(timestamp) FILTER (NOT late) AS train_end,
    count(*) FILTER (late) AS test_rows, min(timestamp) FILTER (late) AS test_start, max(timestamp) FILTER (late) AS test_end, count(*) AS source_rows FROM x)
    SELECT *, (SELECT count(*) FROM (SELECT timestamp FROM x WHERE late INTERSECT SELECT timestamp FROM x WHERE NOT late)) AS overlap, 0::BIGINT AS lost_rows, train_end < test_start AS ordered, train_rows + test_rows = source_rows AS rows_preserved, 120::BIGINT AS test_rows_expected FROM a""")
def _(spark, d):
    return splits.split_audit(*halves(spark, d), series(spark, d), TEST_DAYS)


@add("fold_training_rows", f"""WITH {FOLDED}, m AS ({_MATRIX}) SELECT * FROM m WHERE timestamp IN (SELECT timestamp FROM f WHERE fold = 2 AND pos < val_start)""")
def _(spark, d):
    return splits.training_rows(features.feature_matrix(series(spark, d), "basic"), cv(spark, d).filter("role = 'train' and fold = 2"))


@add("training_window", f"WITH {DENSE} SELECT timestamp, trip_count FROM d ORDER BY timestamp DESC LIMIT 200")
def _(spark, d):
    return splits.training_window(series(spark, d), 200)


_CV_ALL = ", ".join(f"{at(f'avg({c})')} AS {c}_mean, {at(f'stddev_samp({c})')} AS {c}_std, {at(f'min({c})')} AS {c}_min, {at(f'max({c})')} AS {c}_max" for c in ("mae", "rmse", "mape", "smape"))


@add("metric_comparison", f"WITH {FM} SELECT model_label, count(*) AS n_rows, count(DISTINCT fold) AS n_folds, {_CV_ALL}, (row_number() OVER (ORDER BY avg(mae), model_label))::INT AS rank FROM m GROUP BY 1")
def _(spark, d):
    return comparison.metric_comparison(cv_metrics(spark, d))


@add("improving_pairs", f"""WITH {M}, {LONG} SELECT comparison, x.metric, baseline, challenger, {at('x.value')} AS baseline_value, {at('z.value')} AS challenger_value, {at('x.value - z.value')} AS absolute_reduction, {at('(x.value - z.value) / nullif(x.value, 0) * 100')} AS percent_reduction,
    CASE WHEN z.value < x.value THEN challenger ELSE baseline END AS winner FROM {PAIR_SQL} JOIN u x ON x.model_label = baseline JOIN u z ON z.model_label = challenger AND z.metric = x.metric WHERE x.metric = 'mae' AND x.value > z.value""")
def _(spark, d):
    return comparison.improves(comparison.improvements(final_metrics(spark, d), pair_table(spark)))


#: Runtimes by model, parameter set and fold, made from line items.
_RUNS = "r AS (SELECT 'm' || (l_linenumber % 3) AS model_label, l_linenumber AS parameter_set_id, l_suppkey % 5 AS fold, l_quantity::DOUBLE AS train_time_seconds, (l_extendedprice / 100)::DOUBLE AS prediction_time_seconds, (l_quantity + l_extendedprice / 100)::DOUBLE AS total_runtime_seconds FROM lineitem)"


def runs(spark, d):
    q, p = F.col("l_quantity").cast("double"), (F.col("l_extendedprice") / 100).cast("double")
    return table(spark, d, "lineitem").select(F.concat(F.lit("m"), F.col("l_linenumber") % 3).alias("model_label"), F.col("l_linenumber").alias("parameter_set_id"), (F.col("l_suppkey") % 5).alias("fold"), q.alias("train_time_seconds"), p.alias("prediction_time_seconds"), (q + p).alias("total_runtime_seconds"))


_TIMES = ("train_time_seconds", "prediction_time_seconds", "total_runtime_seconds")


@add("runtime_by_parameter_set", f"WITH {_RUNS} SELECT parameter_set_id, count(DISTINCT fold) AS n_folds, " + ", ".join(f"{at(f'{fn}({c})', 4)} AS {c}_{n}" for c in _TIMES for n, fn in (("sum", "sum"), ("mean", "avg"), ("max", "max"))) + " FROM r GROUP BY 1")
def _(spark, d):
    out = comparison.runtime_summary(runs(spark, d))
    return out.withColumns({c: F.round(c, 4) for c, t in out.dtypes if t == "double"})


@add("runtime_with_total", f"WITH {_RUNS} SELECT coalesce(model_label, 'total') AS model_label, {at('sum(train_time_seconds)', 2)} AS train_time_seconds, {at('sum(prediction_time_seconds)', 2)} AS prediction_time_seconds FROM r GROUP BY ROLLUP (model_label)")
def _(spark, d):
    out = comparison.with_total(runs(spark, d).select("model_label", "train_time_seconds", "prediction_time_seconds"), "model_label")
    return out.withColumns({c: F.round(c, 2) for c, t in out.dtypes if t == "double"})


_COST = f"""{_RUNS}, g AS (SELECT model_label, round(sum(train_time_seconds), 2) AS tuning_seconds, round(max(train_time_seconds), 2) AS retrain_seconds, count(*)::DOUBLE AS load_seconds, round(max(prediction_time_seconds), 2) AS predict_seconds FROM r GROUP BY 1),
    k AS (SELECT *, tuning_seconds + retrain_seconds + load_seconds + predict_seconds AS known_end_to_end_seconds FROM g)"""


@add("time_cost", f"WITH {_COST} SELECT model_label, {', '.join(f'{at(c, 2)} AS {c}' for c in ('tuning_seconds', 'retrain_seconds', 'load_seconds', 'predict_seconds', 'known_end_to_end_seconds'))}, {', '.join(f'(rank() OVER (ORDER BY {c}))::INT AS {c}_rank' for c in ('tuning_seconds', 'predict_seconds', 'known_end_to_end_seconds'))} FROM k")
def _(spark, d):
    r = runs(spark, d).groupBy("model_label")
    tuning = r.agg(F.round(F.sum("train_time_seconds"), 2).alias("tuning_seconds"))
    retraining = r.agg(F.round(F.max("train_time_seconds"), 2).alias("retrain_seconds"))
    final = r.agg(F.count(F.lit(1)).cast("double").alias("load_seconds"), F.round(F.max("prediction_time_seconds"), 2).alias("predict_seconds"))
    out = comparison.time_cost(tuning, retraining, final)
    return out.withColumns({c: F.round(c, 2) for c, t in out.dtypes if t == "double"})


@add("reference_comparison", f"WITH {M}, o2 AS (SELECT * FROM m UNION ALL SELECT 'reference', mae * 1.1, rmse, mape, smape FROM m WHERE model_label = 'naive_1') SELECT model_label, {', '.join(f'{at(c)} AS {c}' for c in ('mae', 'rmse', 'mape', 'smape'))}, (row_number() OVER (ORDER BY mae, model_label))::INT AS rank FROM o2")
def _(spark, d):
    m = final_metrics(spark, d).select("model_label", "mae", "rmse", "mape", "smape")
    other = m.filter("model_label = 'naive_1'").select(F.lit("reference").alias("model_label"), (F.col("mae") * 1.1).alias("mae"), "rmse", "mape", "smape")
    return comparison.reference_comparison(m, other)


@add("accuracy_and_runtime", f"WITH {M}, times AS (SELECT model_label, (fold * 10)::DOUBLE AS seconds FROM (VALUES ('naive_1', 1), ('seasonal_24', 2), ('other', 3)) AS v(model_label, fold)) SELECT model_label, {at('mae')} AS mae, seconds FROM m JOIN times USING (model_label)")
def _(spark, d):
    runtime = spark.createDataFrame([("naive_1", 10.0), ("seasonal_24", 20.0), ("other", 30.0)], "model_label string, seconds double")
    return comparison.accuracy_and_runtime(final_metrics(spark, d).select("model_label", "mae"), runtime)


_ANSWERS = ["TRUE", " yes ", "0", "n", "maybe", "", "1"]


@add("boolean_coercion", f"SELECT c_custkey, v AS answer, CASE WHEN lower(trim(v)) IN ('true', '1', 'yes', 'y') THEN 'true' WHEN lower(trim(v)) IN ('false', '0', 'no', 'n') THEN 'false' END AS flag FROM (SELECT c_custkey, ({_ANSWERS})[1 + c_custkey % {len(_ANSWERS)}] AS v FROM customer)")
def _(spark, d):
    """An answer by customer, as people write yes and no; what is neither is null, which ``require_bool`` makes an error."""
    answers = F.array(*map(F.lit, _ANSWERS))
    return table(spark, d, "customer").select("c_custkey", F.element_at(answers, (1 + F.col("c_custkey") % len(_ANSWERS)).cast("int")).alias("answer")).withColumn("flag", comparison.bool_text("answer").cast("string"))


@add("first_order_of_customer", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders) WHERE nth = 1")
def _(spark, d):
    return analysis.first_per_group(table(spark, d, "orders"), ["o_custkey"], F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")


@add("demand_tail_summary", f"WITH {FINAL}, {QUANT} SELECT model_label, 'high_demand_p90' AS demand_tail, {at('any_value(p90)')} AS actual_threshold, count(*) AS n_predictions, {BUNDLE} FROM e, q WHERE actual >= p90 GROUP BY 1")
def _(spark, d):
    return analysis.tail_summary(analysis.demand_tail(errors(spark, d), "high"))


@add("metric_row_of_model", f"WITH {M} SELECT model_label, {', '.join(f'{at(c)} AS {c}' for c in ('mae', 'rmse', 'mape', 'smape'))} FROM m WHERE model_label = 'seasonal_24'")
def _(spark, d):
    return analysis.model_row(final_metrics(spark, d).select("model_label", "mae", "rmse", "mape", "smape"), "seasonal_24")


@add("loss_by_timestamp", f"WITH {FINAL} SELECT timestamp, {at('any_value(actual)')} AS actual, origin_block, horizon_step, {', '.join(f'{at(f'max(CASE WHEN model_label = {chr(39)}{m}{chr(39)} THEN residual ** 2 END)')} AS {m}' for m in ('naive_1', 'seasonal_24', 'seasonal_168'))} FROM e GROUP BY timestamp, origin_block, horizon_step")
def _(spark, d):
    return stats.loss_wide(final_predictions(spark, d), "squared_error", ["naive_1", "seasonal_24", "seasonal_168"])


@add("dm_by_timestamp_24", "WITH " + dm(DIFF + ", g AS (SELECT * FROM w)", "comparison, loss_type", "timestamp", 23, 24, f"comparison, loss_type, n AS n_obs, {at('mean_loss_difference')} AS mean_loss_difference, {at('long_run_variance', 4)} AS long_run_variance, {at('statistic')} AS statistic"))
def _(spark, d):
    out = stats.dm_by_timestamp(stats.differentials(final_predictions(spark, d), PAIRS), HORIZON).select("comparison", "loss_type", "n_obs", "mean_loss_difference", "long_run_variance", "statistic")
    return out.withColumn("long_run_variance", F.round("long_run_variance", 4))


@add("future_hours", f"WITH {HOURLY} SELECT k::INT AS horizon_step, (SELECT max(timestamp) FROM h) + k * INTERVAL 1 HOUR AS timestamp FROM (SELECT unnest(range(1, 25)) AS k)")
def _(spark, d):
    return timeaxis.future_index(sparse(spark, d), HORIZON)


@add("best_and_worst_hours", f"""WITH {FINAL}, g AS (SELECT model_label, local_hour::INT AS local_hour, avg(absolute_error) AS mae FROM l GROUP BY 1, 2)
    SELECT model_label, 'best' AS kind, local_hour, {at('mae')} AS mae FROM (SELECT *, row_number() OVER (PARTITION BY model_label ORDER BY mae, local_hour) AS i FROM g) WHERE i = 1
    UNION ALL SELECT model_label, 'worst', local_hour, {at('mae')} FROM (SELECT *, row_number() OVER (PARTITION BY model_label ORDER BY mae DESC, local_hour) AS i FROM g) WHERE i = 1""")
def _(spark, d):
    return analysis.best_and_worst(QUERIES["errors_by_local_hour"](spark, d), "local_hour")


@add("feature_stage_summary", "WITH " + ", ".join(f"{k} AS ({matrix(k)})" for k in ("basic", "advanced")) + ", " + DENSE + "".join(f"""{u}
    SELECT '{k}' AS feature_set, {n + 2} AS n_columns, {n} AS n_feature_columns, count(*) AS n_rows, min(timestamp) AS period_start, max(timestamp) AS period_end, 0::BIGINT AS non_hourly_steps, 0::BIGINT AS leakage_mismatches,
    (SELECT count(*) FROM p) AS source_rows, (SELECT count(*) FROM p) - count(*) AS dropped_rows_due_to_history FROM {k}""" for u, k, n in (("", "basic", 5), ("\n    UNION ALL", "advanced", 17))))
def _(spark, d):
    s = series(spark, d)
    return feature_summary(s, {k: features.feature_matrix(s, k) for k in ("basic", "advanced")})


@add("dm_run_summary", f"""WITH {FINAL} SELECT 'Diebold-Mariano' AS statistical_test, count(*) AS n_prediction_rows, count(DISTINCT model_label) AS n_models, 3 * 2 AS n_block_level_tests, 3 * 2 * 24 AS n_by_horizon_tests, 3 * 2 AS n_timestamp_level_tests,
    3 AS n_comparisons, 2 AS n_loss_types, 0.0::DOUBLE AS total_runtime_seconds, 'success' AS status FROM e""")
def _(spark, d):
    p = final_predictions(spark, d)
    losses = stats.differentials(p, PAIRS)
    return dm_run_summary(p, stats.dm_by_block(losses), stats.dm_by_horizon(losses), stats.dm_by_timestamp(losses, HORIZON), len(PAIRS))


@query
def regressor_cv(spark, d):
    s = series(spark, d)
    p = regressors.regressor_cv(s, cv(spark, d), models.parameter_grid(PROPHET_SPACE, "prophet_regressor_basic"), "basic", HORIZON)
    return grouped_metrics(p, ["parameter_set_id", "fold"])


@query
def regressor_final(spark, d):
    return regressors.regressor_final(series(spark, d), TEST_DAYS, {"changepoint_prior_scale": 0.05, "seasonality_prior_scale": 10.0}, "basic", horizon=HORIZON)


@query
def direct_final(spark, d):
    return gram.additive_cv(regressors.final_rows(series(spark, d), TEST_DAYS), [("best", {"changepoint_prior_scale": 0.05})], HORIZON)


def stored_predictions(spark, d):
    """The final predictions as a file of text holds them."""
    text = [F.col(c).cast("string").alias(c) for c in ("actual", "predicted", "horizon_step", "origin_block")]
    return final_predictions(spark, d).select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "model_label", "feature_set", *text, F.lit("k").alias("model_key"), F.lit("p").alias("parameter_set_id"), F.lit("0.5").alias("prediction_time_seconds"), F.lit(" No ").alias("used_actual_future_for_features"))


def broken_predictions(spark, d):
    step, block = F.col("horizon_step").cast("int"), F.col("origin_block").cast("int")
    return stored_predictions(spark, d).withColumns({
        "horizon_step": F.when(step % 6 == 0, "six").when(step == 1, "1.5").when(step == 2, F.lit(None)).otherwise(F.col("horizon_step")), "actual": F.when(block == 2, "n/a").when(block == 3, F.lit(None)).otherwise(F.col("actual")),
        "used_actual_future_for_features": F.when(step == 3, "maybe").when(step == 4, F.lit(None)).otherwise("TRUE"), "timestamp": F.when((block == 1) & (step == 5), "never").otherwise(F.col("timestamp")),
    })


@add("artefact_audit", f"""WITH {FINAL}, n AS (SELECT count(*) AS n FROM e), f AS (
    SELECT 'timestamp' AS "column", 'time' AS kind, count(*) FILTER (origin_block = 1 AND horizon_step = 5) AS faults, 'never' AS example FROM e UNION ALL
    SELECT 'actual', 'number', count(*) FILTER (origin_block = 2), 'n/a' FROM e UNION ALL SELECT 'horizon_step', 'whole', count(*) FILTER (horizon_step % 6 = 0 OR horizon_step <= 2), '1.5' FROM e UNION ALL
    SELECT 'used_actual_future_for_features', 'flag', count(*) FILTER (horizon_step IN (3, 4)), 'maybe' FROM e UNION ALL
    SELECT c, k, 0, NULL FROM (VALUES ('model_label', 'text'), ('model_key', 'text'), ('feature_set', 'text'), ('parameter_set_id', 'text'), ('origin_block', 'whole'), ('predicted', 'number'), ('prediction_time_seconds', 'number')) AS x(c, k))
    SELECT "column", kind, n AS n_rows, faults, example FROM f, n""")
def _(spark, d):
    """Faults by column of a stored table that breaks its contract in several ways."""
    return artefacts.audit(broken_predictions(spark, d), artefacts.FINAL_PREDICTIONS)


@add("artefact_audit_clean", f"""WITH {FINAL} SELECT count(*) AS n_columns, sum(faults)::BIGINT AS faults, (SELECT count(*) FROM e) AS n_rows FROM (SELECT unnest(range(11)) AS c, 0 AS faults)""")
def _(spark, d):
    return artefacts.audit(stored_predictions(spark, d), artefacts.FINAL_PREDICTIONS).agg(F.count(F.lit(1)).alias("n_columns"), F.sum("faults").alias("faults"), F.max("n_rows").alias("n_rows"))


@add("artefact_predictions", f"""WITH {FINAL} SELECT timestamp, model_label, {at('actual')} AS actual, {at('residual')} AS residual, {at('absolute_error')} AS absolute_error, {at('residual ** 2')} AS squared_error, horizon_step, local_hour::INT AS local_hour, dow::INT AS local_day_of_week, (dow >= 5)::INT AS local_is_weekend,
    month(timezone('America/New_York', timezone('UTC', timestamp)))::INT AS local_month, dayname(timezone('America/New_York', timezone('UTC', timestamp))) AS local_day_name, false AS used_actual_future_for_features FROM l""")
def _(spark, d):
    """Text back to kinds, with errors and the local calendar derived, as the error analysis reads it."""
    made = artefacts.conformed(stored_predictions(spark, d), artefacts.ANALYSED_PREDICTIONS)
    return made.select("timestamp", "model_label", "actual", "residual", "absolute_error", "squared_error", "horizon_step", "local_hour", "local_day_of_week", "local_is_weekend", "local_month", "local_day_name", "used_actual_future_for_features")


@add("artefact_metrics", f"""WITH {M} SELECT model_label, {at('mae')} AS mae, CASE WHEN model_label <> 'naive_1' THEN 1.5 END AS prediction_time_seconds, {at('rmse')} AS rmse, true AS final_test_used_for_tuning FROM m""")
def _(spark, d):
    """Lenient columns turn what is no number into null; measures are strict."""
    m = final_metrics(spark, d)
    text = m.select("model_label", *(F.col(c).cast("string").alias(c) for c in ("mae", "rmse", "mape", "smape")), F.lit("p").alias("parameter_set_id"), F.when(F.col("model_label") == "naive_1", "fast").otherwise("1.5").alias("prediction_time_seconds"), F.lit(None).cast("string").alias("retraining_train_time_seconds"), F.lit("0").alias("used_actual_future_for_features"), F.lit("Yes").alias("final_test_used_for_tuning"))
    artefacts.require_clean(text, artefacts.ANALYSED_METRICS)
    return artefacts.conformed(text, artefacts.ANALYSED_METRICS).select("model_label", "mae", "prediction_time_seconds", "rmse", "final_test_used_for_tuning")
