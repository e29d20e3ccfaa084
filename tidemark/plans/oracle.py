"""DuckDB SQL of the catalogue's queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from ..config import LAGS, MEAN_WINDOWS, STD_WINDOWS, TREE_SPACE

NY = "America/New_York"
MODELS = {"naive_1": 1, "seasonal_24": 24, "seasonal_168": 168}
PAIRS = "(VALUES ('a','naive_1','seasonal_24'),('b','seasonal_24','seasonal_168'),('c','naive_1','seasonal_168')) AS pair(comparison, baseline, challenger)"

HOURLY = "h AS (SELECT date_trunc('hour', ts) AS timestamp, count(*) AS trip_count FROM events GROUP BY 1)"
DENSE = HOURLY + """, spine AS (SELECT unnest(generate_series((SELECT min(timestamp) FROM h), (SELECT max(timestamp) FROM h), INTERVAL 1 HOUR)) AS timestamp),
d AS (SELECT s.timestamp, coalesce(h.trip_count, 0) AS trip_count FROM spine s LEFT JOIN h ON h.timestamp = s.timestamp),
p AS (SELECT timestamp, trip_count, trip_count::DOUBLE AS y, row_number() OVER (ORDER BY timestamp) - 1 AS pos, count(*) OVER () AS n FROM d)"""
DAYS = "g AS (SELECT DISTINCT date_trunc('day', o_orderdate)::TIMESTAMP AS timestamp FROM orders)"
TYPED = """h AS (SELECT event_type, date_trunc('hour', ts) AS timestamp, count(*) AS trip_count FROM events GROUP BY 1, 2),
ends AS (SELECT event_type, min(timestamp) AS a, max(timestamp) AS b FROM h GROUP BY 1),
spine AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS timestamp FROM ends),
d AS (SELECT s.event_type, s.timestamp, coalesce(h.trip_count, 0) AS trip_count FROM spine s LEFT JOIN h ON h.timestamp = s.timestamp AND h.event_type IS NOT DISTINCT FROM s.event_type),
p AS (SELECT event_type, timestamp, trip_count, trip_count::DOUBLE AS y, row_number() OVER (PARTITION BY event_type ORDER BY timestamp) - 1 AS pos FROM d)"""


def local(ts: str) -> str:
    return f"timezone('{NY}', timezone('UTC', {ts}))"


def at(value: str, digits: int = 6) -> str:
    return f"round(({value})::DOUBLE, {digits}) + 0.0"


NAMES = ", ".join(f"('{m}', {k})" for m, k in MODELS.items())
#: The final test's rows by model: a value of ``k`` rows back, or for the last value the one before the block.
FINAL = DENSE + f""", t AS (SELECT *, pos - min(pos) OVER () AS nth FROM p WHERE timestamp > (SELECT max(timestamp) FROM p) - INTERVAL 5 DAY),
b AS (SELECT *, (floor(nth / 24.0) + 1)::INT AS origin_block, (nth % 24 + 1)::INT AS horizon_step FROM t),
e AS (SELECT m.model_label, b.timestamp, b.y AS actual, q.y AS predicted, b.origin_block, b.horizon_step, b.pos, b.y - q.y AS residual, abs(b.y - q.y) AS absolute_error
 FROM b CROSS JOIN (VALUES {NAMES}) AS m(model_label, k) JOIN p q ON q.pos = CASE WHEN m.k = 1 THEN b.pos - b.horizon_step ELSE b.pos - m.k END),
l AS (SELECT *, hour({local('timestamp')}) AS local_hour, isodow({local('timestamp')}) - 1 AS dow FROM e)"""
FOLDED = DENSE + f""", f AS (SELECT p.*, fold, n - (5 - fold + 1) * 72 AS val_start FROM p, (SELECT unnest(range(1, 6))::INT AS fold)),
v AS (SELECT *, pos - val_start AS nth FROM f WHERE pos >= val_start AND pos < val_start + 72),
b AS (SELECT *, (floor(nth / 24.0) + 1)::INT AS origin_block, (nth % 24 + 1)::INT AS horizon_step FROM v),
e AS (SELECT m.model_label, b.fold, b.timestamp, b.y AS actual, q.y AS predicted
 FROM b CROSS JOIN (VALUES {NAMES}) AS m(model_label, k) JOIN p q ON q.pos = CASE WHEN m.k = 1 THEN b.pos - b.horizon_step ELSE b.pos - m.k END)"""

MAE, RMSE = "avg(abs(actual - predicted))", "sqrt(avg((actual - predicted) ** 2))"
MAPE = "avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100"
SMAPE = "avg(CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0 ELSE 2 * abs(actual - predicted) / (abs(actual) + abs(predicted)) END) * 100"
FOUR = f"{at(MAE)} AS mae, {at(RMSE)} AS rmse, {at(MAPE)} AS mape, {at(SMAPE)} AS smape"
COUNTS = "count(*) AS n_obs, count(*) AS n_valid_obs, 0::BIGINT AS n_invalid_obs, count(*) FILTER (actual = 0) AS mape_zero_actual_count, count(*) FILTER (actual <> 0) AS mape_valid_count, count(*) FILTER (abs(actual) + abs(predicted) = 0) AS smape_zero_denominator_count"
RATES = f"{at('avg((predicted > actual)::INT)')} AS overprediction_rate, {at('avg((predicted < actual)::INT)')} AS underprediction_rate"
BUNDLE = f"{FOUR}, {at('avg(actual - predicted)')} AS mean_error, {at('median(actual - predicted)')} AS median_error, {RATES}, {at('max(abs(actual - predicted))')} AS max_absolute_error"
SHORT = f"count(*) AS n_predictions, {at(MAE)} AS mae, {at(RMSE)} AS rmse, {at('avg(actual - predicted)')} AS mean_error"
RAW_FOUR = f"{MAE} AS mae, {RMSE} AS rmse, {MAPE} AS mape, {SMAPE} AS smape"
M = FINAL + f", m AS (SELECT model_label, {RAW_FOUR} FROM e GROUP BY 1), o AS (SELECT *, list_position(['naive_1', 'seasonal_168', 'seasonal_24'], model_label) AS o FROM m)"
FM = FOLDED + f", m AS (SELECT model_label, fold, {RAW_FOUR} FROM e GROUP BY 1, 2)"
LONG = "u AS (" + " UNION ALL ".join(f"SELECT model_label, '{c}' AS metric, {c} AS value FROM m" for c in ("mae", "rmse", "mape", "smape")) + ")"
QUANT = "q AS (SELECT quantile_cont(a, 0.1) AS p10, quantile_cont(a, 0.9) AS p90, quantile_cont(a, 0.95) AS p95 FROM (SELECT any_value(actual) AS a FROM e GROUP BY timestamp))"
SEGMENTS = f"""s AS (SELECT l.*, unnest([CASE WHEN true THEN 'all' END, CASE WHEN local_hour IN (7,8,9,16,17,18,19) THEN 'rush_hour_local_07_09_16_19' END,
 CASE WHEN local_hour BETWEEN 0 AND 5 THEN 'night_local_00_05' END, CASE WHEN dow < 5 THEN 'weekday_local' END, CASE WHEN dow >= 5 THEN 'weekend_local' END,
 CASE WHEN actual >= p90 THEN 'high_demand_spike_p90' END, CASE WHEN actual <= p10 THEN 'low_demand_p10' END]) AS segment, p10, p90 FROM l, q)"""
DIFF = FINAL + f""", w AS (SELECT x.timestamp, x.origin_block, x.horizon_step, comparison, k AS loss_type,
 CASE WHEN k = 'squared_error' THEN x.residual ** 2 ELSE abs(x.residual) END AS a, CASE WHEN k = 'squared_error' THEN z.residual ** 2 ELSE abs(z.residual) END AS b
 FROM {PAIRS} JOIN e x ON x.model_label = baseline JOIN e z ON z.model_label = challenger AND z.timestamp = x.timestamp, (VALUES ('squared_error'), ('absolute_error')) AS kinds(k))"""


def matrix(kind: str, drop: bool = True, typed: bool = False) -> str:
    by = "PARTITION BY event_type " if typed else ""
    w = f"OVER ({by}ORDER BY timestamp)"
    cols = [f"lag(y, {k}) {w} AS lag_{k}" for k in LAGS[kind]]
    for name, fn, windows in (("mean", "avg", MEAN_WINDOWS[kind]), ("std", "stddev_samp", STD_WINDOWS[kind])):
        for n in windows:
            rows = f"OVER ({by}ORDER BY timestamp ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            cols.append(f"CASE WHEN count(y) {rows} = {n} THEN {fn}(y) {rows} END AS rolling_{name}_{n}")
    names = [c.rpartition(" AS ")[2] for c in cols]
    calendar = f"hour({local('timestamp')})::SMALLINT AS hour, (isodow({local('timestamp')}) - 1)::SMALLINT AS day_of_week"
    if kind == "advanced":
        calendar += f", (isodow({local('timestamp')}) >= 6)::TINYINT AS is_weekend, month({local('timestamp')})::SMALLINT AS month"
    kept = f" WHERE {' AND '.join(f'{n} IS NOT NULL' for n in names)}" if drop else ""
    key = "event_type, " if typed else ""
    return f"WITH {TYPED if typed else DENSE}, x AS (SELECT {key}timestamp, y, {', '.join(cols)} FROM p) SELECT {key}timestamp, y AS trip_count, {', '.join(f'{at(n)} AS {n}' for n in names)}, {calendar} FROM x{kept}"


def dm(source: str, group: str, order: str, lags: int, horizon: int, columns: str) -> str:
    lagged = "".join(f", coalesce(lag(z, {k}) OVER (PARTITION BY {group} ORDER BY {order}), 0) AS z{k}" for k in range(1, lags + 1))
    used = "".join(f" + 2 * {1 - k / (lags + 1)} * sum(z * z{k}) / count(*)" for k in range(1, lags + 1))
    return f"""{source}, c AS (SELECT *, a - b - avg(a - b) OVER (PARTITION BY {group}) AS z FROM g), k AS (SELECT *{lagged} FROM c),
 r AS (SELECT {group}, count(*) AS n, avg(a - b) AS mean_loss_difference, avg(a) AS la, avg(b) AS lb, sum(z * z) / count(*) AS variance_loss_difference, sum(z * z) / count(*){used} AS long_run_variance FROM k GROUP BY {group}),
 f AS (SELECT *, (n + 1 - 2 * {horizon} + {horizon * (horizon - 1)}::DOUBLE / n) / n AS inside FROM r),
 s AS (SELECT *, CASE WHEN n >= 3 AND long_run_variance > 0 THEN mean_loss_difference / sqrt(long_run_variance / n) * CASE WHEN inside > 0 THEN sqrt(inside) ELSE 1 END END AS statistic FROM f)
 SELECT {columns} FROM s"""


#: The residuals of all folds, 360 hours in a row by model.
CV_ERRORS = FOLDED + ", y AS (SELECT *, actual - predicted AS residual FROM e)"
ACF = CV_ERRORS + """, z AS (SELECT model_label, timestamp, residual - avg(residual) OVER (PARTITION BY model_label) AS z, row_number() OVER (PARTITION BY model_label ORDER BY timestamp) AS i, count(*) OVER (PARTITION BY model_label) AS n FROM y),
 a AS (SELECT x.model_label, x.i - w.i AS lag, sum(x.z * w.z) AS g, any_value(x.n) AS n FROM z x JOIN z w ON w.model_label = x.model_label AND x.i - w.i BETWEEN 0 AND 168 GROUP BY 1, 2),
 r AS (SELECT a.model_label, a.lag, a.g / o.g AS acf, a.n FROM a JOIN a o ON o.model_label = a.model_label AND o.lag = 0)"""
#: The Durbin-Levinson recursion with the coefficients of each order as a list.
PACF = ACF.replace("h AS (", "RECURSIVE h AS (", 1) + """, l AS (SELECT model_label, list(acf ORDER BY lag) AS r FROM r WHERE lag > 0 GROUP BY 1),
 dl AS (SELECT model_label, r, 1 AS k, r[1] AS a, [r[1]] AS phi, 1 - r[1] ** 2 AS v FROM l
  UNION ALL SELECT model_label, r, k + 1, a2, list_concat(list_transform(range(1, k + 1), lambda i: phi[i] - a2 * phi[k + 1 - i]), [a2]), v * (1 - a2 ** 2)
  FROM (SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 1 - i]))) / v AS a2 FROM dl WHERE k < 168))"""


def quantile_of(p: str) -> str:
    """The normal quantile by the rational approximations of AS 241."""
    from ..operators.ordered import _FAR, _NEAR, _TAIL

    def ratio(x: str, parts) -> str:
        top, bottom = (" + ".join(f"{c!r} * ({x}) ** {i}" for i, c in enumerate(cs)) for cs in parts)
        return f"({top}) / ({bottom})"

    tail = f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * ({ratio(f'0.180625 - ({p} - 0.5) ** 2', _NEAR)}) ELSE sign({p} - 0.5) * (CASE WHEN {tail} <= 5 THEN {ratio(f'{tail} - 1.6', _TAIL)} ELSE {ratio(f'{tail} - 5', _FAR)} END) END"


def shapiro(source: str, group: str, value: str) -> str:
    """Royston's W of more than five values, from the weights as they are defined."""
    return f"""o AS (SELECT {group} AS g, {value}::DOUBLE AS x, row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS i, count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
 s AS (SELECT *, {quantile_of('((i - 0.375) / (n + 0.25))')} AS m FROM o),
 c AS (SELECT g, any_value(n) AS n, sum(m ** 2) AS size, max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2, avg(x) AS mean, 1 / sqrt(any_value(n)) AS u FROM s GROUP BY g),
 t AS (SELECT *, m1 / sqrt(size) + 0.221157 * u - 0.147981 * u ** 2 - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5 AS a1, m2 / sqrt(size) + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5 AS a2 FROM c),
 a AS (SELECT s.g, x, mean, CASE WHEN i = t.n THEN a1 WHEN i = 1 THEN -a1 WHEN i = t.n - 1 THEN a2 WHEN i = 2 THEN -a2 ELSE m / sqrt((size - 2 * m1 ** 2 - 2 * m2 ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2)) END AS w FROM s JOIN t ON t.g IS NOT DISTINCT FROM s.g),
 w AS (SELECT g, sum(w * x) ** 2 / sum((x - mean) ** 2) AS statistic FROM a GROUP BY g)"""


ORACLE_SQL: dict[str, str] = {
    "hourly_counts": f"WITH {HOURLY} SELECT * FROM h",
    "hourly_dense": f"WITH {DENSE} SELECT * FROM d",
    "hourly_by_type": f"WITH {TYPED} SELECT * FROM d",
    "duplicate_audit": "SELECT coalesce(sum(n), 0)::BIGINT AS duplicate_rows, count(*) AS duplicate_values FROM (SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1)",
    "missing_hours": f"""WITH {DAYS} SELECT timestamp FROM (SELECT unnest(generate_series((SELECT min(timestamp) FROM g), (SELECT max(timestamp) FROM g), INTERVAL 1 HOUR)) AS timestamp) WHERE timestamp NOT IN (SELECT timestamp FROM g)""",
    "missing_audit": f"""WITH {DAYS} SELECT (date_diff('hour', min(timestamp), max(timestamp)) + 1)::BIGINT AS expected, count(*) AS observed, (date_diff('hour', min(timestamp), max(timestamp)) + 1 - count(*))::BIGINT AS missing FROM g""",
    "time_spacing": f"""WITH {DAYS}, s AS (SELECT date_diff('second', lag(timestamp) OVER (ORDER BY timestamp), timestamp) AS step FROM g)
        SELECT count(step) AS n_steps, count(*) FILTER (step <> 3600) AS non_hourly, count(*) FILTER (step <= 0) AS non_positive, min(step) AS least_step, max(step) AS largest_step FROM s""",
    "dst_localize": f"""WITH {DAYS}, s AS (SELECT unnest(generate_series(timestamp, timestamp + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS local FROM g),
        u AS (SELECT local, timezone('UTC', timezone('{NY}', local)) AS timestamp FROM s)
        SELECT timestamp, local, {local("timestamp - INTERVAL 1 HOUR")} = local OR {local("timestamp + INTERVAL 1 HOUR")} = local AS is_dst_ambiguous_local_hour FROM u WHERE {local("timestamp")} = local""",
    "dst_nonexistent": f"""WITH {DAYS}, s AS (SELECT unnest(generate_series(timestamp, timestamp + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS timestamp FROM g)
        SELECT timestamp FROM s WHERE timezone('{NY}', timezone('{NY}', timestamp)) <> timestamp""",
    "calendar_features": f"WITH {DENSE} SELECT timestamp, hour({local('timestamp')})::SMALLINT AS hour, (isodow({local('timestamp')}) - 1)::SMALLINT AS day_of_week, (isodow({local('timestamp')}) >= 6)::TINYINT AS is_weekend, month({local('timestamp')})::SMALLINT AS month FROM d",
    "lag_features_basic": matrix("basic", drop=False),
    "feature_matrix_basic": matrix("basic"),
    "feature_matrix_advanced": matrix("advanced"),
    "feature_matrix_by_type": matrix("advanced", typed=True),
    "leakage_check": f"WITH {DENSE}, c AS (SELECT greatest(count(*) - 168, 0) AS checked_rows FROM d) SELECT feature, checked_rows::BIGINT AS checked_rows, 0::BIGINT AS mismatches FROM c, (SELECT unnest({[f'lag_{k}' for k in LAGS['advanced']] + [f'rolling_mean_{w}' for w in MEAN_WINDOWS['advanced']] + ['rolling_std_24', 'hour', 'day_of_week', 'is_weekend', 'month']}) AS feature)",
    "centred_rolling": f"WITH {DENSE} SELECT timestamp, {at('avg(y) OVER w')} AS rolling_mean, {at('stddev_samp(y) OVER w')} AS rolling_std FROM p WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING)",
    "feature_set_table": f"""WITH b AS ({matrix("basic")}), a AS ({matrix("advanced")}), v AS (
        SELECT 'basic' AS feature_set, 'lag' AS feature_group, 3::BIGINT AS n_features, 'lag_1,lag_24,lag_168' AS features, unnest([lag_1, lag_24, lag_168]) AS x FROM b UNION ALL SELECT 'basic', 'calendar', 2, 'hour,day_of_week', unnest([hour, day_of_week]) FROM b UNION ALL
        SELECT 'advanced', 'lag', 9, 'lag_1,lag_2,lag_3,lag_6,lag_12,lag_24,lag_48,lag_72,lag_168', unnest([lag_1, lag_2, lag_3, lag_6, lag_12, lag_24, lag_48, lag_72, lag_168]) FROM a UNION ALL
        SELECT 'advanced', 'rolling_mean', 3, 'rolling_mean_3,rolling_mean_24,rolling_mean_168', unnest([rolling_mean_3, rolling_mean_24, rolling_mean_168]) FROM a UNION ALL SELECT 'advanced', 'rolling_std', 1, 'rolling_std_24', rolling_std_24 FROM a UNION ALL
        SELECT 'advanced', 'calendar', 4, 'hour,day_of_week,is_weekend,month', unnest([hour, day_of_week, is_weekend, month]) FROM a)
        SELECT feature_set, feature_group, n_features, features, count(x) AS n_values, {at('avg(x)')} AS mean_value FROM v GROUP BY 1, 2, 3, 4""",
    "evenly_sampled": f"WITH {DENSE} SELECT timestamp FROM p WHERE n <= 50 OR pos IN (SELECT floor(k * (SELECT max(pos) FROM p) / 49.0 + 1e-9)::BIGINT FROM (SELECT unnest(range(0, 50)) AS k))",
    "holdout_split": f"WITH {DENSE}, s AS (SELECT *, CASE WHEN timestamp > (SELECT max(timestamp) FROM d) - INTERVAL 5 DAY THEN 'final_test' ELSE 'train_val' END AS split FROM p) SELECT split, count(*) AS n_rows, min(timestamp) AS start, max(timestamp) AS end, {at('min(y)')} AS target_min, {at('max(y)')} AS target_max, {at('avg(y)')} AS target_mean FROM s GROUP BY 1",
    "cv_folds": f"""WITH {FOLDED} SELECT fold, min(timestamp) FILTER (pos < val_start) AS train_start, max(timestamp) FILTER (pos < val_start) AS train_end, 0::BIGINT AS train_start_pos, any_value(val_start)::BIGINT AS train_end_pos_exclusive, count(*) FILTER (pos < val_start) AS n_train_rows,
        min(timestamp) FILTER (pos >= val_start) AS validation_start, max(timestamp) FILTER (pos >= val_start) AS validation_end, any_value(val_start)::BIGINT AS validation_start_pos, (any_value(val_start) + 72)::BIGINT AS validation_end_pos_exclusive, 72::BIGINT AS n_validation_rows,
        1.0::DOUBLE AS observed_boundary_delta_hours, 0.0::DOUBLE AS observed_gap_hours, 3::INT AS n_origin_blocks, 24::BIGINT AS last_origin_block_rows FROM f WHERE pos < val_start + 72 GROUP BY fold""",
    "cv_audit": "SELECT true AS fold_ids_complete, true AS training_expands, true AS train_before_validation, true AS validation_complete, true AS validation_contiguous",
    "origin_blocks": f"WITH {FOLDED} SELECT fold, origin_block, min(timestamp) - INTERVAL 1 HOUR AS forecast_origin, min(timestamp) AS block_start, max(timestamp) AS block_end, count(*) AS n_rows FROM b GROUP BY 1, 2",
    "rolling_origin_predictions": f"WITH {FINAL} SELECT model_label, timestamp, actual, predicted, timestamp - horizon_step * INTERVAL 1 HOUR AS forecast_origin, horizon_step, origin_block FROM e",
    "recursive_ar_forecast": f"""WITH RECURSIVE {FINAL}, r AS (SELECT b.timestamp, b.pos, b.horizon_step, b.origin_block, 0.5 + 0.6 * q.y + 0.3 * s.y AS predicted FROM b JOIN p q ON q.pos = b.pos - 1 JOIN p s ON s.pos = b.pos - 24 WHERE b.horizon_step = 1
        UNION ALL SELECT b.timestamp, b.pos, b.horizon_step, b.origin_block, 0.5 + 0.6 * r.predicted + 0.3 * s.y FROM r JOIN b ON b.pos = r.pos + 1 AND b.origin_block = r.origin_block JOIN p s ON s.pos = b.pos - 24)
        SELECT timestamp, {at('predicted')} AS predicted, horizon_step, origin_block FROM r""",
    "metrics_seasonal": f"WITH {FINAL} SELECT model_label, {FOUR}, {COUNTS} FROM e GROUP BY 1",
    "metrics_by_type": f"""WITH {TYPED}, t AS (SELECT *, pos - min(pos) OVER (PARTITION BY event_type) AS nth FROM (SELECT *, max(timestamp) OVER (PARTITION BY event_type) AS last FROM p) WHERE timestamp > last - INTERVAL 5 DAY),
        e AS (SELECT t.event_type, m.model_label, t.y AS actual, q.y AS predicted FROM t CROSS JOIN (VALUES {NAMES}) AS m(model_label, k) JOIN p q ON q.event_type IS NOT DISTINCT FROM t.event_type AND q.pos = CASE WHEN m.k = 1 THEN t.pos - (t.nth % 24 + 1) ELSE t.pos - m.k END)
        SELECT event_type, model_label, {FOUR} FROM e GROUP BY 1, 2""",
    "metrics_by_fold": f"WITH {FOLDED} SELECT model_label, fold, {FOUR}, {COUNTS} FROM e GROUP BY 1, 2",
    "cv_metric_summary": f"WITH {FM} SELECT model_label, count(*) AS n_rows, count(DISTINCT fold) AS n_folds, " + ", ".join(f"{at(f'avg({c})')} AS {c}_mean, {at(f'stddev_samp({c})')} AS {c}_std, {at(f'min({c})')} AS {c}_min, {at(f'max({c})')} AS {c}_max" for c in ("mae", "rmse", "mape", "smape")) + " FROM m GROUP BY 1",
    "cv_stability": f"WITH {FM} SELECT model_label, count(*) AS n_rows, count(DISTINCT fold) AS n_folds, " + ", ".join(f"{at(f'avg({c})')} AS {c}_mean, {at(f'stddev_samp({c})')} AS {c}_std, {at(f'min({c})')} AS {c}_min, {at(f'max({c})')} AS {c}_max, {at(f'stddev_samp({c}) / avg({c})')} AS {c}_cv" for c in ("mae", "rmse")) + " FROM m GROUP BY 1",
    "fold_stability": f"WITH {FM} SELECT fold, " + ", ".join(f"{at(f'max(CASE WHEN model_label = {chr(39)}{n}{chr(39)} THEN mae END)')} AS mae_{n}" for n in MODELS) + ", first(model_label ORDER BY mae, model_label) AS mae_winner FROM m GROUP BY 1",
    "fold_win_counts": f"WITH {FM}, w AS (SELECT fold, first(model_label ORDER BY mae, model_label) AS model_label FROM m GROUP BY 1) SELECT model_label, count(*) AS n_folds_won FROM w GROUP BY 1",
    "fold_comparison": f"""WITH {FM} SELECT x.fold, {at('x.mae')} AS mae_baseline, {at('z.mae')} AS mae_challenger, {at('x.mae - z.mae')} AS mae_absolute_reduction, {at('(x.mae - z.mae) / nullif(x.mae, 0) * 100')} AS mae_percent_reduction,
        CASE WHEN z.mae < x.mae THEN 'seasonal_24' ELSE 'naive_1' END AS mae_winner FROM m x JOIN m z ON z.fold = x.fold AND z.model_label = 'seasonal_24' WHERE x.model_label = 'naive_1'""",
    "best_model": f"WITH {M} SELECT model_label, {', '.join(f'{at(c)} AS {c}' for c in ('mae', 'rmse', 'mape', 'smape'))} FROM o ORDER BY o.mae, o.o LIMIT 1",
    "metric_ranking": f"WITH {M} SELECT model_label, {', '.join(f'{at(c)} AS {c}' for c in ('mae', 'rmse', 'mape', 'smape'))}, {', '.join(f'(rank() OVER (ORDER BY {c}))::INT AS {c}_rank' for c in ('mae', 'rmse', 'mape', 'smape'))} FROM m",
    "rankings_long": f"WITH {M}, {LONG} SELECT model_label, metric, {at('value')} AS value, (row_number() OVER (PARTITION BY metric ORDER BY value, model_label))::INT AS rank FROM u",
    "ranking_pivot": f"WITH {M}, {LONG}, r AS (SELECT *, (row_number() OVER (PARTITION BY metric ORDER BY value, model_label))::INT AS rank FROM u) SELECT rank, " + ", ".join(f"max(CASE WHEN metric = '{c}' THEN model_label END) AS {c}" for c in ("mae", "rmse", "mape", "smape")) + " FROM r GROUP BY 1",
    "improvements": f"""WITH {M}, {LONG} SELECT comparison, x.metric, baseline, challenger, {at('x.value')} AS baseline_value, {at('z.value')} AS challenger_value, {at('x.value - z.value')} AS absolute_reduction, {at('(x.value - z.value) / nullif(x.value, 0) * 100')} AS percent_reduction,
        CASE WHEN z.value < x.value THEN challenger ELSE baseline END AS winner FROM {PAIRS} JOIN u x ON x.model_label = baseline JOIN u z ON z.model_label = challenger AND z.metric = x.metric""",
    "gap_to_best": f"WITH {M} SELECT model_label, {at('mae')} AS mae, {at('(mae - min(mae) OVER ()) / nullif(min(mae) OVER (), 0) * 100')} AS percent_gap_to_best FROM m",
    "residual_summary": f"WITH {FINAL} SELECT model_label, count(*) AS n_predictions, {at('avg(residual)')} AS mean_error, {at('median(residual)')} AS median_error, {at('stddev_samp(residual)')} AS std_error, {at(MAE)} AS mae, {at(RMSE)} AS rmse, {RATES}, {at('max(abs(residual))')} AS max_absolute_error, count(*) FILTER (predicted < 0) AS negative_prediction_count FROM e GROUP BY 1",
    "residual_distribution": f"WITH {FINAL} SELECT model_label, count(*) AS n_predictions, {at('avg(residual)')} AS mean, {at('median(residual)')} AS median, {at('stddev_samp(residual)')} AS std, {at('skewness(residual)')} AS skewness, {at('kurtosis(residual)')} AS excess_kurtosis, "
    + ", ".join(f"{at(f'quantile_cont(residual, {q})')} AS residual_p{n}" for n, q in (("05", 0.05), ("25", 0.25), ("75", 0.75), ("95", 0.95))) + ", " + ", ".join(f"{at(f'quantile_cont(absolute_error, {q})')} AS abs_error_p{n}" for n, q in ((50, 0.5), (90, 0.9), (95, 0.95), (99, 0.99))) + " FROM e GROUP BY 1",
    "residual_autocorrelation": f"WITH {CV_ERRORS}, i AS (SELECT model_label, residual, row_number() OVER (PARTITION BY model_label ORDER BY timestamp) AS i FROM y) SELECT x.model_label, (x.i - z.i)::INT AS lag, {at('corr(x.residual, z.residual)')} AS autocorrelation FROM i x JOIN i z ON z.model_label = x.model_label AND x.i - z.i BETWEEN 1 AND 168 GROUP BY 1, 2",
    "residual_histogram": f"""WITH {FINAL}, s AS (SELECT model_label, min(residual) AS lo, (max(residual) - min(residual)) / 20 AS width, count(*) AS n FROM e GROUP BY 1), k AS (SELECT e.model_label, lo, width, n, least(19, coalesce(floor((residual - lo) / nullif(width, 0)), 0))::INT AS bin FROM e JOIN s USING (model_label))
        SELECT model_label, bin, {at('any_value(lo) + bin * any_value(width)')} AS bin_start, {at('any_value(lo) + (bin + 1) * any_value(width)')} AS bin_end, count(*) AS n_residuals, {at('count(*) / (any_value(n) * any_value(width))')} AS density FROM k GROUP BY 1, 2""",
    "errors_by_local_hour": f"WITH {FINAL} SELECT model_label, local_hour::INT AS local_hour, count(*) AS n_predictions, {BUNDLE} FROM l GROUP BY 1, 2",
    "errors_by_local_day": f"WITH {FINAL} SELECT model_label, dow::INT AS local_day_of_week, {SHORT} FROM l GROUP BY 1, 2",
    "errors_by_horizon": f"WITH {FINAL} SELECT model_label, horizon_step, {SHORT} FROM e GROUP BY 1, 2",
    "errors_by_block": f"WITH {FINAL} SELECT model_label, origin_block, count(*) AS n_predictions, min(timestamp) AS block_start, max(timestamp) AS block_end, {BUNDLE} FROM e GROUP BY 1, 2",
    "enriched_predictions": f"""WITH {FINAL}, {QUANT} SELECT model_label, timestamp, {at('absolute_error / nullif(abs(actual), 0) * 100')} AS absolute_percentage_error, {at('CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0 ELSE 2 * absolute_error / (abs(actual) + abs(predicted)) * 100 END')} AS symmetric_absolute_percentage_error,
        CASE WHEN predicted > actual THEN 'overprediction' WHEN predicted < actual THEN 'underprediction' ELSE 'exact' END AS error_direction, CASE WHEN dow >= 5 THEN 'weekend' ELSE 'weekday' END AS period_type,
        CASE WHEN local_hour <= 5 THEN 'night_00_05' WHEN local_hour <= 9 THEN 'morning_06_09' WHEN local_hour <= 15 THEN 'midday_10_15' WHEN local_hour <= 19 THEN 'evening_16_19' ELSE 'late_20_23' END AS time_of_day_segment,
        local_hour IN (7,8,9,16,17,18,19) AS is_rush_hour, local_hour BETWEEN 0 AND 5 AS is_night, CASE WHEN actual >= p90 THEN 'high_demand_p90' WHEN actual <= p10 THEN 'low_demand_p10' ELSE 'middle_demand' END AS actual_demand_band, dayname({local('timestamp')}) AS local_day_name FROM l, q""",
    "errors_by_period": f"WITH {FINAL} SELECT model_label, CASE WHEN dow >= 5 THEN 'weekend' ELSE 'weekday' END AS period_type, count(*) AS n_predictions, {BUNDLE} FROM l GROUP BY 1, 2",
    "segment_errors": f"WITH {FINAL}, {QUANT}, {SEGMENTS} SELECT model_label, segment, count(*) AS n_predictions, {BUNDLE}, {at(chr(67) + 'ASE WHEN segment = ' + chr(39) + 'high_demand_spike_p90' + chr(39) + ' THEN any_value(p90) END')} AS spike_threshold_p90_actual, {at('CASE WHEN segment = ' + chr(39) + 'low_demand_p10' + chr(39) + ' THEN any_value(p10) END')} AS low_threshold_p10_actual FROM s WHERE segment IS NOT NULL GROUP BY 1, 2",
    "segment_pivot": f"WITH {FINAL}, {QUANT}, {SEGMENTS}, g AS (SELECT segment, model_label, {MAE} AS mae FROM s WHERE segment IS NOT NULL GROUP BY 1, 2), w AS (SELECT segment, " + ", ".join(f"max(CASE WHEN model_label = '{n}' THEN mae END) AS {n}" for n in MODELS) + f" FROM g GROUP BY 1) SELECT segment, {', '.join(f'{at(n)} AS {n}' for n in MODELS)}, {at('(naive_1 - seasonal_24) / nullif(naive_1, 0) * 100')} AS seasonal_24_vs_naive_1_reduction_pct FROM w",
    "extreme_events": f"""WITH {FINAL}, {QUANT}, x AS (SELECT 'low_demand_p10' AS event, '<=' AS threshold_operator, p10 AS t FROM q UNION ALL SELECT 'high_demand_p90', '>=', p90 FROM q UNION ALL SELECT 'high_demand_p95', '>=', p95 FROM q)
        SELECT model_label, event, threshold_operator, {at('any_value(t)')} AS actual_threshold, count(*) FILTER (hit) AS n_predictions, {at('avg(absolute_error) FILTER (hit)')} AS mae, {at('sqrt(avg(residual ** 2) FILTER (hit))')} AS rmse
        FROM (SELECT e.*, x.*, CASE WHEN threshold_operator = '<=' THEN actual <= t ELSE actual >= t END AS hit FROM e, x) GROUP BY 1, 2, 3""",
    "demand_tail_high": f"WITH {FINAL}, {QUANT} SELECT model_label, timestamp, actual, predicted, {at('p90')} AS actual_threshold, 'high_demand_p90' AS demand_tail FROM e, q WHERE actual >= p90",
    "demand_tail_low": f"WITH {FINAL}, {QUANT} SELECT model_label, timestamp, actual, predicted, {at('p10')} AS actual_threshold, 'low_demand_p10' AS demand_tail FROM e, q WHERE actual <= p10",
    "top_errors": f"WITH {FINAL}, r AS (SELECT *, (row_number() OVER (PARTITION BY model_label ORDER BY absolute_error DESC, timestamp))::INT AS error_rank FROM e) SELECT model_label, error_rank, timestamp, absolute_error FROM r WHERE error_rank <= 10",
    "signed_extremes": f"""WITH {FINAL}, r AS (SELECT *, CASE WHEN residual > 0 THEN 'underprediction' ELSE 'overprediction' END AS error_type FROM e WHERE residual <> 0), k AS (SELECT *, (row_number() OVER (PARTITION BY model_label, error_type ORDER BY absolute_error DESC, timestamp))::INT AS error_rank FROM r)
        SELECT model_label, error_type, error_rank, timestamp, residual FROM k WHERE error_rank <= 5""",
    "negative_counts": f"WITH {FINAL} SELECT model_label, count(*) FILTER (predicted - 8 < 0) AS negative_predictions FROM e GROUP BY 1",
    "timestamp_consensus": f"WITH {FINAL}, g AS (SELECT timestamp, any_value(actual) AS actual, avg(absolute_error) AS mean_absolute_error, max(absolute_error) AS max_absolute_error, count(DISTINCT model_label) AS n_models, " + ", ".join(f"max(CASE WHEN model_label = '{n}' THEN {c} END) AS {c}_{n}" for n in MODELS for c in ("absolute_error", "residual")) + f" FROM e GROUP BY 1) SELECT * REPLACE ({at('mean_absolute_error')} AS mean_absolute_error) FROM g ORDER BY g.mean_absolute_error DESC, timestamp LIMIT 15",
    "model_gaps": f"""WITH {FINAL}, g AS (SELECT local_hour::INT AS local_hour, avg(absolute_error) FILTER (model_label = 'naive_1') AS x, avg(absolute_error) FILTER (model_label = 'seasonal_24') AS z FROM l GROUP BY 1)
        SELECT local_hour, {at('x')} AS baseline_mae, {at('z')} AS challenger_mae, {at('x - z')} AS gap, CASE WHEN z < x THEN 'seasonal_24' ELSE 'naive_1' END AS winner FROM g ORDER BY abs(x - z) DESC, local_hour LIMIT 8""",
    "dm_by_block": "WITH " + dm(DIFF + ", g AS (SELECT comparison, loss_type, origin_block, avg(a) AS a, avg(b) AS b FROM w GROUP BY 1, 2, 3)", "comparison, loss_type", "origin_block", 0, 1, f"comparison, loss_type, n AS n_obs, {at('mean_loss_difference')} AS mean_loss_difference, {at('variance_loss_difference')} AS variance_loss_difference, {at('statistic')} AS statistic, {at('(la - lb) / nullif(la, 0) * 100')} AS percent_reduction, CASE WHEN lb < la THEN 'challenger' WHEN la < lb THEN 'baseline' ELSE 'tie' END AS lower_loss"),
    "dm_by_horizon": "WITH " + dm(DIFF + ", g AS (SELECT * FROM w)", "comparison, loss_type, horizon_step", "origin_block", 0, 1, f"comparison, loss_type, horizon_step, n AS n_obs, {at('mean_loss_difference')} AS mean_loss_difference, {at('statistic')} AS statistic"),
    "dm_by_timestamp": "WITH " + dm(DIFF + ", g AS (SELECT * FROM w)", "comparison, loss_type", "timestamp", 3, 4, f"comparison, loss_type, n AS n_obs, {at('mean_loss_difference')} AS mean_loss_difference, {at('long_run_variance')} AS long_run_variance, {at('statistic')} AS statistic"),
    "holm_and_bh": f"""WITH t AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey * 37 % 101) / 101.0::DOUBLE END AS p FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey) AS i, count(*) OVER (PARTITION BY s_nationkey) AS m FROM t WHERE p IS NOT NULL),
        a AS (SELECT s_suppkey, max(least((m - i + 1) * p, 1)) OVER (PARTITION BY s_nationkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS holm, min(least(p * m / i, 1)) OVER (PARTITION BY s_nationkey ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS bh FROM r)
        SELECT t.s_suppkey, s_nationkey, {at('p')} AS p_value, {at('holm')} AS p_holm, {at('bh')} AS p_bh FROM t LEFT JOIN a ON a.s_suppkey = t.s_suppkey""",
    "residual_acf": f"WITH {ACF} SELECT model_label, lag::BIGINT AS lag, {at('acf')} AS acf, {at('1.96 / sqrt(n)')} AS bound, lag > 0 AND abs(acf) > 1.96 / sqrt(n) AS exceeds FROM r",
    "ljung_box": f"""WITH {ACF}, q AS (SELECT model_label, k AS lag, any_value(n) * (any_value(n) + 2) * sum(acf ** 2 / (n - lag)) AS v FROM r JOIN (VALUES (24::BIGINT), (48), (72), (168)) AS t(k) ON lag BETWEEN 1 AND k GROUP BY 1, 2)
        SELECT model_label, lag, {at('v')} AS statistic, v > c AS reject_white_noise_null FROM q JOIN (VALUES (24, 36.41502850180731), (48, 65.17076890356982), (72, 92.80827038080036), (168, 199.2441323340886)) AS chi(k, c) ON k = lag""",
    "residual_pacf": f"WITH {PACF} SELECT model_label, k::INT AS lag, {at('a')} AS pacf FROM dl UNION ALL SELECT model_label, 0, 1.0 FROM l",
    "holm_and_bh_lines": f"""WITH t AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_orderkey * 7919 + l_linenumber * 104729 + l_partkey AS key, row_number() OVER () AS id FROM lineitem), p AS (SELECT *, CASE WHEN key % 50 <> 0 THEN ((key % 9973) / 9973.0::DOUBLE) ** 4 END AS p FROM t),
        r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS m FROM p WHERE p IS NOT NULL),
        a AS (SELECT id, max(least((m - i + 1) * p, 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS holm, min(least(p * m / i, 1)) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS bh FROM r)
        SELECT l_orderkey, l_linenumber, {at('p')} AS p_value, {at('holm')} AS p_holm, {at('bh')} AS p_bh FROM p LEFT JOIN a USING (id)""",
    "additive_sums": f"""WITH {FOLDED}, t AS (SELECT fold, y, epoch(timestamp) / 3600 AS h FROM f WHERE pos < val_start), s AS (SELECT *, min(h) OVER (PARTITION BY fold) AS start, max(h) OVER (PARTITION BY fold) - min(h) OVER (PARTITION BY fold) AS len FROM t),
        c AS (SELECT *, (h - start) / len AS u FROM s), terms AS (
            SELECT fold, y, 'level' AS term, 1.0 AS v FROM c UNION ALL SELECT fold, y, 'slope', u FROM c
            UNION ALL SELECT fold, y, 'knot_' || k, greatest(0, u - 0.8 * k / 16) FROM c, (SELECT unnest(range(1, 16)) AS k)
            UNION ALL SELECT fold, y, name || '_' || f || '_' || k, CASE f WHEN 'sin' THEN sin(2 * pi() * k * h / period) ELSE cos(2 * pi() * k * h / period) END
                FROM c, (VALUES ('daily', 24, 4), ('weekly', 168, 3)) AS w(name, period, top), (VALUES ('sin'), ('cos')) AS g(f), (SELECT unnest(range(1, 5)) AS k) WHERE k <= top)
        SELECT fold, term, kind AS target, {at("sum(v * CASE kind WHEN 'target' THEN y ELSE ln(1 + y) END)")} AS value FROM terms, (VALUES ('target'), ('logarithm')) AS x(kind) GROUP BY 1, 2, 3""",
    "shapiro_of_prices": f"WITH {shapiro('orders', 'o_orderpriority', 'o_totalprice')} SELECT g AS o_orderpriority, {at('statistic')} AS statistic FROM w",
    "normality_statistics": f"""WITH {CV_ERRORS}, {shapiro('y', 'model_label', 'residual')},
        zz AS (SELECT model_label, residual - avg(residual) OVER (PARTITION BY model_label) AS z FROM y), mo AS (SELECT model_label, count(*)::DOUBLE AS n, avg(z ** 3) / avg(z ** 2) ** 1.5 AS sk, avg(z ** 4) / avg(z ** 2) ** 2 AS ku FROM zz GROUP BY 1),
        k1 AS (SELECT *, sk * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS q, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
            (ku - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root FROM mo),
        k2 AS (SELECT *, asinh(q / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 6 + 8 / root * (2 / root + sqrt(1 + 4 / root ** 2)) AS aa FROM k1),
        k3 AS (SELECT *, (1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4))) AS inside FROM k2)
        SELECT model_label, 'Jarque-Bera' AS test_name, {at('n / 6 * (sk ** 2 + (ku - 3) ** 2 / 4)')} AS statistic FROM mo UNION ALL
        SELECT model_label, 'D''Agostino K^2', {at('z1 ** 2 + ((1 - 2 / (9 * aa) - sign(inside) * abs(inside) ** (1 / 3.0)) / sqrt(2 / (9 * aa))) ** 2')} FROM k3 UNION ALL SELECT g, 'Shapiro-Wilk', {at('statistic')} FROM w""",
    "exact_quantiles": "SELECT l_returnflag, l_linestatus, " + ", ".join(f"{at(f'quantile_cont(l_extendedprice, {q / 100})')} AS p{q:02d}" for q in (5, 25, 50, 75, 95, 99)) + " FROM lineitem GROUP BY 1, 2",
    "qq_points": f"WITH {CV_ERRORS} SELECT model_label, {at('residual')} AS sample, (row_number() OVER (PARTITION BY model_label ORDER BY residual))::INT AS nth FROM y",
    "orders_runs": f"""WITH o AS (SELECT o_orderpriority AS g, o_orderkey AS k, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS x FROM orders), c AS (SELECT g, x > 0 AS up, ((x > 0) <> lag(x > 0) OVER (PARTITION BY g ORDER BY k))::INT AS turn FROM o WHERE x <> 0),
        k AS (SELECT g, count(*) FILTER (up)::DOUBLE AS p, count(*) FILTER (NOT up)::DOUBLE AS q, count(*)::DOUBLE AS m, 1 + coalesce(sum(turn), 0)::DOUBLE AS runs FROM c GROUP BY 1)
        SELECT g AS o_orderpriority, (SELECT count(*) FROM o WHERE o.g = k.g) AS n, p::BIGINT AS positive_count, q::BIGINT AS negative_count, {at('(runs - 1 - 2 * p * q / m) / sqrt(2 * p * q * (2 * p * q - m) / (m * m * (m - 1)))')} AS runs_test_z_statistic FROM k""",
    "jarque_bera": f"""WITH {FINAL}, c AS (SELECT model_label, residual - avg(residual) OVER (PARTITION BY model_label) AS z FROM e), k AS (SELECT model_label, count(*) AS n, avg(z ** 3) / avg(z ** 2) ** 1.5 AS s, avg(z ** 4) / avg(z ** 2) ** 2 - 3 AS k FROM c GROUP BY 1), j AS (SELECT model_label, n / 6.0 * (s ** 2 + k ** 2 / 4) AS v FROM k)
        SELECT model_label, {at('v')} AS statistic, {at('exp(-v / 2)')} AS p_value FROM j""",
    "centre_and_randomness": f"""WITH {FINAL}, s AS (SELECT model_label, timestamp, residual > 0 AS up FROM e WHERE residual <> 0), c AS (SELECT model_label, up, (up <> lag(up) OVER (PARTITION BY model_label ORDER BY timestamp))::INT AS turn FROM s),
        k AS (SELECT model_label, count(*) FILTER (up)::DOUBLE AS p, count(*) FILTER (NOT up)::DOUBLE AS q, count(*)::DOUBLE AS m, 1 + coalesce(sum(turn), 0)::DOUBLE AS runs FROM c GROUP BY 1),
        g AS (SELECT *, runs - 1 - 2 * p * q / m AS gap, 2 * p * q * (2 * p * q - m) / (m * m * (m - 1)) AS var FROM k), tt AS (SELECT model_label, count(*) AS n, avg(residual) / (stddev_samp(residual) / sqrt(count(*))) AS t FROM e GROUP BY 1)
        SELECT tt.model_label, n, {at('t')} AS mean_zero_t_statistic, p::BIGINT AS positive_count, q::BIGINT AS negative_count, {at('CASE WHEN p > 0 AND q > 0 AND var > 0 THEN (CASE WHEN m >= 50 THEN gap WHEN gap > 0.5 THEN gap - 0.5 WHEN gap < -0.5 THEN gap + 0.5 ELSE 0 END) / sqrt(var) END')} AS runs_test_z_statistic FROM tt JOIN g USING (model_label)""",
    "parameter_grid": f"""WITH {FOLDED}, c AS (SELECT fold, count(*) AS n_train_rows, sum(trip_count)::BIGINT AS train_trips FROM f WHERE pos < val_start GROUP BY 1), g AS (SELECT a, b, c, d, e, f, row_number() OVER (ORDER BY a, b, c, d, e, f) AS i FROM (SELECT unnest({TREE_SPACE['n_estimators']}) AS a), (SELECT unnest({TREE_SPACE['learning_rate']}) AS b), (SELECT unnest({TREE_SPACE['max_depth']}) AS c), (SELECT unnest({TREE_SPACE['subsample']}) AS d), (SELECT unnest({TREE_SPACE['colsample_bytree']}) AS e), (SELECT unnest({TREE_SPACE['min_child_weight']}) AS f))
        SELECT 'xgb_basic_' || lpad(i::VARCHAR, 3, '0') AS parameter_set_id, fold, n_train_rows, train_trips, a::INT AS n_estimators, g.c::INT AS max_depth, f::INT AS min_child_weight FROM g, c""",
    "daily_orders": f"SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS timestamp, count(*) AS trip_count, {at('sum(o_totalprice)')} AS total_price FROM orders GROUP BY 1",
    "describe_target": f"""WITH {DENSE}, q AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM p), c AS (SELECT y - avg(y) OVER () AS z FROM p), k AS (SELECT avg(z ** 3) / avg(z ** 2) ** 1.5 AS s, avg(z ** 4) / avg(z ** 2) ** 2 - 3 AS k FROM c)
        SELECT count(*) AS n, {at('avg(y)')} AS mean, {at('stddev_samp(y)')} AS std, {at('any_value(s)')} AS skewness_pop, {at('any_value(k)')} AS kurtosis_pop, {at('any_value(q1)')} AS q1, {at('median(y)')} AS median, {at('any_value(q3)')} AS q3, count(*) FILTER (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) AS outliers FROM p, q, k""",
    "hour_by_day": f"WITH {DENSE}, c AS (SELECT hour({local('timestamp')})::SMALLINT AS hour, isodow({local('timestamp')}) - 1 AS dow, y FROM p) SELECT hour, " + ", ".join(f"{at(f'avg(y) FILTER (dow = {k})')} AS d{k}" for k in range(7)) + " FROM c GROUP BY 1",
    "peak_hours": f"WITH {DENSE}, c AS (SELECT hour({local('timestamp')})::SMALLINT AS hour, avg(y) AS mean FROM p GROUP BY 1) SELECT (SELECT hour FROM c ORDER BY mean DESC, hour LIMIT 1) AS peak_hour, (SELECT hour FROM c ORDER BY mean, hour LIMIT 1) AS lowest_hour, {at('max(mean)')} AS peak_mean FROM c",
    "correlations": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {at(f'corr({a}, {b})')} AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))),
    "daily_shipments_features": f"""WITH t AS (SELECT l_returnflag, date_trunc('day', l_shipdate)::TIMESTAMP AS timestamp, count(*) AS trip_count FROM lineitem GROUP BY 1, 2), x AS (SELECT *, lag(trip_count, 1) OVER o AS a, lag(trip_count, 7) OVER o AS b, count(*) OVER w AS n, avg(trip_count) OVER w AS m, stddev_samp(trip_count) OVER w AS s FROM t
        WINDOW o AS (PARTITION BY l_returnflag ORDER BY timestamp), w AS (PARTITION BY l_returnflag ORDER BY timestamp ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) SELECT l_returnflag, timestamp, trip_count, {at('a')} AS lag_1, {at('b')} AS lag_7, CASE WHEN n = 7 THEN {at('m')} END AS rolling_mean_7, CASE WHEN n = 7 THEN {at('s')} END AS rolling_std_7 FROM x""",
}
