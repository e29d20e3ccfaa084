"""Edge rules on small inputs, and properties."""

import math
import pickle
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import PROPHET_SPACE, SarimaSettings, Settings, feature_columns, feature_set, required_history, whole_number
from tidemark.functions import tails
from tidemark.functions.metrics import close, compare_with_nulls, corrected_kurtosis, corrected_skewness, cv_summary, grouped_metrics
from tidemark.operators import analysis, comparison, contracts, features, forecast, models, splits, stats, timeaxis
from tidemark.sources import tables, tracking


def hours(spark, values, start="2024-01-01 00:00:00"):
    return spark.createDataFrame(list(enumerate(map(float, values))), "i int, trip_count double").select(F.expr(f"timestamp'{start}' + make_interval(0,0,0,0,i)").alias("timestamp"), "trip_count")


def test_metric_edges(spark):
    df = spark.createDataFrame([("0", "0"), ("0", "5"), ("10", None), ("10", "NaN"), ("4", "5"), ("x", "1")], "actual string, predicted string")
    r = grouped_metrics(df).first()
    assert (r.n_obs, r.n_valid_obs, r.n_invalid_obs, r.mape_valid_count, r.smape_zero_denominator_count) == (6, 3, 3, 1, 1)
    assert r.mape == 25.0 and math.isclose(r.smape, (0 + 2 + 2 / 9) / 3 * 100) and r.mae == 2.0
    assert grouped_metrics(df.filter("actual = '0'")).first().mape is None


def test_null_group_keys_and_single_fold(spark):
    df = spark.createDataFrame([(None, 1, 2.0), ("a", 1, 3.0), ("a", 2, 5.0), ("a", None, 4.0)], "m string, fold int, mae double")
    r = {x.m: x for x in cv_summary(df, ["m"], ["mae"]).collect()}
    assert r[None].mae_std == 0.0 and r["a"].n_folds == 3 and cv_summary(df.filter("m is null"), ["m"], ["mae"], single_std=None).first().mae_std is None


def test_moments(spark):
    r = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.5, 7.0, 11.0)], "x double").agg(corrected_skewness("x").alias("s"), corrected_kurtosis("x").alias("k"), F.percentile("x", F.lit(0.9)).alias("p")).first()
    assert math.isclose(r.s, 1.0140490, abs_tol=1e-6) and math.isclose(r.k, -0.5497702, abs_tol=1e-6) and math.isclose(r.p, 9.4)


def test_daylight_saving(spark):
    local = spark.createDataFrame([("2025-11-02 01:00:00",), ("2025-11-02 00:00:00",), ("2025-11-02 02:00:00",)], "timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    got = {str(r.timestamp_local_naive): (str(r.timestamp), r.is_dst_ambiguous_local_hour) for r in timeaxis.localize(local).collect()}
    assert got["2025-11-02 01:00:00"] == ("2025-11-02 06:00:00", True) and got["2025-11-02 00:00:00"] == ("2025-11-02 04:00:00", False) and not got["2025-11-02 02:00:00"][1]
    spring = spark.createDataFrame([("2025-03-09 02:00:00",)], "timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    with pytest.raises(ValueError, match="2025-03-09 02:00"):
        timeaxis.localize(spring)
    assert timeaxis.localize_dropping(local.union(spring)).filter("timestamp is null").count() == 2
    every = timeaxis.local_hours(spark, "2025-01-01 00:00:00", "2026-03-31 23:00:00").filter(~timeaxis.is_nonexistent(F.col("timestamp")))
    assert every.count() == 10918 and timeaxis.localize(every).select("timestamp").distinct().count() == 10918


def test_prepare_and_audits(spark):
    raw = spark.createDataFrame([("2024-05-01 01:00:00", 3), ("2024-05-01 00:00:00", 2), ("2024-05-01 04:00:00", 1)], "timestamp string, trip_count int")
    s = timeaxis.prepare_series(raw)
    assert [r.trip_count for r in s.collect()] == [2, 3, 1] and timeaxis.rebuilt_mismatches(s).first()[0] == 0
    assert timeaxis.missing_audit(s).first()[:3] == (5, 3, 2) and timeaxis.spacing(s).first().non_hourly == 1
    with pytest.raises(ValueError, match="no timestamps"):
        timeaxis.parse_timestamps(spark.createDataFrame([("oops",)], "timestamp string"))
    with pytest.raises(ValueError, match="more than once"):
        timeaxis.prepare_series(raw.union(raw))
    assert timeaxis.future_index(s, 3).count() == 3


def test_shift_then_roll(spark):
    s = hours(spark, [i * i for i in range(6)])
    r = s.withColumns(features.lag_columns([1]) | features.rolling_columns([3], [3])).orderBy("timestamp").collect()
    assert r[2].rolling_mean_3 is None and math.isclose(r[3].rolling_mean_3, 5 / 3) and math.isclose(r[3].rolling_std_3, 2.0816659994) and r[0].lag_1 is None


def test_features_never_see_their_row(spark):
    rng = random.Random(1)
    values = [rng.randrange(100) for _ in range(200)]
    a = features.feature_matrix(hours(spark, values), "advanced").orderBy("timestamp").collect()
    b = features.feature_matrix(hours(spark, values[:-1] + [10**6]), "advanced").orderBy("timestamp").collect()
    assert len(a) == 200 - required_history() and a[-1][2:] == b[-1][2:] and list(a[0].asDict())[2:] == feature_columns("advanced")


def test_row_lags_span_gaps(spark):
    s = hours(spark, range(30)).filter("trip_count <> 10")
    r = s.withColumns(features.lag_columns([24])).orderBy("timestamp").collect()
    assert r[-1].trip_count == 29 and r[-1].lag_24 == 4


def test_splits(spark):
    s = hours(spark, range(600))
    train, test = splits.holdout(s, 5)
    audit = splits.split_audit(train, test, s, 5).first()
    assert (audit.train_rows, audit.test_rows, audit.overlap, audit.lost_rows) == (480, 120, 0, 0) and audit.ordered and audit.rows_preserved
    rows = splits.cv_rows(s, 3, 50, gap=2)
    meta = splits.fold_metadata(rows, 24, 2)
    m = {r.fold: r for r in meta.collect()}
    assert m[1].n_train_rows == 448 and m[1].n_origin_blocks == 3 and m[1].last_origin_block_rows == 2 and m[3].validation_end_pos_exclusive == 600 and m[2].observed_gap_hours == 2.0
    assert all(splits.cv_audit(meta, 3, 50).first()) and "rolling_origin_blocks" not in splits.flat_metadata(meta).columns
    assert splits.cv_rows(hours(spark, range(200)), 3, 50).count() == 0
    with pytest.raises(ValueError, match="too few"):
        splits.fold_table(spark, 200, 3, 50)
    assert [tuple(r)[1:] for r in splits.fold_table(spark, 600, 3, 50, 2).collect()] == [(448, 450, 500), (498, 500, 550), (548, 550, 600)]


def test_blocks_in_parallel_equal_the_sequential_loop(spark):
    rng = np.random.default_rng(2)
    y = np.abs(rng.normal(50, 10, 400))
    s = hours(spark, y)
    v = splits.cv_rows(s, 1, 50).filter("role = 'validation'")
    got = [r.predicted for r in forecast.closed_form(s, v, "ar", forecast.ar_path(1.0, {1: 0.5, 24: 0.4})).orderBy("timestamp").collect()]
    want, known = [], list(y[:350])
    for start in range(350, 400, 24):
        h = list(known)
        for _ in range(min(24, 400 - start)):
            h.append(1.0 + 0.5 * h[-1] + 0.4 * h[-24])
        want += h[start:]
        known = list(y[: min(start + 24, 400)])
    assert np.allclose(got, want)


def test_fitted_models_in_blocks(spark):
    s = hours(spark, np.abs(np.random.default_rng(3).normal(50, 10, 300)))
    v = splits.cv_rows(s, 1, 48).filter("role = 'validation'")
    p = spark.createDataFrame([(1, "x", pickle.dumps(24))], "fold int, parameter_set_id string, body binary")
    load = lambda body: lambda row: row[1]  # noqa: E731  lag_24 of the basic set
    for actuals in (True, False):
        got = forecast.fitted_predictions(s, v, p, load, "basic", "lag", update_with_actuals=actuals).orderBy("timestamp").collect()
        want = forecast.closed_form(s, v, "seasonal", forecast.naive_path(24)).orderBy("timestamp").collect()
        assert len(got) == 48 and (not actuals or [g.predicted for g in got] == [w.predicted for w in want])
    assert contracts.prediction_contract(spark.createDataFrame(got), v).first().bad_missing_time == 0


def test_contracts(spark):
    bad = spark.createDataFrame([("x",), ("-1",), ("1.5",), ("inf",), (None,)], "trip_count string")
    assert tuple(contracts.target_domain(bad).first()) == (1, 1, 1, 1, 1)
    with pytest.raises(ValueError, match="bad_missing.*bad_fractional"):
        contracts.require(contracts.target_domain(bad))
    s = hours(spark, range(200))
    contracts.require(contracts.series_contract(s))
    contracts.require(contracts.history_contract(s))
    with pytest.raises(ValueError):
        contracts.require(contracts.series_contract(s.union(s)))
    m = features.feature_matrix(s, "basic")
    contracts.require(contracts.matrix_contract(m, "basic"))
    contracts.require(contracts.matrix_inside(m, s))
    contracts.require(contracts.final_scope(*splits.holdout(s, 2)))
    contracts.require(contracts.ordered_equal(s, s))
    contracts.feature_names(feature_columns("basic"), "basic")
    assert contracts.loaded_profile(bad, "trip_count").first().n_rows == 5


def test_config():
    assert feature_set("XGB-Basic") == "basic" and len(feature_columns("advanced")) == 17 and whole_number("3.0", "n") == 3
    for bad in (True, 1.5, -1):
        with pytest.raises((TypeError, ValueError)):
            whole_number(bad, "n")
    with pytest.raises(ValueError):
        Settings(val_horizon=10)
    with pytest.raises(ValueError):
        SarimaSettings(max_train_rows=10)
    assert len(models.parameter_grid(PROPHET_SPACE, "prophet")) == 24 and models.parameter_grid(PROPHET_SPACE, "prophet", 3)[2] == ("prophet_003", {"changepoint_prior_scale": 0.01, "seasonality_prior_scale": 5.0, "seasonality_mode": "additive"})


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([("2024-05-01 01:00:00", 3)], "` Pickup Hour ` string, `Trip Count` int")
    assert tables.standard_columns(raw).columns == ["timestamp", "trip_count"]
    with pytest.raises(ValueError, match="same name"):
        tables.standard_columns(spark.createDataFrame([(1, 2)], "`a b` int, a_b int"))
    for kind in ("csv", "parquet", "json"):
        path = str(tmp_path / kind)
        tables.write(raw, path, kind)
        with pytest.raises(Exception):
            tables.write(raw, path, kind)
        tables.write(raw, path, kind, overwrite=True)
        tables.write(raw, path, kind, append=True)
        assert tables.read(spark, path, kind).count() == 2
    assert tables.read_raw_hourly(spark, str(tmp_path / "csv"), ignoreLeadingWhiteSpace=False).columns == ["timestamp", "trip_count"]
    with pytest.raises(FileExistsError):
        tables.require_absent(spark, [str(tmp_path / "csv")])
    assert tables.read_if_present(spark, str(tmp_path / "none")) is None
    assert tables.markdown(spark.createDataFrame([("a|b", 1.5, None)], "x string, y double, z string"), 2).split("\n")[2] == "| a\\|b | 1.50 |  |"
    assert tables.union_by_name(raw.select("Trip Count"), raw).count() == 2
    s = timeaxis.prepare_series(spark.createDataFrame([("2024-05-01 01:00:00", 3), ("2024-05-01 02:00:00", 4)], "timestamp string, trip_count int"))
    tables.write(s, str(tmp_path / "series"))
    assert tables.read_series(spark, str(tmp_path / "series")).count() == 2 and tables.timestamps_only(spark, str(tmp_path / "series")).columns == ["timestamp"]


def test_tracking(spark, tmp_path):
    record = tracking.runtime_record("x", fold=3, train_time_seconds=float("nan"), odd=1, status=None)
    assert record["fold"] == "3" and record["train_time_seconds"] == "" and record["status"] == "success" and "odd" not in record
    for _ in range(2):
        tracking.log_runtime(spark, record, str(tmp_path / "log"))
        tracking.log_run(spark, {"a": float("inf")}, str(tmp_path / "runs"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2 and tracking.read_journal(spark, str(tmp_path / "runs")).count() == 2
    tracking.write_json({"parameter_set_id": 7, "params": {"a": np.float64("nan")}}, str(tmp_path / "m.json"))
    assert tracking.best_parameters(str(tmp_path / "m.json")) == {"parameter_set_id": "7", "params": {"a": None}} and tracking.read_json("/none", optional=True) == {}
    with pytest.raises(ValueError):
        tracking.runtime_record("")
    assert tracking.Timer().seconds() >= 0


def test_tails():
    assert math.isclose(2 * tails.t_upper(2.0, 10), 0.07338803, abs_tol=1e-7) and math.isclose(tails.chi2_upper(10.0, 4), 0.04042768, abs_tol=1e-7)
    assert math.isclose(tails.chi2_upper(50.0, 24), math.exp(-25) * sum(25**k / math.factorial(k) for k in range(12)), rel_tol=1e-12)  # closed form for even degrees
    assert math.isclose(tails.normal_upper(1.96), 0.0249979, abs_tol=1e-6)
    assert math.isclose(tails.binomial_two_sided(3, 10), 0.34375) and tails.binomial_two_sided(5, 10) == 1.0
    w, p = tails.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert math.isclose(w, 0.79, abs_tol=0.005) and 0.004 < p < 0.01


def test_adjustments(spark):
    t = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p_value double").withColumn("g", F.lit(1))
    got = {r.i: (r.p_holm, r.p_bh) for r in stats.adjusted(t, ["g"]).collect()}
    assert np.allclose([got[1], got[2], got[3]], [(0.03, 0.03), (0.06, 0.04), (0.06, 0.04)]) and got[4] == (None, None)


def test_adjusted_values_are_ordered(spark):
    rng = random.Random(4)
    t = spark.createDataFrame([(i % 3, rng.random() ** 3) for i in range(90)], "g int, p_value double")
    assert stats.adjusted(t, ["g"]).filter("p_holm < p_bh - 1e-12 or p_bh < p_value - 1e-12 or p_holm > 1").count() == 0


def test_dm_reduces_to_t(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random(40), rng.random(40)
    df = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "g int, timestamp int, a double, b double")
    r = stats.diebold_mariano(df, ["g"]).first()
    d = a - b
    assert math.isclose(r.statistic, d.mean() * math.sqrt(40) / d.std(ddof=1)) and math.isclose(r.p_value, 2 * tails.t_upper(abs(r.statistic), 39))
    assert stats.diebold_mariano(df.limit(2), ["g"]).first().statistic is None
    one = stats.diebold_mariano(df, ["g"], alternative="greater").first()
    assert math.isclose(one.p_value, tails.t_upper(one.statistic, 39))


def test_pacf_of_an_autoregression(spark):
    rng, y = np.random.default_rng(6), [0.0]
    for e in rng.normal(size=3000):
        y.append(0.7 * y[-1] + e)
    df = hours(spark, y).withColumn("g", F.lit("x"))
    r = stats.acf(df, "trip_count", ["g"], 5)
    p = {x.lag: x.pacf for x in stats.pacf(r, ["g"]).collect()}
    assert abs(p[1] - 0.7) < 0.05 and abs(p[2]) < 0.05 and p[0] == 1.0


def test_boosted_trees_and_shapley_values():
    rng = np.random.default_rng(7)
    x = rng.random((300, 4))
    y = 10 * (x[:, 0] > 0.5) + 5 * x[:, 1]
    m = models.BoostedTrees(60, 0.2, 3, subsample=0.8, colsample_bytree=0.8, min_child_weight=5).fit(x, y)
    assert np.abs(m.predict(x) - y).mean() < 0.6 and m.gain(4).argmax() == 0
    base, phi = m.shap(x[:20])
    assert np.allclose(base + phi.sum(axis=1), m.predict(x[:20])) and np.abs(phi[:, 0]).mean() > np.abs(phi[:, 3]).mean()


def test_additive_model():
    ds = pd.date_range("2024-01-01", periods=24 * 60, freq="h").to_numpy()
    t = np.arange(len(ds))
    y = 50 + 0.01 * t + 10 * np.sin(2 * np.pi * t / 24)
    m = models.AdditiveModel().fit(ds[:-48], y[:-48])
    assert np.abs(m.predict(ds[-48:]) - y[-48:]).mean() < 1.5
    c = m.components(ds[-48:])
    assert np.allclose(c["trend"] + c["daily"] + c["weekly"], c["yhat"]) and (c["yhat_lower"] <= c["yhat_upper"]).all()
    with pytest.raises(ValueError, match="unknown"):
        models.AdditiveModel({"odd": 1})


def test_seasonal_ar():
    t = np.arange(24 * 40)
    y = 20 + 5 * np.sin(2 * np.pi * t / 24)
    m = models.SeasonalAR(24).fit(y)
    assert np.abs(m.forecast(y[:-24], 24) - y[-24:]).max() < 0.5


def test_spark_trees(spark, tmp_path):
    m = features.feature_matrix(hours(spark, np.abs(np.random.default_rng(8).normal(50, 10, 260))), "basic")
    fitted = models.retrained(m, [("xgb_basic", "basic", {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.1})])["xgb_basic"]
    fitted.write().overwrite().save(str(tmp_path / "model"))
    from pyspark.ml import PipelineModel

    assert PipelineModel.load(str(tmp_path / "model")).transform(m).count() == m.count()
    assert models.retrained(m, [("a", "basic", {})], dry_run=True) == [("a", "basic", {})]


def test_comparison_tables(spark):
    m = spark.createDataFrame([("A", 1.0, 2.0), ("B", 1.0, 3.0), ("C", 4.0, 1.0)], "model_label string, mae double, rmse double")
    r = {x.model_label: (x.mae_rank, x.rmse_rank) for x in comparison.metric_ranking(m, ["mae", "rmse"]).collect()}
    assert r == {"A": (1, 2), "B": (1, 3), "C": (3, 1)} and comparison.winner(m).first().model_label == "A"
    pairs = spark.createDataFrame([("p", "A", "B")], "comparison string, baseline string, challenger string")
    assert {x.metric: x.winner for x in comparison.improvements(m, pairs, ["mae", "rmse"]).collect()} == {"mae": "A", "rmse": "A"}
    assert comparison.improves(comparison.improvements(m, pairs, ["mae"])).count() == 0
    t = comparison.with_total(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "stage string, seconds double"), "stage")
    assert {x.stage: x.seconds for x in t.collect()} == {"a": 1.0, "b": 2.0, "total": 3.0}
    times = comparison.time_cost(m.select("model_label", F.col("mae").alias("tuning_seconds")), m.select("model_label", F.lit(1.0).alias("retrain_seconds")), m.select("model_label", F.lit(1.0).alias("load_seconds"), F.col("rmse").alias("predict_seconds")))
    assert {x.model_label: x.known_end_to_end_seconds for x in times.collect()} == {"A": 5.0, "B": 6.0, "C": 7.0}
    assert comparison.require_bool(spark.createDataFrame([(" Yes",), ("0",)], "b string"), "b").count() == 2
    with pytest.raises(ValueError, match="no boolean"):
        comparison.require_bool(spark.createDataFrame([("t",)], "b string"), "b")
    assert comparison.weakness_table(m, ["A", "C"], ["mae"]).first()["C_improves"] is False
    with pytest.raises(ValueError):
        comparison.select_parameter_set(spark.createDataFrame([("x",)], "parameter_set_id string"), "y")
    assert comparison.reference_comparison(m, m.filter("model_label = 'A'").withColumn("aic", F.lit(1.0))).count() == 4


def test_analysis_edges(spark):
    p = spark.createDataFrame([("A", i, float(i % 7), float(i % 5) - 1) for i in range(48)], "model_label string, i int, actual double, predicted double").withColumn("timestamp", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,i)"))
    e = analysis.with_errors(p)
    assert analysis.negative_predictions(e).count() == analysis.negative_counts(e).first().negative_predictions == 10
    assert analysis.signed_extremes(e, 100).filter("residual = 0").count() == 0
    s = analysis.segment_errors(e)
    assert "all" in {r.segment for r in s.collect()} and analysis.worst_segment(s).count() == 1
    assert {r.kind for r in analysis.best_and_worst(analysis.short_errors_by(e, "local_hour"), "local_hour").collect()} == {"best", "worst"}
    assert analysis.by_model(s, "segment").count() == s.count()
    x = analysis.extreme_events(e.withColumn("actual", F.lit(None).cast("double")))
    assert x.count() == 3 and x.filter("n_predictions = 0 and mae is null").count() == 3


def test_tolerance_compare(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, None, None), (3, 1.0, None), (4, 1.0, 1.1)], "i int, a double, b double")
    assert tuple(compare_with_nulls(df, "a", "b", "i").first()) == (2, 3) and df.filter(close(F.col("a"), F.col("b"))).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming import event_stream, hourly_stream, into_table

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = into_table(hourly_stream(event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r.timestamp: r.trip_count for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.timestamp: r.trip_count for r in timeaxis.hourly_counts(events).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 4
