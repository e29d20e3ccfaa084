"""The study end to end on the event table's month, and the plot-feeding tables."""

import math

from pyspark.sql import functions as F

from tidemark.operators import stats, timeaxis


def test_study(spark, tmp_path):
    from tidemark.plans.study import main

    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    hours = timeaxis.dense(timeaxis.hourly_counts(events)).select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Pickup Hour"), F.col("trip_count").alias("Trip Count"))
    hours.coalesce(1).write.option("header", True).csv(str(tmp_path / "raw"))
    main(["--input", str(tmp_path / "raw"), "--output", str(tmp_path / "out"), "--max-parameter-sets", "1", "--n-folds", "2", "--val-horizon", "48", "--test-days", "3"])
    out = {n: spark.read.parquet(str(tmp_path / "out" / f"analysis_{n}")) for n in ("metrics", "dm_step", "segments")}
    assert out["metrics"].count() == 4 and out["dm_step"].count() == 2 * 2 * 24 and out["segments"].count() > 10
    log = spark.read.option("header", True).csv(str(tmp_path / "out" / "runtime_log"))
    assert {r.experiment_name for r in log.collect()} == {"preprocessing", "split", "features_basic", "tuning_basic", "final_test_basic"} and log.filter("status <> 'success'").count() == 0


def test_plot_tables(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 10)], "g string, x double")
    q = {r.nth: r for r in stats.qq_points(df, "x", ["g"]).collect()}
    assert q[5].sample == 5.0 and abs(q[5].theoretical) < 1e-9 and math.isclose(q[1].theoretical, -q[9].theoretical, abs_tol=1e-9)
    n = stats.normal_fit(df, "x", ["g"], 101)
    assert n.count() == 101 and math.isclose(n.agg(F.max("density")).first()[0], 1 / (2.7386128 * math.sqrt(2 * math.pi)), rel_tol=1e-6)
