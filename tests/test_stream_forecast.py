"""The state-updating forecast of a stream, stopped and restarted in mid-block, against the batch version."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.streaming.forecast import fitted_states, state_updating_forecast

START = dt.datetime(2024, 1, 1)


def table(spark, n=300):
    rng = np.random.default_rng(2)
    rows = [(k, START + dt.timedelta(hours=h), float(20 + s * np.sin(h / 24 * 2 * np.pi) + rng.integers(0, 5))) for k, s in (("a", 6), ("b", 3)) for h in range(n)]
    return spark.createDataFrame(rows, "k string, timestamp timestamp, trip_count double")


def run(spark, source, fitted, folder, series=("k",)):
    """All that has arrived, then stop; the next call goes on from the checkpoint."""
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = state_updating_forecast(stream, fitted, 24, list(series)).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def test_restart_in_mid_block(spark, tmp_path):
    df = table(spark)
    cut = F.lit(START + dt.timedelta(hours=200))
    train, test = df.filter(F.col("timestamp") < cut), df.filter(F.col("timestamp") >= cut)
    want = models.seasonal_ar_predictions(train, test, 24, series=["k"]).select("k", "timestamp", "actual", "predicted", "origin_block", "horizon_step")
    fitted = spark.createDataFrame(fitted_states(train, series=["k"]).collect(), "k string, model string")
    source, folder = str(tmp_path / "in"), str(tmp_path)
    first = START + dt.timedelta(hours=200)
    for part, (a, b) in enumerate(((0, 31), (31, 33), (30, 80), (80, 100))):  # cut in mid-block; two hours are sent twice
        own = test.filter((F.col("timestamp") >= F.lit(first + dt.timedelta(hours=a))) & (F.col("timestamp") < F.lit(first + dt.timedelta(hours=b))))
        own.coalesce(1).write.mode("append").parquet(source)
        run(spark, source, fitted, folder)
    got = spark.read.parquet(f"{folder}/out")
    rows = lambda d: sorted(tuple(r) for r in d.select("k", "timestamp", "actual", "predicted", "origin_block", "horizon_step").collect())
    a, b = rows(got), rows(want)
    assert len(a) == len(b) == 200
    assert all(x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-9 and x[4:] == y[4:] for x, y in zip(a, b))


def test_one_series_nulls_and_series_without_model(spark, tmp_path):
    df = table(spark, 120).filter("k = 'a'").drop("k")
    cut = F.lit(START + dt.timedelta(hours=90))
    train, test = df.filter(F.col("timestamp") < cut), df.filter(F.col("timestamp") >= cut)
    fitted = spark.createDataFrame(fitted_states(train).collect(), "model string")
    source = str(tmp_path / "in")
    test.unionByName(spark.createDataFrame([(None, 1.0), (START + dt.timedelta(hours=500), None)], "timestamp timestamp, trip_count double")).coalesce(1).write.parquet(source)
    run(spark, source, fitted, str(tmp_path), ())
    want = models.seasonal_ar_predictions(train, test, 24)
    got = {r["timestamp"]: r["predicted"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 30 and all(abs(got[r["timestamp"]] - r["predicted"]) < 1e-9 for r in want.collect())
