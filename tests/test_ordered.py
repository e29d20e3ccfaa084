"""Stretches, pieces and ranks against plain windows and plain Python, with stretches cut short."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.tails import shapiro_wilk
from tidemark.operators import features, ordered, stats, timeaxis

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def short(monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 7)
    monkeypatch.setattr(ordered, "SECONDS", 5 * 3600)


def hours(spark, keys=(None, "a", "b"), n=60, gaps=True, seed=1):
    rng = random.Random(seed)
    rows = [(k, START + dt.timedelta(hours=h), float(rng.randrange(50))) for k in keys for h in range(n) if not gaps or rng.random() < 0.7]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, timestamp timestamp, trip_count double").repartition(3)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_numbers_of_times_and_values(spark, short):
    df = hours(spark)
    for order in ("timestamp",):
        want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(order)).cast("long") - 1)
        assert table(ordered.numbered(df, ["k"], order, "n")) == table(want)
    got = ordered.numbered(df, ["k"], "trip_count", "n", total="all").collect()
    for k in (None, "a", "b"):
        own = sorted((r for r in got if r["k"] == k), key=lambda r: r["n"])
        assert [r["n"] for r in own] == list(range(len(own))) and {r["all"] for r in own} == {len(own)}
        assert [r["trip_count"] for r in own] == sorted(r["trip_count"] for r in own)


def test_a_very_frequent_value_is_dealt_to_parts(spark):
    rows = [(float(i % 3 == 0) * 5 + float(i % 7 == 0) * i, i) for i in range(3000)] + [(None, -1), (float("nan"), -2)]
    df = spark.createDataFrame(rows, "x double, i long").repartition(4)
    pieces = ordered._pieces(df, [], "x").filter("x = 5").groupBy("piece_").agg(F.count_distinct("part_").alias("parts")).collect()
    assert len(pieces) == 1 and pieces[0]["parts"] == ordered.PARTS
    got = sorted(ordered.numbered(df, [], "x").collect(), key=lambda r: r["pos_"])
    assert [r["pos_"] for r in got] == list(range(len(rows)))
    assert got[0]["x"] is None and math.isnan(got[-1]["x"])
    assert [r["x"] for r in got[1:-1]] == sorted(r[0] for r in rows[:-2])


def test_windows_on_stretches(spark, short):
    df = hours(spark)
    w = Window.partitionBy("k").orderBy("timestamp")
    columns = lambda w: {"lag": F.lag("trip_count", 5).over(w), "mean": F.avg("trip_count").over(w.rowsBetween(-9, -1)), "ahead": F.sum("trip_count").over(w.rowsBetween(0, 3))}
    got = ordered.own(ordered.chunks(df, ["k"], before=9, after=3).withColumns(columns(ordered.window(["k"]))))
    assert table(got) == table(df.withColumns(columns(w)))


def test_an_unkeyed_series_runs_in_many_tasks(spark, monkeypatch):
    """The feature matrix of one long series: the same rows as over one window, from more than one stretch."""
    monkeypatch.setattr(ordered, "SECONDS", 50 * 3600)
    monkeypatch.setattr(ordered, "ROWS", 170)
    df = hours(spark, ["a"], 700).select("timestamp", "trip_count")
    got = features.engineered(df, "advanced")
    w = Window.partitionBy(F.lit(0)).orderBy("timestamp")
    plain = features.lag_columns([1, 168], w=w) | features.rolling_columns([3, 24, 168], [24], w=w)
    assert table(got.select("timestamp", *plain)) == table(df.withColumns(plain).select("timestamp", *plain))
    cut = ordered.chunks(df, before=168)
    assert cut.select("chunk_").distinct().count() > 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "chunk_" in plan and "hashpartitioning(chunk_" in plan


def test_spacing_and_centred(spark, short):
    df = hours(spark)
    got = {r["k"]: r for r in timeaxis.spacing(df, series=["k"]).collect()}
    for k in (None, "a", "b"):
        t = sorted(r["timestamp"] for r in df.collect() if r["k"] == k)
        steps = [(y - x).total_seconds() for x, y in zip(t, t[1:])]
        assert (got[k]["n_steps"], got[k]["non_hourly"], got[k]["least_step"], got[k]["largest_step"]) == (len(steps), sum(s != 3600 for s in steps), min(steps), max(steps))
    w = Window.partitionBy("k").orderBy("timestamp").rowsBetween(-5, 4)
    want = df.withColumns({"rolling_mean": F.avg("trip_count").over(w), "rolling_std": F.stddev_samp("trip_count").over(w)})
    assert table(features.centred_rolling(df, 10, ["k"]).drop("rolling_std")) == table(want.drop("rolling_std"))


def test_running_both_ways(spark):
    rng = random.Random(4)
    rows = [(k, float(x), rng.randrange(100)) for k in (None, "a") for x in rng.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "k string, x double, v long").repartition(3)
    made = {"s": ("sum", F.col("v"), "up"), "b": ("sum", F.col("v"), "before"), "m": ("max", F.col("v"), "up"), "d": ("min", F.col("v"), "down"), "t": ("sum", F.col("v"), "all")}
    w = Window.partitionBy("k").orderBy("x")
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    want = df.withColumns({"s": F.sum("v").over(w.rowsBetween(first, 0)), "b": F.sum("v").over(w.rowsBetween(first, -1)), "m": F.max("v").over(w.rowsBetween(first, 0)), "d": F.min("v").over(w.rowsBetween(0, last)), "t": F.sum("v").over(Window.partitionBy("k"))})
    assert table(ordered.running(df, ["k"], "x", made)) == table(want)
    assert table(ordered.running(df, ["k"], "x", made, F.floor(F.col("x") / 100))) == table(want)
    assert ordered.running(df.limit(0), [], "x", made).count() == 0


def test_lagged_sums(spark, short):
    rng = random.Random(5)
    rows = [(k, START + dt.timedelta(hours=h), rng.gauss(3, 2) if h % 11 else None) for k in ("a", None) for h in range(70)] + [("one", START, 1.0)]
    df = spark.createDataFrame(rows, "k string, timestamp timestamp, x double").repartition(3)
    got = {(r["k"], r["lag"]): r for r in ordered.lagged_sums(df, ["k"], "x", 20).collect()}
    for k in ("a", None, "one"):
        x = np.array([v for g, _, v in rows if g == k and v is not None])
        z = x - x.mean()
        assert sum(g == k for g, _ in got) == min(21, len(x))
        for lag in range(min(21, len(x))):
            r, a, b = got[k, lag], z[: len(z) - lag], z[lag:]
            assert r["n"] == len(a) and np.allclose([r[c] for c in ("sx", "sy", "sxx", "syy", "sxy")], [a.sum(), b.sum(), a @ a, b @ b, a @ b], atol=1e-9)


def test_acf_pacf_by_definition(spark, short):
    rng = np.random.default_rng(6)
    x = np.zeros(300)
    for i in range(1, 300):
        x[i] = 0.6 * x[i - 1] + rng.normal()
    df = spark.createDataFrame([("g", START + dt.timedelta(hours=i), float(v)) for i, v in enumerate(x)], "k string, timestamp timestamp, x double")
    r = [q["acf"] for q in stats.acf(df, "x", ["k"], 168).orderBy("lag").collect()]
    z = x - x.mean()
    assert np.allclose(r, [z[k:] @ z[: len(z) - k] / (z @ z) for k in range(169)])
    p = [q["pacf"] for q in stats.pacf(stats.acf(df, "x", ["k"], 30), ["k"]).orderBy("lag").collect()]
    for k in (1, 2, 7, 30):
        m = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert abs(np.linalg.solve(m, r[1 : k + 1])[-1] - p[k]) < 1e-9


def holm_bh(p):
    live = sorted((v, i) for i, v in enumerate(p) if v is not None and not math.isnan(v))
    m, holm, bh, top, low = len(live), {}, {}, 0.0, 1.0
    for rank, (v, i) in enumerate(live, 1):
        holm[i] = top = max(top, min(1.0, (m - rank + 1) * v))
    for rank, (v, i) in reversed(list(enumerate(live, 1))):
        bh[i] = low = min(low, v * m / rank)
    return holm, bh


def test_holm_and_bh(spark):
    rng = random.Random(7)
    values = [rng.choice([0.0, 1.0, 0.5, rng.random(), rng.random() ** 20, 1e-300, None, float("nan")]) for _ in range(2000)]
    df = spark.createDataFrame([("x" if i % 5 else None, i, v) for i, v in enumerate(values)], "g string, i long, p_value double").repartition(5)
    got = {r["i"]: r for r in stats.adjusted(df, ["g"]).collect()}
    assert len(got) == len(values)
    for g in (0, 1):
        own = [i for i in range(len(values)) if bool(i % 5) == bool(g)]
        holm, bh = holm_bh([values[i] for i in own])
        for k, i in enumerate(own):
            assert (got[i]["p_holm"] is None) == (k not in holm)
            if k in holm:
                assert math.isclose(got[i]["p_holm"], holm[k], rel_tol=1e-12) and math.isclose(got[i]["p_bh"], bh[k], rel_tol=1e-12)


def test_a_million_p_values_of_one_family(spark):
    """More than one task, and equal to a running maximum over the sorted values."""
    n = 1_000_000
    df = spark.range(n).select("id", (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)).alias("p_value"))
    out = stats.adjusted(df, [])
    p = np.sort(np.array([r[0] for r in df.select("p_value").collect()]))
    rank = np.arange(1, n + 1)
    holm = np.maximum.accumulate(np.minimum(1, (n - rank + 1) * p))
    bh = np.minimum.accumulate(np.minimum(1, p * n / rank)[::-1])[::-1]
    got = np.array(sorted(tuple(r) for r in out.select("p_value", "p_holm", "p_bh").collect()))
    assert np.allclose(got[:, 1], holm, rtol=1e-12) and np.allclose(got[:, 2], bh, rtol=1e-12)
    pieces = df.select(F.floor(64 * F.log2("p_value")).alias("piece")).groupBy("piece").count()
    assert pieces.count() > 50 and pieces.agg(F.max("count")).first()[0] < 0.05 * n


def test_shapiro(spark):
    """Groups of many sizes at once against the list version."""
    groups = {}
    for n in (1, 2, 3, 4, 5, 6, 11, 12, 50, 400):
        rng = random.Random(n)
        groups[f"n{n}"] = [round(rng.gauss(0, 1), 1) + (rng.random() ** 3 if n > 20 else 0) for _ in range(n)]
    rows = [(k, v) for k, own in groups.items() for v in own]
    df = spark.createDataFrame(rows + [("same", 2.0)] * 4 + [("none", None)], "k string, x double")
    got = {r["k"]: r for r in stats.shapiro(df, "x", ["k"]).collect()}
    for k, own in groups.items():
        w, p = shapiro_wilk(own)
        if math.isnan(w):
            assert got[k]["statistic"] is None and got[k]["p_value"] is None
        else:
            assert abs(got[k]["statistic"] - w) < 1e-9 and abs(got[k]["p_value"] - p) < 1e-7
    assert got["same"]["statistic"] is None and "none" not in got


def test_runs_across_stretches(spark, short):
    rng = random.Random(8)
    rows = [("g", START + dt.timedelta(hours=i), float(rng.choice([-1, 0, 1, 2]))) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, timestamp timestamp, x double").repartition(4)
    r = stats.centre_and_randomness(df, "x", ["k"]).first()
    s = [v > 0 for _, _, v in rows if v]
    runs, p, q = 1 + sum(a != b for a, b in zip(s, s[1:])), sum(s), len(s) - sum(s)
    m = p + q
    assert math.isclose(r["runs_test_z_statistic"], (runs - 1 - 2 * p * q / m) / math.sqrt(2 * p * q * (2 * p * q - m) / (m * m * (m - 1))), rel_tol=1e-9)


def test_exact_quantiles(spark):
    rng = random.Random(9)
    values = [rng.choice([0.0, 0.0, rng.gauss(0, 9)]) for _ in range(1001)]
    df = spark.createDataFrame([("g", v) for v in values] + [(None, 4.0), ("e", None), ("e", float("nan"))], "k string, x double").repartition(3)
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.987, "e": 1.0}
    got = {r["k"]: r for r in ordered.quantiles(df, ["k"], "x", shares).collect()}
    assert all(math.isclose(got["g"][n], np.quantile(values, s), abs_tol=1e-9) for n, s in shares.items()) and got[None]["c"] == 4.0 and set(got) == {"g", None}


def test_known_normal_quantiles(spark):
    known = {0.975: 1.959963984540054, 0.5: 0.0, 0.9: 1.2815515655446004, 1e-10: -6.361340902404056, 0.999999: 4.753424308822899}
    df = spark.createDataFrame([(p,) for p in [*known, 0.0, 1.0]], "p double")
    got = {r["p"]: r["z"] for r in df.withColumn("z", ordered.normal_quantile(F.col("p"))).collect()}
    assert got.pop(0.0) is None and got.pop(1.0) is None
    assert all(math.isclose(got[p], z, abs_tol=1e-9) for p, z in known.items())
