"""Additive models of all folds and parameter sets from one pass over the rows.

A fit needs the products of its terms alone.  Expanding folds share their first row, so the terms of
all folds (level, slope, the knots of every fold, daily and weekly waves, regressors) are columns of
one design; rows are dealt to segments between the folds' training ends and stretches of time, each
of which gives one Gram matrix.  A fold's matrix is the sum of its segments, its own columns are
picked and rescaled from it, and every parameter set is one small linear system.  The matrix is
never copied by fold or set.

The coefficients equal those of ``AdditiveModel.fit`` on the fold's rows.  Nulls: rows without a
target or a regressor are left out.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LOCAL_TZ, TARGET, TIMESTAMP
from . import ordered
from .models import AdditiveModel

KNOTS = 15
_SHARES = np.linspace(0, 0.8, KNOTS + 2)[1:-1]


def _hours(ds: np.ndarray) -> np.ndarray:
    return ds.astype("datetime64[s]").astype(np.int64) / 3600.0


def _design(hours: np.ndarray, start: float, lengths: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Level, slope, knots by fold, four daily and three weekly waves, regressors; times as shares of the longest fold."""
    span, t = lengths.max(), hours - start
    hinges = np.maximum(0, t[:, None] - (lengths[:, None] * _SHARES).ravel()) / span
    wave = lambda period, order: [f(2 * np.pi * k * hours / period) for k in range(1, order + 1) for f in (np.sin, np.cos)]
    return np.column_stack([np.ones(len(t)), t / span, hinges, *wave(24, 4), *wave(168, 3), x])


def fold_grams(cv: DataFrame, rows: DataFrame, regressors: tuple[str, ...] = (), series: list[str] = (), target: str = TARGET) -> DataFrame:
    """``(series..., segment, start, lengths, folds, n, most, body)``: the Gram matrix of the terms, the target and log(1 + target) by segment.

    ``rows``: timestamp, target and regressors; ``cv``: rows of ``cv_rows``.  ``most``: the largest absolute target and logarithm.
    """
    keys, wide = list(series), len(regressors)
    ends = cv.filter("role = 'train'").groupBy(*keys, "fold").agg(F.max(TIMESTAMP).alias("end"))
    ends = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("end", "fold"))).alias("folds"))  # a few by series
    slim = rows.select(*keys, TIMESTAMP, F.col(target).cast("double").alias("y_"), F.array(*(F.col(r).cast("double") for r in regressors)).cast("array<double>").alias("x_"))
    slim = slim.filter(F.col("y_").isNotNull() & ~F.exists("x_", lambda v: v.isNull()))
    passed = F.aggregate("folds", F.struct(F.col(TIMESTAMP).alias("at"), F.lit(0).alias("n")), lambda a, f: F.struct(a["at"].alias("at"), (a["n"] + (f["end"] < a["at"]).cast("int")).alias("n")), lambda a: a["n"])
    cut = ordered.beside(slim.filter(F.col(TIMESTAMP).isNotNull()), ends, keys, "inner").withColumn("segment", passed).filter(F.col("segment") < F.size("folds"))
    lasts = cut.groupBy(*keys, "segment").agg(F.min(TIMESTAMP).alias("first"), F.max(TIMESTAMP).alias("last"))
    seconds = lambda c: F.unix_timestamp(c) / 3600.0
    spans = lasts.groupBy(*keys).agg(seconds(F.min("first")).alias("start"), F.array_sort(F.collect_list(F.struct("segment", seconds("last").alias("hour")))).alias("lasts"))
    cut = ordered.beside(cut, spans, keys, "inner").withColumn("stretch", F.floor(F.unix_timestamp(TIMESTAMP) / ordered.SECONDS))
    kinds = "".join(f"`{k}` {cv.schema[k].dataType.simpleString()}, " for k in keys)

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        until = {int(s["segment"]): s["hour"] for s in one["lasts"]}
        reach = [max([h for s, h in until.items() if s <= k], default=one["start"]) - one["start"] for k in range(len(one["folds"]))]
        lengths = np.maximum(reach, 1.0)
        y = pdf["y_"].to_numpy(float)
        x = np.array(pdf["x_"].tolist(), float).reshape(len(pdf), wide)
        log = np.log1p(y)
        m = np.column_stack((_design(_hours(pdf[TIMESTAMP].to_numpy()), one["start"], lengths, x), y, log))
        out = pdf[[*keys, "segment"]].iloc[:1]
        return out.assign(start=one["start"], lengths=[lengths.tolist()], folds=[[int(f["fold"]) for f in one["folds"]]], n=len(pdf), most=[[float(np.abs(y).max()), float(np.abs(log).max())]], body=[(m.T @ m).tobytes()])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in pdf["body"])
        most = np.max([list(v) for v in pdf["most"]], axis=0).tolist()
        return pdf.iloc[:1].assign(n=int(pdf["n"].sum()), most=[most], body=[total.tobytes()])

    schema = f"{kinds}segment int, start double, lengths array<double>, folds array<int>, n bigint, most array<double>, body binary"
    parts = cut.groupBy(*keys, "segment", "stretch").applyInPandas(gram, schema)
    return parts.groupBy(*keys, "segment").applyInPandas(added, schema)


def _picked(g: np.ndarray, k: int, lengths: np.ndarray, wide: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The products of fold ``k``'s own terms, targets last, and the regressors' means and deviations."""
    folds, span = len(lengths), lengths.max()
    own = [0, 1, *range(2 + k * KNOTS, 2 + (k + 1) * KNOTS), *range(2 + folds * KNOTS, len(g))]
    g = g[np.ix_(own, own)].copy()
    t = np.eye(len(own))
    t[range(1, 2 + KNOTS), range(1, 2 + KNOTS)] = span / lengths[k]
    at = np.arange(len(own) - 2 - wide, len(own) - 2)
    mean = g[0, at] / n
    std = np.maximum(np.sqrt(np.maximum(g[at, at] / n - mean**2, 0)), 1e-9)
    t[at, at], t[at, 0] = 1 / std, -mean / std
    return t @ g @ t.T, mean, std


def fit_sets(grams: DataFrame, grid: list[tuple[str, dict]], regressors: tuple[str, ...] = (), series: list[str] = ()) -> DataFrame:
    """``(series..., fold, parameter_set_id, body, n_train_rows)``: a fitted ``AdditiveModel`` as text for each set and fold."""
    keys, sets, wide = list(series), list(grid), len(regressors)
    kinds = "".join(f"`{k}` {grams.schema[k].dataType.simpleString()}, " for k in keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment")
        one, out = pdf.iloc[0], []
        lengths, size = np.array(one["lengths"], float), None
        for k, fold in enumerate(one["folds"]):
            upto = pdf[pdf["segment"] <= k]
            if not len(upto):
                continue
            flat = sum(np.frombuffer(b) for b in upto["body"])
            size, n = int(round(len(flat) ** 0.5)), int(upto["n"].sum())
            most = np.max([list(v) for v in upto["most"]], axis=0)
            g, mean, std = _picked(flat.reshape(size, size), k, lengths, wide, n)
            terms = g[:-2, :-2]
            for name, params in sets:
                m = AdditiveModel(params, regressors)
                m.start, m.length = float(one["start"]), float(lengths[k])
                if wide:
                    m.x_mean, m.x_std = mean, std
                target = len(g) - (1 if m.log else 2)
                m.scale = max(float(most[1 if m.log else 0]), 1e-9)
                season = 1 / m.season_scale**2
                lam = np.concatenate(([1e-8, 1e-8], np.full(KNOTS, 1 / m.trend_scale**2), np.full(len(terms) - 2 - KNOTS, season)))
                xy = g[:-2, target] / m.scale
                beta = np.linalg.solve(terms + np.diag(lam) * 1e-2, xy)
                squares = g[target, target] / m.scale**2 - 2 * beta @ xy + beta @ terms @ beta
                bias = (g[0, target] / m.scale - beta @ terms[0]) / n
                m.noise = float(np.sqrt(max(squares / n - bias**2, 0.0))) * m.scale
                cuts = np.cumsum([2 + KNOTS, 8, 6])
                m.beta = dict(zip(["trend", "daily", "weekly", *(["regressors"] if wide else [])], np.split(beta, cuts if wide else cuts[:-1])))
                out.append((*(one[c] for c in keys), int(fold), name, m.to_json().encode(), n))
        return pd.DataFrame(out, columns=[*keys, "fold", "parameter_set_id", "body", "n_train_rows"])

    return grams.groupBy(*(keys or [F.lit(0).alias("one")])).applyInPandas(solve, f"{kinds}fold int, parameter_set_id string, body binary, n_train_rows bigint")


def coefficients(models: DataFrame, series: list[str] = ()) -> DataFrame:
    """``(series..., fold, parameter_set_id, term, nth, beta)`` of fitted models."""
    keys = list(series)
    stored = models.select(*keys, "fold", "parameter_set_id", F.from_json(F.col("body").cast("string"), "beta map<string,array<double>>")["beta"].alias("beta"))
    return stored.select(*keys, "fold", "parameter_set_id", F.explode("beta").alias("term", "b")).select(*keys, "fold", "parameter_set_id", "term", F.posexplode("b").alias("nth", "beta"))


def target_sums(grams: DataFrame, regressors: tuple[str, ...] = (), series: list[str] = ()) -> DataFrame:
    """``(series..., fold, term, target, value)``: each own term of a fold summed against the target and its logarithm, as the fits use them."""
    keys, wide = list(series), len(regressors)
    names = ["level", "slope", *(f"knot_{k + 1}" for k in range(KNOTS)), *(f"{n}_{f}_{k}" for n, order in (("daily", 4), ("weekly", 3)) for k in range(1, order + 1) for f in ("sin", "cos")), *(f"regressor_{r}" for r in regressors)]
    kinds = "".join(f"`{k}` {grams.schema[k].dataType.simpleString()}, " for k in keys)

    def unpack(pdf: pd.DataFrame) -> pd.DataFrame:
        one, out, lengths = pdf.iloc[0], [], np.array(pdf["lengths"].iloc[0], float)
        for k, fold in enumerate(one["folds"]):
            upto = pdf[pdf["segment"] <= k]
            flat = sum(np.frombuffer(b) for b in upto["body"])
            g, _, _ = _picked(flat.reshape(int(round(len(flat) ** 0.5)), -1), k, lengths, wide, int(upto["n"].sum()))
            out += [(*(one[c] for c in keys), int(fold), term, target, float(g[i, len(g) - 2 + j])) for i, term in enumerate(names) for j, target in enumerate(("target", "logarithm"))]
        return pd.DataFrame(out, columns=[*keys, "fold", "term", "target", "value"])

    return grams.groupBy(*(keys or [F.lit(0).alias("one")])).applyInPandas(unpack, f"{kinds}fold int, term string, target string, value double")


def additive_cv(cv: DataFrame, grid: list[tuple[str, dict]], horizon: int = 24, series: list[str] = (), target: str = TARGET) -> DataFrame:
    """Direct forecasts by (set, fold): the folds' models from ``fold_grams``, one call for each validation stretch."""
    keys = list(series)
    once = cv.filter("role = 'train'").select(*keys, TIMESTAMP, target).dropDuplicates([*keys, TIMESTAMP])  # a row trains in several folds
    models = fit_sets(fold_grams(cv, once, (), keys, target), grid, (), keys)
    packed = models.groupBy(*keys, "fold").agg(F.array_sort(F.collect_list(F.struct("parameter_set_id", "body"))).alias("models"))  # as many as the grid
    val = cv.filter("role = 'validation'").select(*keys, "fold", "pos", TIMESTAMP, F.col(target).cast("double").alias("y_"))
    kinds = "".join(f"`{k}` {cv.schema[k].dataType.simpleString()}, " for k in keys)

    def forecast(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows, parts = rows.sort_values("pos"), []
        at = np.arange(len(rows))
        for m in own["models"].iloc[0] if len(own) and len(rows) else []:
            made = AdditiveModel.from_json(m["body"]).predict(rows[TIMESTAMP].to_numpy())
            parts.append(rows[[*keys, "fold"]].assign(parameter_set_id=m["parameter_set_id"], timestamp=rows[TIMESTAMP], actual=rows["y_"], predicted=made, origin_block=at // horizon + 1, horizon_step=at % horizon + 1))
        names = [*keys, "fold", "parameter_set_id", TIMESTAMP, "actual", "predicted", "origin_block", "horizon_step"]
        return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)

    by = [*keys, "fold"]
    return val.groupBy(*by).cogroup(packed.groupBy(*by)).applyInPandas(forecast, f"{kinds}fold int, parameter_set_id string, timestamp timestamp, actual double, predicted double, origin_block int, horizon_step int")


def additive_components(train: DataFrame, rows: DataFrame, params: dict | None = None, regressors: tuple[str, ...] = (), target: str = TARGET, tz: str = LOCAL_TZ) -> DataFrame:
    """Components by timestamp with the local hour and day of one model, fitted from the Gram matrix of the training rows; its text alone comes to the driver."""
    whole = train.withColumn("role", F.lit("train")).withColumn("fold", F.lit(0))
    stored = fit_sets(fold_grams(whole, train, tuple(regressors), (), target), [("one", params or {})], tuple(regressors)).first()["body"]
    names = ["trend", "daily", "weekly", *(["regressors"] if regressors else []), *(f"regressor_{r}" for r in regressors), "yhat", "yhat_lower", "yhat_upper"]
    text = bytes(stored).decode()

    def run(batches):
        model = AdditiveModel.from_json(text)
        for b in batches:
            made = model.components(b[TIMESTAMP].to_numpy(), b[list(regressors)].to_numpy(float) if regressors else None)
            yield b[[TIMESTAMP, "y"]].assign(**{n: made[n] for n in names})

    cols = [TIMESTAMP, F.col(target).cast("double").alias("y"), *(F.col(r).cast("double").alias(r) for r in regressors)]
    out = rows.select(*cols).mapInPandas(run, f"timestamp timestamp, y double, {', '.join(f'`{n}` double' for n in names)}")
    local = F.from_utc_timestamp(TIMESTAMP, tz)
    return out.withColumns({"local_hour": F.hour(local), "local_day_of_week": F.weekday(local)})
