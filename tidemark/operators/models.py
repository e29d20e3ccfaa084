"""Models, grids, tuning, retraining and interpretation.

Fits of one (series, fold, parameter set) are small and independent: they fan out as groups of
``applyInPandas``, each holding one training stretch.  The boosted trees for one large table are
Spark's own (``tree_pipeline``); additive and autoregressive models are least squares in closed form.
"""

from __future__ import annotations

import itertools
import json
import pickle
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LOCAL_TZ, TARGET, TIMESTAMP, feature_columns, required_history
from . import shapley
from .boosting import grid_cv  # noqa: F401
from .features import feature_group
from .forecast import recursive_forecast


def parameter_grid(space: dict[str, list], prefix: str, limit: int | None = None) -> list[tuple[str, dict]]:
    """``(prefix_001, {...}), ...``: the right-most parameter varies fastest."""
    every = itertools.product(*space.values())
    return [(f"{prefix}_{i:03d}", dict(zip(space, values))) for i, values in enumerate(itertools.islice(every, limit), 1)]


def parameter_frame(spark: SparkSession, grid: list[tuple[str, dict]]) -> DataFrame:
    """``parameter_set_id`` and a ``param_<name>`` column each, as text."""
    names = list(grid[0][1]) if grid else []
    return spark.createDataFrame([(i, *(str(p[n]) for n in names)) for i, p in grid], ", ".join(["parameter_set_id string", *(f"param_{n} string" for n in names)]))


# --- additive model: piecewise-linear trend, daily and weekly Fourier terms, optional regressors


class AdditiveModel:
    """Ridge regression on trend, seasonal and regressor terms.

    ``changepoint_prior_scale`` and ``seasonality_prior_scale`` set the penalties of their terms;
    multiplicative seasonality is fitted on log(1 + y).
    """

    PARAMETERS = {"changepoint_prior_scale", "seasonality_prior_scale", "seasonality_mode"}

    def __init__(self, params: dict | None = None, regressors: tuple[str, ...] = (), changepoints: int = 15):
        params = params or {}
        if unknown := set(params) - self.PARAMETERS:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        self.trend_scale = float(params.get("changepoint_prior_scale", 0.05))
        self.season_scale = float(params.get("seasonality_prior_scale", 10.0))
        self.log = params.get("seasonality_mode", "additive") == "multiplicative"
        self.regressors, self.changepoints = tuple(regressors), changepoints

    def _groups(self, ds: np.ndarray, x: np.ndarray | None) -> dict[str, np.ndarray]:
        hours = ds.astype("datetime64[s]").astype(np.int64) / 3600.0
        t = (hours - self.start) / self.length
        knots = np.linspace(0, 0.8, self.changepoints + 2)[1:-1]
        trend = np.column_stack((np.ones(len(t)), t, np.maximum(0, t[:, None] - knots)))
        wave = lambda period, order: np.column_stack([f(2 * np.pi * k * hours / period) for k in range(1, order + 1) for f in (np.sin, np.cos)])
        out = {"trend": trend, "daily": wave(24, 4), "weekly": wave(168, 3)}
        if self.regressors:
            out["regressors"] = (x - self.x_mean) / self.x_std
        return out

    def fit(self, ds: np.ndarray, y: np.ndarray, x: np.ndarray | None = None) -> AdditiveModel:
        hours = ds.astype("datetime64[s]").astype(np.int64) / 3600.0
        self.start, self.length = hours.min(), max(hours.max() - hours.min(), 1.0)
        if self.regressors:
            self.x_mean, self.x_std = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        groups = self._groups(ds, x)
        target = np.log1p(y) if self.log else y
        self.scale = max(float(np.abs(target).max()), 1e-9)
        penalty = {"trend": 1 / self.trend_scale**2, "daily": 1 / self.season_scale**2, "weekly": 1 / self.season_scale**2, "regressors": 1 / self.season_scale**2}
        lam = np.concatenate([np.full(g.shape[1], penalty[n]) for n, g in groups.items()])
        lam[:2] = 1e-8  # level and slope
        m = np.concatenate(list(groups.values()), axis=1)
        beta = np.linalg.solve(m.T @ m + np.diag(lam) * 1e-2, m.T @ (target / self.scale))
        ends = np.cumsum([g.shape[1] for g in groups.values()])
        self.beta = dict(zip(groups, np.split(beta, ends[:-1])))
        self.noise = float(np.std(target / self.scale - m @ beta)) * self.scale
        return self

    def components(self, ds: np.ndarray, x: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Terms on the fitted scale, each regressor's effect, the prediction and its 80 % bounds."""
        groups = self._groups(ds, x)
        out = {n: g @ self.beta[n] * self.scale for n, g in groups.items()}
        total = sum(out.values())
        out |= {f"regressor_{r}": groups["regressors"][:, i] * self.beta["regressors"][i] * self.scale for i, r in enumerate(self.regressors)}
        back = np.expm1 if self.log else lambda v: v
        return out | {"yhat": back(total), "yhat_lower": back(total - 1.2816 * self.noise), "yhat_upper": back(total + 1.2816 * self.noise)}

    def predict(self, ds: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
        return self.components(ds, x)["yhat"]

    def to_json(self) -> str:
        """The fitted model as text; ``from_json`` gives an equal one."""
        return json.dumps({k: {n: list(b) for n, b in v.items()} if k == "beta" else v.tolist() if hasattr(v, "tolist") else v for k, v in vars(self).items()})

    @classmethod
    def from_json(cls, body: str | bytes) -> AdditiveModel:
        out = cls()
        for k, v in json.loads(body).items():
            setattr(out, k, {n: np.array(b) for n, b in v.items()} if k == "beta" else tuple(v) if k == "regressors" else np.array(v) if k in ("x_mean", "x_std") else v)
        return out


# --- boosted trees in numpy, for the many small fits of a grid


class BoostedTrees:
    """Squared-error gradient boosting on histograms; splits need ``min_child_weight`` rows and leaves shrink by ``reg_lambda``."""

    def __init__(self, n_estimators=100, learning_rate=0.1, max_depth=3, subsample=1.0, colsample_bytree=1.0, min_child_weight=1, reg_lambda=1.0, seed=42, bins=64):
        self.n, self.rate, self.depth, self.subsample, self.columns = int(n_estimators), float(learning_rate), int(max_depth), float(subsample), float(colsample_bytree)
        self.least, self.reg, self.seed, self.bins = float(min_child_weight), float(reg_lambda), seed, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rng = np.random.default_rng(self.seed)
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)])  # b <= k means x <= cuts[k]
        self.base, self.trees = float(y.mean()), []
        f = np.full(len(y), self.base)
        for _ in range(self.n):
            rows = np.flatnonzero(rng.random(len(y)) < self.subsample) if self.subsample < 1 else np.arange(len(y))
            cols = np.sort(rng.choice(x.shape[1], max(1, round(self.columns * x.shape[1])), replace=False))
            tree: list = []
            self._grow(b, y - f, rows if len(rows) else np.arange(len(y)), cols, 0, tree)
            self.trees.append(tree)
            f += self._tree(tree, x)
        return self

    def _grow(self, b, r, rows, cols, depth, tree) -> int:
        at, g, n = len(tree), r[rows].sum(), len(rows)
        tree.append(None)
        best = (1e-12, -1, -1)
        if depth < self.depth and n >= 2 * self.least:
            for c in cols:
                k = len(self.cuts[c]) + 1
                gs, ns = np.cumsum(np.bincount(b[rows, c], r[rows], k))[:-1], np.cumsum(np.bincount(b[rows, c], minlength=k))[:-1]
                if len(gs):
                    gain = gs**2 / (ns + self.reg) + (g - gs) ** 2 / (n - ns + self.reg) - g**2 / (n + self.reg)
                    gain[(ns < self.least) | (n - ns < self.least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), int(c), k)
        gain, c, k = best
        if c < 0:
            tree[at] = (-1, 0.0, 0, 0, self.rate * g / (n + self.reg), n, 0.0)
        else:
            left = b[rows, c] <= k
            lo, hi = self._grow(b, r, rows[left], cols, depth + 1, tree), self._grow(b, r, rows[~left], cols, depth + 1, tree)
            tree[at] = (c, float(self.cuts[c][k]), lo, hi, 0.0, n, gain)
        return at

    @staticmethod
    def _tree(tree, x) -> np.ndarray:
        node = np.zeros(len(x), int)
        t = np.array([(a, b, c, d, e) for a, b, c, d, e, *_ in tree])
        while (live := t[node, 0] >= 0).any():
            i = np.flatnonzero(live)
            m = node[i]
            node[i] = np.where(x[i, t[m, 0].astype(int)] <= t[m, 1], t[m, 2], t[m, 3]).astype(int)
        return t[node, 4]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._tree(t, x) for t in self.trees), np.zeros(len(x)))

    def gain(self, n_features: int) -> np.ndarray:
        out = np.zeros(n_features)
        for t in self.trees:
            for c, *_, g in t:
                if c >= 0:
                    out[c] += g
        return out

    def shap(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Path-dependent Shapley values: the base value and a value per row and feature."""
        base, phi = shapley.values(shapley.path_table(self.trees), x)
        return self.base + base, phi


# --- seasonal autoregression


class SeasonalAR:
    """Least squares on ``p`` recent lags and ``P`` seasonal lags, each order chosen by AIC; state is the recent values."""

    def __init__(self, period: int = 24, max_p: int = 2, max_P: int = 1):
        self.period, self.max_p, self.max_P = period, max_p, max_P

    def fit(self, y: np.ndarray) -> SeasonalAR:
        best = None
        start = max(self.max_p, self.max_P * self.period) + 1
        for p in range(self.max_p + 1):
            for q in range(self.max_P + 1):
                lags = [*range(1, p + 1), *(self.period * k for k in range(1, q + 1))]
                m = np.column_stack([np.ones(len(y) - start), *(y[start - k : len(y) - k] for k in lags)])
                beta, *_ = np.linalg.lstsq(m, y[start:], rcond=None)
                s = float(((y[start:] - m @ beta) ** 2).mean())
                n, k = len(y) - start, m.shape[1]
                aic, bic = n * np.log(max(s, 1e-300)) + 2 * k, n * np.log(max(s, 1e-300)) + k * np.log(n)
                if best is None or aic < best[0]:
                    best = (aic, bic, p, q, lags, beta)
        self.aic, self.bic, self.p, self.P, self.lags, self.beta = best
        return self

    def forecast(self, y: np.ndarray, horizon: int) -> np.ndarray:
        known = list(y[-max([*self.lags, 1]) :])
        for _ in range(horizon):
            known.append(float(self.beta[0] + sum(b * known[-k] for b, k in zip(self.beta[1:], self.lags))))
        return np.array(known[-horizon:])


def seasonal_ar_predictions(train: DataFrame, test: DataFrame, horizon: int = 24, period: int = 24, series: list[str] = (), target: str = TARGET) -> DataFrame:
    """Fit once, predict block by block, updating the state with each block's actuals: one series is one sequential group."""
    keys = list(series)
    rows = train.select(*keys, TIMESTAMP, F.col(target).cast("double").alias("y"), F.lit(False).alias("is_test")).unionByName(test.select(*keys, TIMESTAMP, F.col(target).cast("double").alias("y"), F.lit(True).alias("is_test")))
    kinds = "".join(f"`{k}` {train.schema[k].dataType.simpleString()}, " for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIMESTAMP)
        y, n = pdf["y"].to_numpy(), int((~pdf["is_test"]).sum())
        model = SeasonalAR(period).fit(y[:n])
        out = pdf.iloc[n:].copy()
        out["predicted"] = np.concatenate([model.forecast(y[:s], min(horizon, len(y) - s)) for s in range(n, len(y), horizon)]) if n < len(y) else []
        at = np.arange(len(out))
        order = json.dumps({"order": [model.p, 0, 0], "seasonal_order": [model.P, 0, 0, period], "aic": model.aic, "bic": model.bic})
        return out.assign(actual=out["y"], origin_block=at // horizon + 1, horizon_step=at % horizon + 1, model_label="SARIMA-Auto", params_json=order)[[*keys, TIMESTAMP, "actual", "predicted", "origin_block", "horizon_step", "model_label", "params_json"]]

    return rows.groupBy(*(keys or [F.lit(0).alias("one")])).applyInPandas(run, f"{kinds}timestamp timestamp, actual double, predicted double, origin_block int, horizon_step int, model_label string, params_json string")


# --- tuning


def fit_grid(cv: DataFrame, matrix: DataFrame, grid: list[tuple[str, dict]], kind: str, series: list[str] = (), target: str = TARGET, factory=BoostedTrees) -> DataFrame:
    """``(series..., fold, parameter_set_id, body, train_time_seconds, n_train_rows)``: a fitted model for each set and fold, fitted in parallel."""
    spark, keys, columns = cv.sparkSession, list(series), feature_columns(kind)
    folds = cv.filter("role = 'train'").select(*keys, "fold", TIMESTAMP)
    rows = matrix.join(folds, [*keys, TIMESTAMP]).select(*keys, "fold", TIMESTAMP, target, *columns)
    sets = spark.createDataFrame([(i, json.dumps(p)) for i, p in grid], "parameter_set_id string, params_json string")
    every = rows.join(F.broadcast(sets))  # the parameter grid: its size is set by the caller, not by the data
    kinds = "".join(f"`{k}` {matrix.schema[k].dataType.simpleString()}, " for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        pdf = pdf.sort_values(TIMESTAMP)
        model = factory(**json.loads(pdf["params_json"].iloc[0])).fit(pdf[columns].to_numpy(float), pdf[target].to_numpy(float))
        return pdf[[*keys, "fold", "parameter_set_id"]].iloc[:1].assign(body=pickle.dumps(model), train_time_seconds=time.perf_counter() - began, n_train_rows=len(pdf))

    return every.groupBy(*keys, "fold", "parameter_set_id").applyInPandas(run, f"{kinds}fold int, parameter_set_id string, body binary, train_time_seconds double, n_train_rows bigint")


def load_tree(body: bytes):
    model = pickle.loads(body)
    return lambda row: model.predict(row.reshape(1, -1))[0]


def component_means(components: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return components.groupBy(by).agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mean_absolute_error"), F.avg("y").alias("mean_actual"))


def component_summary(components: DataFrame, columns: list[str]) -> DataFrame:
    """Spread and share of mean absolute effect by component, largest first."""
    long = components.unpivot([TIMESTAMP], columns, "component", "value")
    out = long.groupBy("component").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.avg(F.abs("value")).alias("mean_abs"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    total = F.sum("mean_abs").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("share", F.when(total > 0, F.col("mean_abs") / total).otherwise(0.0)).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs"), "component")))


# --- interpretation


def shap_importance(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean absolute and mean value, population deviation, share, rank by feature."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"shap__{c}").alias("v")) for c in columns))).alias("x")).select("x.*")
    out = long.groupBy("feature").agg(F.avg(F.abs("v")).alias("mean_abs_shap"), F.avg("v").alias("mean_shap"), F.stddev_pop(F.abs("v")).alias("std_abs_shap"))
    total = F.sum("mean_abs_shap").over(Window.partitionBy(F.lit(0)))  # a row per feature
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs_shap"), "feature"))
    return out.withColumns({"share": F.when(total > 0, F.col("mean_abs_shap") / total).otherwise(0.0), "rank": rank, "feature_group": feature_group(F.col("feature"))})


def group_importance(importance: DataFrame) -> DataFrame:
    out = importance.groupBy("feature_group").agg(F.sum("mean_abs_shap").alias("mean_abs_shap"))
    total = F.sum("mean_abs_shap").over(Window.partitionBy(F.lit(0)))
    return out.withColumns({"share": F.when(total > 0, F.col("mean_abs_shap") / total).otherwise(0.0), "rank": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs_shap"), "feature_group"))})


def group_share(groups: DataFrame, names: list[str]) -> DataFrame:
    return groups.filter(F.col("feature_group").isin(*names)).agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("share"))


# --- Spark's own trees, for one large table


def tree_pipeline(kind: str, params: dict, target: str = TARGET):
    """A Spark ML pipeline with the parameters under their names there; it saves and loads as such."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    own = {"n_estimators": "maxIter", "learning_rate": "stepSize", "max_depth": "maxDepth", "subsample": "subsamplingRate", "min_child_weight": "minInstancesPerNode"}
    made = {own[k]: v for k, v in params.items() if k in own}
    if "colsample_bytree" in params:
        made["featureSubsetStrategy"] = str(params["colsample_bytree"]) if params["colsample_bytree"] < 1 else "all"
    return Pipeline(stages=[VectorAssembler(inputCols=feature_columns(kind), outputCol="features_"), GBTRegressor(featuresCol="features_", labelCol=target, seed=42, **made)])


def forecast_with(model: BoostedTrees, history: np.ndarray, times: list, kind: str, tz: str = LOCAL_TZ) -> list[float]:
    return recursive_forecast(lambda row: model.predict(row.reshape(1, -1))[0], history[-required_history() :], times, kind, tz)


def retrained(matrix: DataFrame, plans: list[tuple[str, str, dict]], target: str = TARGET, dry_run: bool = False):
    """Fits ``(key, feature set, params)`` plans on the whole matrix by key; ``dry_run`` gives the plans back."""
    if dry_run:
        return plans
    return {key: tree_pipeline(kind, params, target).fit(matrix) for key, kind, params in plans}


