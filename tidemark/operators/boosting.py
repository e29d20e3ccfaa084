"""Grid search of boosted trees: many sets at once over one binned matrix by fold.

* A fold's training rows are binned once to a byte per feature and packed into one row; a task gets
  that row and a batch of sets, so the matrix is copied by batch (``TOGETHER`` sets and all their
  numbers of trees), never by set.
* Sets that differ in ``n_estimators`` alone are one run: the first trees of the longest are the
  trees of the others.
* All sets of a batch grow level by level together: gradient histograms by (set, node, feature, bin)
  come from one count over the rows, and every node of every set picks its split from them at once.
* Forecasts of all sets and blocks of a fold run side by side, a step of the horizon at a time.

Draws of rows and columns are the same for all sets, so a set's trees don't depend on its batch.
"""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CALENDAR, LAGS, LOCAL_TZ, MEAN_WINDOWS, STD_WINDOWS, TARGET, TIMESTAMP, feature_columns, feature_set, required_history
from .features import feature_matrix
from .forecast import PREDICTION_COLUMNS, block_rows

#: Sets of a batch, not counting those that differ in ``n_estimators`` alone, and bins of a feature.
TOGETHER, BINS = 6, 64
DEFAULTS = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "subsample": 1.0, "colsample_bytree": 1.0, "min_child_weight": 1, "reg_lambda": 1.0}


def binned(x: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Codes of a byte and the cuts by feature: a code of at most ``k`` means a value of at most ``cuts[k]``."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    return np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)]).astype(np.uint8), cuts


def boost(codes: np.ndarray, cells: np.ndarray, y: np.ndarray, sets: list[dict], rounds: int, seed: int = 42) -> dict[str, np.ndarray]:
    """Trees of all sets, which share ``max_depth``: ``feature`` and ``cut`` (tree, set, node), ``leaf`` and ``rows`` (tree, set, leaf), ``base``.

    Trees are complete: node ``i`` has children ``2 i + 1`` and ``2 i + 2``; feature -1 sends all rows left.
    """
    n, width = codes.shape
    many, depth = len(sets), int(sets[0]["max_depth"])
    first = np.concatenate(([0], np.cumsum(cells)))
    total = int(first[-1])
    flat = codes.astype(np.int64) + first[:-1]
    of = np.repeat(np.arange(width), cells)
    begin, end = first[of], np.isin(np.arange(total), first[1:] - 1)
    rate, least, reg, rows_share, columns_share = (np.array([float(s[k]) for s in sets]) for k in ("learning_rate", "min_child_weight", "reg_lambda", "subsample", "colsample_bytree"))
    out = {"feature": np.full((rounds, many, (1 << depth) - 1), -1, np.int16), "cut": np.zeros((rounds, many, (1 << depth) - 1), np.int16), "leaf": np.zeros((rounds, many, 1 << depth)), "rows": np.zeros((rounds, many, 1 << depth)), "base": np.array(float(y.mean()))}
    rng = np.random.default_rng(seed)
    f = np.full((many, n), float(y.mean()))
    at = np.arange(many)[:, None]
    for t in range(rounds):
        draw, order = rng.random(n), rng.permutation(width)
        use = draw < rows_share[:, None]
        use[~use.any(axis=1)] = True
        allowed = (np.argsort(order) < np.maximum(1, np.round(columns_share * width))[:, None])[:, of] & ~end
        g = y - f
        weight, count = np.where(use, g, 0.0), use.astype(float)
        node, live = np.zeros((many, n), np.int64), np.ones((many, 1), bool)
        for d in range(depth):
            m = 1 << d
            sets_, _ = np.nonzero(live)  # nodes that may split, numbered without gaps
            nth = np.cumsum(live.ravel()).reshape(live.shape) - 1
            i, j = np.nonzero(live[at, node])
            key = (nth[i, node[i, j]][:, None] * total + flat[j]).ravel()
            sums, ns = (np.cumsum(np.bincount(key, np.repeat(w[i, j], width), len(sets_) * total).reshape(-1, total), axis=1) for w in (weight, count))
            all_sum, all_n = sums[:, first[1] - 1], ns[:, first[1] - 1]
            ls, ln = (c - np.where(begin > 0, c[:, begin - 1], 0.0) for c in (sums, ns))
            rn, lam, few = all_n[:, None] - ln, reg[sets_, None], least[sets_, None]
            fits = (ln >= few) & (rn >= few) & allowed[sets_]
            gain = np.where(fits, ls**2 / (ln + lam) + (all_sum[:, None] - ls) ** 2 / (rn + lam), -1.0)
            best = gain.argmax(axis=1)
            won = np.take_along_axis(gain, best[:, None], 1)[:, 0] - all_sum**2 / (all_n + reg[sets_]) > 1e-12
            if not won.any():
                node <<= depth - d
                break
            feature, cut = np.full((many, m), -1), np.zeros((many, m), np.int64)
            feature[live], cut[live] = np.where(won, of[best], -1), best - begin[best]
            out["feature"][t, :, m - 1 : 2 * m - 1], out["cut"][t, :, m - 1 : 2 * m - 1] = feature, cut
            mine, edge = feature[at, node], cut[at, node]
            node = 2 * node + ((mine >= 0) & (codes[np.arange(n), mine] > edge))
            rows = np.bincount((at * 2 * m + node).ravel(), count.ravel(), many * 2 * m).reshape(many, -1)
            live = np.repeat(feature >= 0, 2, axis=1) & (rows >= 2 * least[:, None])
            if not live.any():
                node <<= depth - d - 1
                break
        key = (at * (1 << depth) + node).ravel()
        sums, ns = (np.bincount(key, w.ravel(), many * (1 << depth)).reshape(many, -1) for w in (weight, count))
        out["rows"][t] = ns
        out["leaf"][t] = rate[:, None] * sums / (ns + reg[:, None])
        f += out["leaf"][t][at, node]
    return out


def predict(trees: dict[str, np.ndarray], cuts: list[np.ndarray], x: np.ndarray, which: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """The value of every row of ``x`` by the first ``rounds[i]`` trees of set ``which[i]``."""
    depth = int(trees["leaf"].shape[2]).bit_length() - 1
    codes = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
    t, i = np.arange(int(rounds.max(initial=0)))[:, None], np.arange(len(x))
    node = np.zeros((len(t), len(x)), np.int64)
    for _ in range(depth):
        feature = trees["feature"][t, which, node]
        node = 2 * node + 1 + ((feature >= 0) & (codes[i, feature] > trees["cut"][t, which, node]))
    leaf = trees["leaf"][t, which, node - (1 << depth) + 1]
    return float(trees["base"]) + np.where(t < rounds, leaf, 0.0).sum(axis=0)


def listed(trees: dict[str, np.ndarray], cuts: list[np.ndarray], which: int = 0) -> list[list[tuple]]:
    """One set's trees as lists of nodes ``(feature or -1, cut, left, right, leaf value, rows)``, nodes that don't split left out."""
    out = []
    for feature, cut, leaf, rows in zip(trees["feature"][:, which], trees["cut"][:, which], trees["leaf"][:, which], trees["rows"][:, which]):
        splits, count = len(feature), np.concatenate((np.zeros(len(feature)), rows))
        for i in range(splits - 1, -1, -1):
            count[i] = count[2 * i + 1] + count[2 * i + 2]
        nodes: list = []

        def add(i: int) -> int:
            while i < splits and feature[i] < 0:
                i = 2 * i + 1
            at = len(nodes)
            nodes.append(None)
            if i >= splits:
                nodes[at] = (-1, 0.0, 0, 0, float(leaf[i - splits]), float(count[i]))
            else:
                nodes[at] = (int(feature[i]), float(cuts[feature[i]][cut[i]]), add(2 * i + 1), add(2 * i + 2), 0.0, float(count[i]))
            return at

        add(0)
        out.append(nodes)
    return out


def fitted_trees(matrix: DataFrame, params: dict, kind: str, target: str = TARGET, seed: int = 42) -> tuple[float, list[list[tuple]]]:
    """The base value and trees of one set, fitted in a task on the rows of one series; only the model comes to the driver."""
    columns, full = feature_columns(kind), DEFAULTS | params
    rows = matrix.select(TIMESTAMP, F.col(target).cast("double").alias("y_"), *columns)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIMESTAMP)
        codes, cuts = binned(pdf[columns].to_numpy(float))
        trees = boost(codes, np.array([len(c) + 1 for c in cuts]), pdf["y_"].to_numpy(float), [full], int(full["n_estimators"]), seed)
        return pd.DataFrame({"body": [json.dumps([float(trees["base"]), listed(trees, cuts)])]})

    base, made = json.loads(rows.groupBy(F.lit(0).alias("one")).applyInPandas(fit, "body string").first()["body"])
    return base, [[tuple(n) for n in t] for t in made]


def step_features(known: np.ndarray, at: pd.DatetimeIndex, kind: str) -> np.ndarray:
    """The feature rows of one step for many histories (rows) at their local times."""
    s = feature_set(kind)
    made = {"hour": at.hour, "day_of_week": at.dayofweek, "is_weekend": (at.dayofweek >= 5).astype(int), "month": at.month}
    columns = [known[:, -k] for k in LAGS[s]] + [known[:, -w:].mean(axis=1) for w in MEAN_WINDOWS[s]] + [known[:, -w:].std(axis=1, ddof=1) for w in STD_WINDOWS[s]]
    return np.column_stack([*columns, *(np.asarray(made[c], float) for c in CALENDAR[s])])


def batches(grid: list[tuple[str, dict]]) -> list[list[tuple[str, dict]]]:
    """Sets by depth, those that differ in ``n_estimators`` alone side by side, ``TOGETHER`` runs a batch."""
    runs: dict[str, list] = {}
    for name, params in grid:
        if unknown := set(params) - set(DEFAULTS):
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        full = DEFAULTS | params
        runs.setdefault(json.dumps({k: float(v) for k, v in full.items() if k != "n_estimators"}), []).append((name, full))
    by_depth: dict[int, list] = {}
    for same in runs.values():
        by_depth.setdefault(int(same[0][1]["max_depth"]), []).append(same)
    return [sum(group[i : i + TOGETHER], []) for group in by_depth.values() for i in range(0, len(group), TOGETHER)]


def packed_folds(cv: DataFrame, matrix: DataFrame, kind: str, series: list[str] = (), target: str = TARGET) -> DataFrame:
    """``(series..., fold, n_train_rows, matrix)``: a fold's training rows as bytes, binned once."""
    keys, columns = list(series), feature_columns(kind)
    rows = matrix.join(cv.filter("role = 'train'").select(*keys, "fold", TIMESTAMP), [*keys, TIMESTAMP]).select(*keys, "fold", TIMESTAMP, F.col(target).cast("double").alias("y_"), *columns)
    kinds = "".join(f"`{k}` {matrix.schema[k].dataType.simpleString()}, " for k in keys)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIMESTAMP)
        codes, cuts = binned(pdf[columns].to_numpy(float))
        body = io.BytesIO()
        np.savez(body, codes=codes, y=pdf["y_"].to_numpy(float), **{f"c{i}": c for i, c in enumerate(cuts)})
        return pdf[[*keys, "fold"]].iloc[:1].assign(n_train_rows=len(pdf), matrix=body.getvalue())

    return rows.groupBy(*keys, "fold").applyInPandas(pack, f"{kinds}fold int, n_train_rows bigint, matrix binary")


def grid_cv(source: DataFrame, cv: DataFrame, grid: list[tuple[str, dict]], kind: str, horizon: int = 24, series: list[str] = (), tz: str = LOCAL_TZ, target: str = TARGET, seed: int = 42) -> DataFrame:
    """Long-form predictions of every (set, fold): recursive rolling-origin forecasts, actuals handed over after each block."""
    spark, keys, columns, back = source.sparkSession, list(series), feature_columns(kind), required_history()
    folds = packed_folds(cv, feature_matrix(source, kind, keys, tz, target), kind, keys, target)
    blocks = block_rows(source, cv.filter("role = 'validation'"), horizon, keys, target)
    tested = blocks.groupBy(*keys, "fold").agg(F.array_sort(F.collect_list(F.struct("origin_block", "forecast_origin", "history", "steps"))).alias("blocks"))  # a fold's validation stretch
    made_of = batches(grid)
    dealt = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(made_of)], "batch int, sets string")
    jobs = folds.join(tested, [*keys, "fold"]).join(F.broadcast(dealt))  # batches of the grid: their number is set by the caller
    kinds = "".join(f"`{k}` {source.schema[k].dataType.simpleString()}, " for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        job = pdf.iloc[0]
        sets, stored = json.loads(job["sets"]), np.load(io.BytesIO(job["matrix"]))
        cuts = [stored[f"c{i}"] for i in range(len(columns))]
        runs, which = [], []
        for _, p in sets:
            same = {k: v for k, v in p.items() if k != "n_estimators"}
            if same not in runs:
                runs.append(same)
            which.append(runs.index(same))
        rounds = np.array([int(p["n_estimators"]) for _, p in sets])
        trees = boost(stored["codes"], np.array([len(c) + 1 for c in cuts]), stored["y"], runs, int(rounds.max()), seed)
        made = []
        lengths = [len(b["steps"]) for b in job["blocks"]]
        for length in sorted(set(lengths)):  # the last block may be short
            own = [b for b, k in zip(job["blocks"], lengths) if k == length]
            past = np.array([np.asarray(b["history"], float)[-back:] for b in own])
            if past.shape[1] < back or not np.isfinite(past).all():
                raise ValueError(f"the history needs {back} finite values")
            known = np.tile(past, (len(sets), 1))
            w, r = (np.repeat(v, len(own)) for v in (np.array(which), rounds))
            for step in range(length):
                times = pd.DatetimeIndex([b["steps"][step][TIMESTAMP] for b in own])
                local = (times.tz_localize("UTC") if times.tz is None else times).tz_convert(tz)
                value = predict(trees, cuts, step_features(known, pd.DatetimeIndex(np.tile(local.tz_localize(None).to_numpy(), len(sets))), kind), w, r)
                known = np.column_stack((known[:, 1:], value))
                for i, (name, _) in enumerate(sets):
                    for j, b in enumerate(own):
                        s = b["steps"][step]
                        made.append((*(job[k] for k in keys), s[TIMESTAMP], s["actual"], value[i * len(own) + j], "boosted_trees", kind, name, job["fold"], b["forecast_origin"], s["horizon_step"], b["origin_block"], False))
        return pd.DataFrame(made, columns=[*keys, *PREDICTION_COLUMNS])

    schema = f"{kinds}timestamp {source.schema[TIMESTAMP].dataType.simpleString()}, actual double, predicted double, model_name string, feature_set string, parameter_set_id string, fold int, forecast_origin timestamp, horizon_step int, origin_block int, used_actual_future_for_features boolean"
    jobs = jobs.repartition(max(1, 8 * len(made_of)), *keys, "fold", "batch")  # small rows, long tasks: a number that isn't merged again
    return jobs.groupBy(*keys, "fold", "batch").applyInPandas(run, schema)
