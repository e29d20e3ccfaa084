"""Rankings, improvements, stability and cost tables over metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import METRICS, PRIMARY_METRIC, SECONDARY_METRIC
from ..functions.metrics import cv_summary, percent_reduction, rank_by, variation
from .analysis import MODEL, model_order


def metrics_long(metrics: DataFrame, columns: list[str] = METRICS, ids: list[str] = (MODEL,)) -> DataFrame:
    return metrics.unpivot(list(ids), list(columns), "metric", "value")


def metric_ranking(metrics: DataFrame, columns: list[str] = METRICS) -> DataFrame:
    """Competition ranks by metric; equal values share the least rank."""
    return metrics.withColumns({f"{c}_rank": rank_by(c, how="min") for c in columns})


def rankings_long(metrics: DataFrame, columns: list[str] = METRICS) -> DataFrame:
    """One row per metric and model with its ordinal rank."""
    w = Window.partitionBy("metric").orderBy("value", model_order(F.col(MODEL)), MODEL)
    return metrics_long(metrics, columns).withColumn("rank", F.row_number().over(w))


def ranking_pivot(long: DataFrame, columns: list[str] = METRICS) -> DataFrame:
    """The model at each (rank, metric)."""
    return long.groupBy("rank").pivot("metric", list(columns)).agg(F.first(MODEL))


def final_metrics(rows: DataFrame, metric: str = PRIMARY_METRIC) -> DataFrame:
    return rows.withColumn("rank", rank_by(metric, MODEL))


def winner(metrics: DataFrame, metric: str = PRIMARY_METRIC) -> DataFrame:
    """The first row by metric, then catalogue order."""
    return metrics.orderBy(metric, model_order(F.col(MODEL)), MODEL).limit(1)


def improvements(metrics: DataFrame, pairs: DataFrame, columns: list[str] = METRICS) -> DataFrame:
    """Long form by pair and metric: values, absolute and percent reduction, winner (a tie goes to the baseline).

    ``pairs``: a small table ``(comparison, baseline, challenger)``.
    """
    long = metrics_long(metrics, columns)
    b = long.select(F.col(MODEL).alias("baseline"), "metric", F.col("value").alias("baseline_value"))
    c = long.select(F.col(MODEL).alias("challenger"), F.col("metric"), F.col("value").alias("challenger_value"))
    out = pairs.join(b, "baseline").join(c, ["challenger", "metric"])
    base, other = F.col("baseline_value"), F.col("challenger_value")
    return out.select("comparison", "metric", "baseline", "challenger", "baseline_value", "challenger_value", (base - other).alias("absolute_reduction"), percent_reduction(base, other).alias("percent_reduction"), F.when(other < base, F.col("challenger")).otherwise(F.col("baseline")).alias("winner"))


def improves(improvement: DataFrame, metric: str = PRIMARY_METRIC) -> DataFrame:
    return improvement.filter((F.col("metric") == metric) & (F.col("absolute_reduction") > 0))


def metric_comparison(cv_metrics: DataFrame, columns: list[str] = METRICS) -> DataFrame:
    out = cv_summary(cv_metrics, [MODEL], columns)
    return out.withColumn("rank", rank_by(f"{PRIMARY_METRIC}_mean", MODEL))


def cv_stability(cv_metrics: DataFrame, columns: list[str] = METRICS) -> DataFrame:
    """Mean, deviation and coefficient of variation across folds; one fold has neither of the last two."""
    out = cv_summary(cv_metrics, [MODEL], columns, single_std=None)
    return out.withColumns({f"{c}_cv": variation(f"{c}_mean", f"{c}_std") for c in columns})


def fold_stability(cv_metrics: DataFrame, models: list[str], columns: list[str] = METRICS) -> DataFrame:
    """Each fold's values by model and the model of the least value by metric."""
    at = model_order(F.col(MODEL))
    values = [F.max(F.when(F.col(MODEL) == m, F.col(c))).alias(f"{c}_{m}") for c in columns for m in models]
    winners = [F.min(F.struct(F.col(c), at.alias("o"), F.col(MODEL)))[MODEL].alias(f"{c}_winner") for c in columns]
    return cv_metrics.groupBy("fold").agg(*values, *winners)


def win_counts(stability: DataFrame, metric: str = PRIMARY_METRIC) -> DataFrame:
    return stability.groupBy(F.col(f"{metric}_winner").alias(MODEL)).agg(F.count(F.lit(1)).alias("n_folds_won"))


def fold_comparison(cv_metrics: DataFrame, baseline: str, challenger: str, columns: list[str] = METRICS) -> DataFrame:
    """Folds that both models have: values, reductions, winner."""
    b = cv_metrics.filter(F.col(MODEL) == baseline).select("fold", *(F.col(c).alias(f"{c}_baseline") for c in columns))
    c_ = cv_metrics.filter(F.col(MODEL) == challenger).select("fold", *(F.col(c).alias(f"{c}_challenger") for c in columns))
    out = b.join(c_, "fold")
    for c in columns:
        x, y = F.col(f"{c}_baseline"), F.col(f"{c}_challenger")
        out = out.withColumns({f"{c}_absolute_reduction": x - y, f"{c}_percent_reduction": percent_reduction(x, y), f"{c}_winner": F.when(y < x, challenger).otherwise(baseline)})
    return out


def tuning_summary(metrics: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Cross-validation summary by parameter set with its parameters, best first."""
    out = cv_summary(metrics, ["parameter_set_id"], METRICS)
    if grid is not None:
        out = out.join(F.broadcast(grid), "parameter_set_id", "left")  # the parameter grid
    return out.orderBy(f"{PRIMARY_METRIC}_mean", f"{SECONDARY_METRIC}_mean", "parameter_set_id")


def best_parameters(summary: DataFrame) -> DataFrame:
    return summary.orderBy(f"{PRIMARY_METRIC}_mean", f"{SECONDARY_METRIC}_mean", "parameter_set_id").limit(1)


def select_parameter_set(rows: DataFrame, parameter_set_id) -> DataFrame:
    out = rows.filter(F.col("parameter_set_id").cast("string") == str(parameter_set_id))
    if out.isEmpty():
        raise ValueError(f"no rows of parameter set {parameter_set_id}")
    return out


TIMES = ["train_time_seconds", "prediction_time_seconds", "total_runtime_seconds"]


def runtime_summary(metrics: DataFrame, by: list[str] = ("parameter_set_id",)) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count_distinct("fold").alias("n_folds"), *(f(c).alias(f"{c}_{n}") for c in TIMES for n, f in (("sum", F.sum), ("mean", F.avg), ("max", F.max))))


def with_total(detail: DataFrame, by: str, total: str = "total") -> DataFrame:
    """Detail sums by ``by`` and one grand total row, in one rollup."""
    numbers = [f.name for f in detail.schema.fields if f.name != by and f.dataType.typeName() in ("double", "long", "integer")]
    out = detail.rollup(by).agg(F.grouping(by).alias("g"), *(F.sum(c).alias(c) for c in numbers))
    return out.withColumn(by, F.when(F.col("g") == 1, F.lit(total)).otherwise(F.col(by))).drop("g")


def time_cost(tuning: DataFrame, retraining: DataFrame, final: DataFrame) -> DataFrame:
    """Known end-to-end seconds by model and competition ranks of tuning, prediction and sum."""
    out = tuning.select(MODEL, "tuning_seconds").join(retraining.select(MODEL, "retrain_seconds"), MODEL).join(final.select(MODEL, "load_seconds", "predict_seconds"), MODEL)
    out = out.withColumn("known_end_to_end_seconds", F.col("tuning_seconds") + F.col("retrain_seconds") + F.col("load_seconds") + F.col("predict_seconds"))
    return out.withColumns({f"{c}_rank": rank_by(c, how="min") for c in ("tuning_seconds", "predict_seconds", "known_end_to_end_seconds")})


def accuracy_and_runtime(metrics: DataFrame, runtime: DataFrame) -> DataFrame:
    return metrics.join(runtime, MODEL)


def gap_to_best(metrics: DataFrame, metric: str = PRIMARY_METRIC) -> DataFrame:
    """Percent above the best model."""
    best = F.min(metric).over(Window.partitionBy(F.lit(0)))
    return metrics.withColumn("percent_gap_to_best", F.try_divide(F.col(metric) - best, best) * 100)


def reference_comparison(official: DataFrame, other: DataFrame, metric: str = PRIMARY_METRIC) -> DataFrame:
    both = official.unionByName(other, allowMissingColumns=True)
    return both.withColumn("rank", rank_by(metric, MODEL))


def bool_text(c: str | Column) -> Column:
    """true/1/yes/y and false/0/no/n in any case; anything else is null, for ``require_bool`` to report."""
    x = F.lower(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")))
    return F.when(x.isin("true", "1", "yes", "y"), True).when(x.isin("false", "0", "no", "n"), False)


def require_bool(df: DataFrame, c: str) -> DataFrame:
    bad = df.filter(bool_text(c).isNull()).select(F.col(c).cast("string")).limit(5).collect()
    if bad:
        raise ValueError(f"{c} holds what is no boolean: {[r[0] for r in bad]}")
    return df.withColumn(c, bool_text(c))


def weakness_table(metrics: DataFrame, models: list[str], columns: list[str]) -> DataFrame:
    """Metric by model in absolute values, with reductions against the first model and improvement flags."""
    long = metrics_long(metrics.withColumns({c: F.abs(c) for c in columns}), columns)
    wide = long.groupBy("metric").pivot(MODEL, models).agg(F.first("value"))
    base = F.col(f"`{models[0]}`")
    return wide.withColumns({k: v for m in models[1:] for k, v in ((f"{m}_reduction_pct", percent_reduction(base, F.col(f"`{m}`"))), (f"{m}_improves", F.col(f"`{m}`") < base))})
