"""Forecast metrics as aggregate columns, so that any grouping takes one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(c: str | Column) -> Column:
    """A double; text that is no number, NaN and infinities become null."""
    x = F.col(c) if isinstance(c, str) else c
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def _ratio(n: Column, d: Column) -> Column:
    return F.try_divide(n, d)


def mae(a: Column, p: Column) -> Column:
    return F.avg(F.abs(a - p))


def rmse(a: Column, p: Column) -> Column:
    return F.sqrt(F.avg((a - p) * (a - p)))


def mape(a: Column, p: Column) -> Column:
    """Percent; zero actuals are left out, null when none remain."""
    return F.avg(F.when(a != 0, F.abs(_ratio(a - p, a)))) * 100


def smape(a: Column, p: Column) -> Column:
    """Percent; a pair of zeros counts as no error."""
    size = F.abs(a) + F.abs(p)
    return F.avg(F.when(size == 0, 0.0).otherwise(_ratio(2 * F.abs(a - p), size))) * 100


def metric_columns(actual: str = "actual", predicted: str = "predicted", diagnostics: bool = True) -> list[Column]:
    """The four metrics over pairs of finite numbers, and counts of what was left out."""
    a0, p0 = number(actual), number(predicted)
    valid = a0.isNotNull() & p0.isNotNull()
    a, p = F.when(valid, a0), F.when(valid, p0)
    out = [mae(a, p).alias("mae"), rmse(a, p).alias("rmse"), mape(a, p).alias("mape"), smape(a, p).alias("smape")]
    if diagnostics:
        out += [
            F.count(F.lit(1)).alias("n_obs"), F.count_if(valid).alias("n_valid_obs"), F.count_if(~valid).alias("n_invalid_obs"), F.count_if(a == 0).alias("mape_zero_actual_count"),
            F.count_if(a != 0).alias("mape_valid_count"), F.count_if((F.abs(a) + F.abs(p)) == 0).alias("smape_zero_denominator_count"),
        ]
    return out


def grouped_metrics(predictions: DataFrame, by: list[str] = (), actual: str = "actual", predicted: str = "predicted", diagnostics: bool = True) -> DataFrame:
    """Metrics for each group, null keys included; one row over all without keys."""
    return predictions.groupBy(*by).agg(*metric_columns(actual, predicted, diagnostics))


def error_bundle(actual: str = "actual", predicted: str = "predicted") -> list[Column]:
    """The nine measures of error analysis."""
    a, p = F.col(actual), F.col(predicted)
    return [
        mae(a, p).alias("mae"), rmse(a, p).alias("rmse"), mape(a, p).alias("mape"), smape(a, p).alias("smape"), F.avg(a - p).alias("mean_error"), F.median(a - p).alias("median_error"),
        F.avg((p > a).cast("double")).alias("overprediction_rate"), F.avg((p < a).cast("double")).alias("underprediction_rate"), F.max(F.abs(a - p)).alias("max_absolute_error"),
    ]


def cv_summary(metrics: DataFrame, by: list[str], columns: list[str], fold: str = "fold", single_std: float | None = 0.0) -> DataFrame:
    """Rows, folds and mean, std, min, max of metrics by group.

    A group of one value has the deviation ``single_std``: 0 in summaries of cross-validation, null
    in stability reports.  A null fold counts as one fold.
    """

    def std(c: str) -> Column:
        return F.coalesce(F.stddev_samp(c), F.when(F.count(c) == 1, F.lit(single_std).cast("double"))).alias(f"{c}_std")

    folds = F.count_distinct(fold) + F.max(F.col(fold).isNull().cast("int"))
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), folds.alias("n_folds"), *(x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), std(c), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))))


def variation(mean: str, std: str) -> Column:
    """Coefficient of variation; null for a zero mean."""
    return F.when(F.col(mean) != 0, _ratio(F.col(std), F.col(mean)))


def corrected_skewness(c: str) -> Column:
    """Bias-corrected skewness; null under three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def corrected_kurtosis(c: str) -> Column:
    """Bias-corrected excess kurtosis; null under four values."""
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def quantiles(c: str, shares: dict[str, float]) -> list[Column]:
    """Exact quantiles with linear interpolation."""
    return [F.percentile(c, F.lit(q)).alias(name) for name, q in shares.items()]


def close(a: Column, b: Column, rtol: float = 1e-10, atol: float = 1e-10) -> Column:
    """Within tolerance; two nulls are close, one isn't."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= atol + rtol * F.abs(b))


def compare_with_nulls(df: DataFrame, actual: str, expected: str, order: str, rtol: float = 1e-10, atol: float = 1e-10) -> DataFrame:
    """``(mismatches, first_mismatch)`` of two columns."""
    bad = ~close(F.col(actual), F.col(expected), rtol, atol)
    return df.agg(F.count_if(bad).alias("mismatches"), F.min(F.when(bad, F.col(order))).alias("first_mismatch"))


def percent_reduction(baseline: Column, challenger: Column) -> Column:
    return F.when(baseline != 0, F.try_divide(baseline - challenger, baseline) * 100)


def rank_by(metric: str, *ties: str, how: str = "row", within: list[str] = ()) -> Column:
    """``min`` (competition), ``row`` (ordinal) rank by a metric, then by ``ties``."""
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return F.rank().over(w.orderBy(metric)) if how == "min" else F.row_number().over(w.orderBy(metric, *ties))
