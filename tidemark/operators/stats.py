"""Forecast comparison and residual tests.

Statistics are column expressions over stretches and pieces of the series (``ordered``); products at
many lags run in numpy by stretch, and p-values of non-elementary distributions in Arrow batches, on
tables of a row per test.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TIMESTAMP
from ..functions.metrics import corrected_kurtosis, corrected_skewness, percent_reduction
from ..functions.tails import chi2_p, normal_p, normal_upper_p, sign_p, t_p
from ..sources.staging import staged
from . import ordered
from .analysis import MODEL

LOSSES = ("squared_error", "absolute_error")


def loss(kind: str, actual: str = "actual", predicted: str = "predicted") -> Column:
    r = F.col(actual) - F.col(predicted)
    return {"squared_error": r * r, "absolute_error": F.abs(r)}[kind]


def loss_wide(predictions: DataFrame, kind: str, models: list[str]) -> DataFrame:
    """One row per timestamp, block and step with a loss column by model."""
    return predictions.withColumn("loss", loss(kind)).groupBy(TIMESTAMP, "actual", "origin_block", "horizon_step").pivot(MODEL, models).agg(F.first("loss"))


def differentials(predictions: DataFrame, pairs: list[tuple[str, str, str]], kinds: tuple[str, ...] = LOSSES) -> DataFrame:
    """``(comparison, baseline, challenger, loss_type, timestamp, origin_block, horizon_step, a, b)``: both losses of each pair."""
    names = sorted({m for _, x, y in pairs for m in (x, y)})
    losses = predictions.groupBy(TIMESTAMP, "origin_block", "horizon_step").agg(*(F.max(F.when(F.col(MODEL) == m, loss(k))).alias(f"{k}/{m}") for k in kinds for m in names))
    rows = F.array(*(F.struct(F.lit(c).alias("comparison"), F.lit(x).alias("baseline"), F.lit(y).alias("challenger"), F.lit(k).alias("loss_type"), F.col(f"`{k}/{x}`").alias("a"), F.col(f"`{k}/{y}`").alias("b")) for c, x, y in pairs for k in kinds))
    return losses.select(TIMESTAMP, "origin_block", "horizon_step", F.explode(rows).alias("x")).select("x.*", TIMESTAMP, "origin_block", "horizon_step")


def small_sample_factor(n: Column, horizon: int) -> Column:
    """The Harvey-Leybourne-Newbold factor; 1 where it isn't positive."""
    inside = F.try_divide(n + 1 - 2 * horizon + F.try_divide(F.lit(horizon * (horizon - 1)).cast("double"), n), n)
    return F.when(inside > 0, F.sqrt(inside)).otherwise(1.0)


def diebold_mariano(rows: DataFrame, by: list[str], horizon: int = 1, lags: int | None = None, alternative: str = "two_sided", estimator: str = "newey_west", correct: bool = True, order: str = TIMESTAMP) -> DataFrame:
    """Statistic, p-value and parts by group over the loss differential ``a - b``; positive means a smaller loss of b.

    Groups of fewer than three finite differences, or without positive long-run variance, have a null statistic.
    """
    d = F.col("a") - F.col("b")
    rows = rows.filter(d.isNotNull() & ~F.isnan(d)).withColumn("d", d)
    most = max(horizon - 1, 0) if lags is None else lags
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("d").alias("mean_loss_difference"), F.avg("a").alias("baseline_loss"), F.avg("b").alias("challenger_loss"), (F.var_pop("d") * F.count(F.lit(1))).alias("g0"))
    if most:
        sums = ordered.lagged_sums(rows, by, "d", most, order).filter("lag > 0")
        g = ordered.beside(g, sums.groupBy(*by).agg(*(F.max(F.when(F.col("lag") == k, F.col("sxy"))).alias(f"g{k}") for k in range(1, most + 1))), by)
    n = F.col("n")
    used = F.lit(0.0)
    for k in range(1, most + 1):
        weight = (1 - k / (most + 1.0)) if estimator == "newey_west" else 1.0
        used = used + F.when(n > k, 2 * weight * F.col(f"g{k}") / n).otherwise(0.0)
    long_run = F.col("g0") / n + used
    factor = small_sample_factor(n, horizon) if correct else F.lit(1.0)
    stat = F.when((n >= 3) & (long_run > 0), F.try_divide(F.col("mean_loss_difference"), F.sqrt(F.try_divide(F.when(long_run > 0, long_run), n))) * factor)
    out = g.select(*by, n.cast("bigint").alias("n_obs"), "baseline_loss", "challenger_loss", "mean_loss_difference", (F.col("g0") / n).alias("variance_loss_difference"), long_run.alias("long_run_variance"), stat.alias("statistic"))
    b, c = F.col("baseline_loss"), F.col("challenger_loss")
    return out.withColumns({"p_value": t_p(F.col("statistic"), F.col("n_obs") - 1, alternative), "percent_reduction": percent_reduction(b, c), "lower_loss": F.when(c < b, "challenger").when(b < c, "baseline").otherwise("tie"), "forecast_horizon": F.lit(horizon), "hac_lags": F.lit(most)})


def adjusted(tests: DataFrame, within: list[str], p: str = "p_value") -> DataFrame:
    """Adds ``p_holm`` and ``p_bh`` inside each group; null p-values stay null and don't count.

    Both depend on a p-value alone, so they are made for the distinct ones of a group: counts, then a
    running maximum and a running minimum from the end, each in two levels over pieces of the order.
    A piece is a sixty-fourth of an octave, so uniform p-values of one family lie in about a hundred.
    """
    keys, v = list(within), F.col("p_").cast("double")
    x = F.col(p).cast("double")
    t = staged(tests.withColumn("p_", F.when(~F.isnan(x), x)))
    piece = F.when(v > 0, F.floor(64 * F.log2(F.when(v > 0, v)))).otherwise(F.lit(-(1 << 40)))
    distinct = t.filter("p_ is not null").groupBy(*keys, "p_").agg(F.count(F.lit(1)).alias("k_"))
    rows = ordered.running(distinct, keys, "p_", {"before_": ("sum", F.col("k_"), "before"), "m_": ("sum", F.col("k_"), "all")}, piece)
    before = F.coalesce("before_", F.lit(0))
    holm = F.least((F.col("m_") - before) * v, F.lit(1.0))
    bh = F.least(v * F.col("m_") / (before + F.col("k_")), F.lit(1.0))
    made = ordered.running(rows, keys, "p_", {"p_holm": ("max", holm, "up"), "p_bh": ("min", bh, "down")}, piece)
    return ordered.beside(t, made.select(*keys, "p_", "p_holm", "p_bh"), [*keys, "p_"]).drop("p_")


def dm_by_block(rows: DataFrame) -> DataFrame:
    """One-step test on the mean loss of each origin block."""
    keys = ["comparison", "baseline", "challenger", "loss_type"]
    means = rows.groupBy(*keys, "origin_block").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return diebold_mariano(means, keys, order="origin_block")


def dm_by_horizon(rows: DataFrame) -> DataFrame:
    """One test per step across blocks, adjusted inside each comparison and loss."""
    keys = ["comparison", "baseline", "challenger", "loss_type"]
    return adjusted(diebold_mariano(rows, [*keys, "horizon_step"], order="origin_block"), ["comparison", "loss_type"])


def dm_by_timestamp(rows: DataFrame, horizon: int = 24) -> DataFrame:
    return diebold_mariano(rows, ["comparison", "baseline", "challenger", "loss_type"], horizon=horizon, lags=horizon - 1)


def horizon_significance(by_horizon: DataFrame, alpha: float = 0.05) -> DataFrame:
    return by_horizon.filter("loss_type = 'squared_error'").groupBy("comparison").agg(F.count(F.lit(1)).alias("n_horizons"), F.count_if(F.col("p_holm") < alpha).alias("n_significant_holm"), F.count_if(F.col("p_bh") < alpha).alias("n_significant_bh"), F.avg("percent_reduction").alias("mean_percent_reduction"))


def dm_conclusion(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    text = F.when(F.col("p_value").isNull(), "not_tested").when(F.col("p_value") >= alpha, "no_significant_difference").when(F.col("mean_loss_difference") > 0, "challenger_significantly_better").otherwise("baseline_significantly_better")
    return tests.filter("loss_type = 'squared_error'").withColumn("conclusion", text)


def acf(df: DataFrame, value: str, by: list[str], max_lag: int, order: str = TIMESTAMP) -> DataFrame:
    """Biased autocorrelations for lags 0 to ``max_lag`` with the 95 % bound, from products summed by stretch."""
    g = ordered.lagged_sums(df, by, value, max_lag, order)
    whole = ordered.with_group(g, by, whole_=F.max(F.when(F.col("lag") == 0, F.col("sxy"))), n_=F.max("n"))
    bound = 1.96 / F.sqrt("n_")
    r = F.try_divide(F.col("sxy"), F.col("whole_"))
    return whole.select(*by, "lag", r.alias("acf"), F.col("n_").alias("n"), bound.alias("bound"), ((F.col("lag") > 0) & (F.abs(r) > bound)).alias("exceeds"))


def pacf(correlations: DataFrame, by: list[str]) -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion on the biased autocorrelations."""
    kinds = ", ".join(f"`{k}` {correlations.schema[k].dataType.simpleString()}" for k in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].to_numpy()
        out, phi, v = [1.0], np.empty(0), 1.0
        for k in range(1, len(r)):
            a = (r[k] - phi @ r[k - 1 : 0 : -1]) / v if k > 1 else r[1]
            phi = np.append(phi - a * phi[::-1], a)
            v *= 1 - a * a
            out.append(a)
        return pdf[[*by, "lag"]].assign(pacf=out)

    return correlations.groupBy(*by).applyInPandas(run, f"{kinds}, lag int, pacf double")


def ljung_box(correlations: DataFrame, by: list[str], lags: tuple[int, ...] = (24, 48, 72, 168), alpha: float = 0.05) -> DataFrame:
    n = F.col("n").cast("double")
    w = Window.partitionBy(*by).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    term = F.when(F.col("lag") > 0, F.try_divide(F.col("acf") * F.col("acf"), n - F.col("lag"))).otherwise(0.0)
    out = correlations.withColumn("statistic", n * (n + 2) * F.sum(term).over(w)).filter(F.col("lag").isin(*lags)).select(*by, "lag", "statistic")
    return out.withColumn("p_value", chi2_p(F.col("statistic"), F.col("lag"))).withColumn("reject_white_noise_null", F.col("p_value") < alpha)


def centre_and_randomness(df: DataFrame, value: str, by: list[str], alpha: float = 0.05, order: str = TIMESTAMP) -> DataFrame:
    """One-sample t, exact sign test, and the runs test around zero (zeros left out; half-unit correction for fewer than 50 values).

    Runs are counted in stretches that see the last sign of the stretch before.
    """
    x = F.col(value)
    df = df if getattr(df, "_tidemark_staged", False) else staged(df.select(*by, order, x.cast("double").alias(value)))
    signs = ordered.chunks(df.filter(x != 0).select(*by, order, (x > 0).cast("int").alias("s")), by, order, before=1)
    signs = signs.withColumn("turn", (F.col("s") != F.lag("s").over(ordered.window(by))).cast("int")).filter("own_")
    runs = signs.groupBy(*by).agg(F.sum("s").cast("double").alias("pos"), F.sum(1 - F.col("s")).cast("double").alias("neg"), (F.sum(F.coalesce("turn", F.lit(0))) + 1).cast("double").alias("runs"))
    base = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    t = F.try_divide(F.col("mean"), F.try_divide(F.col("sd"), F.sqrt("n")))
    p, q, m = F.col("pos"), F.col("neg"), F.col("pos") + F.col("neg")
    expected = 1 + F.try_divide(2 * p * q, m)
    variance = F.try_divide(2 * p * q * (2 * p * q - m), m * m * (m - 1))
    gap = F.col("runs") - expected
    shifted = F.when(m >= 50, gap).when(gap > 0.5, gap - 0.5).when(gap < -0.5, gap + 0.5).otherwise(0.0)
    z = F.when((p > 0) & (q > 0) & (variance > 0), F.try_divide(shifted, F.sqrt(F.when(variance > 0, variance))))
    out = ordered.beside(base, runs, by).withColumns({"mean_zero_t_statistic": t, "runs_test_z_statistic": z})
    out = out.withColumns({"mean_zero_p_value": t_p(F.col("mean_zero_t_statistic"), F.col("n") - 1), "sign_balance_p_value": sign_p(p, m), "runs_test_p_value": normal_p(F.col("runs_test_z_statistic"))})
    rejects = {f"{k}_reject": F.col(f"{k}_p_value") < alpha for k in ("mean_zero", "sign_balance", "runs_test")}
    return out.withColumns(rejects).select(*by, "n", "mean_zero_t_statistic", "mean_zero_p_value", F.coalesce(p, F.lit(0.0)).cast("bigint").alias("positive_count"), F.coalesce(q, F.lit(0.0)).cast("bigint").alias("negative_count"), "sign_balance_p_value", "runs_test_z_statistic", "runs_test_p_value", *rejects)


def jarque_bera(df: DataFrame, value: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    n, s, k = F.count(value).cast("double"), F.skewness(value), F.kurtosis(value)
    stat = n / 6 * (s * s + k * k / 4)
    return df.groupBy(*by).agg(stat.alias("statistic")).withColumn("test_name", F.lit("Jarque-Bera")).withColumn("p_value", F.exp(-F.col("statistic") / 2)).withColumn("reject_normality_null", F.col("p_value") < alpha)


def dagostino(df: DataFrame, value: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    """The omnibus K2 of skewness and kurtosis, from eight values on."""
    g = df.groupBy(*by).agg(F.count(value).cast("double").alias("n"), F.skewness(value).alias("s"), (F.kurtosis(value) + 3).alias("k")).filter("n >= 8")
    n, s, k = F.col("n"), F.col("s"), F.col("k")
    y = s * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    delta, alpha_ = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.log(y / alpha_ + F.sqrt(y * y / alpha_ / alpha_ + 1))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (k - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    inside = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = ((1 - 2 / (9 * a)) - F.signum(inside) * F.pow(F.abs(inside), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    return g.select(*by, (z1 * z1 + z2 * z2).alias("statistic")).withColumn("test_name", F.lit("D'Agostino K^2")).withColumn("p_value", F.exp(-F.col("statistic") / 2)).withColumn("reject_normality_null", F.col("p_value") < alpha)


def shapiro(df: DataFrame, value: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Royston's W and its p-value, from three values on, as sums over rows with their rank in the group.

    The statistic needs each value's normal score, the two values at either end and a few sums, so a
    group's values are ranked in pieces and never meet in one task.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("x_"))
    rows = ordered.with_group(ordered.numbered(rows, by, "x_", total="n"), by, mean_=F.avg("x_"))
    rows = rows.withColumn("m_", ordered.normal_quantile((F.col("pos_") + 0.625) / (F.col("n") + 0.25)))
    at = lambda c, k, name: F.max(F.when(F.col("pos_") == k, F.col(c))).alias(name)
    z = F.col("x_") - F.col("mean_")
    last = F.col("n") - 1
    g = rows.groupBy(*by).agg(
        F.max("n").cast("double").alias("n"), F.sum(F.col("m_") * F.col("m_")).alias("size"), F.sum(F.col("m_") * z).alias("mz"), F.sum(z * z).alias("ss"),
        at("x_", 0, "x1"), at("x_", 1, "x2"), at("x_", last - 1, "y2"), at("x_", last, "y1"), at("m_", last - 1, "m2"), at("m_", last, "m1"),
    )
    n, u = F.col("n"), 1 / F.sqrt("n")
    poly = lambda cs: sum((F.lit(c) * F.pow(u, F.lit(i)) for i, c in enumerate(cs, 1)), F.lit(0.0))
    m1, m2, size = F.col("m1"), F.col("m2"), F.col("size")
    #: Royston's corrections of the two largest weights, by powers of 1 / sqrt(n).
    a1 = m1 / F.sqrt(size) + poly([0.221157, -0.147981, -2.071190, 4.434685, -2.706056])
    a2 = m2 / F.sqrt(size) + poly([0.042981, -0.293762, -1.752461, 5.682633, -3.582633])
    wide = n > 5
    phi = (size - 2 * m1 * m1 - F.when(wide, 2 * m2 * m2).otherwise(0.0)) / (1 - 2 * a1 * a1 - F.when(wide, 2 * a2 * a2).otherwise(0.0))
    outer, inner = F.col("y1") - F.col("x1"), F.col("y2") - F.col("x2")
    rest = F.col("mz") - m1 * outer - F.when(wide, m2 * inner).otherwise(0.0)
    top = F.when(n > 3, rest / F.sqrt(phi) + a1 * outer + F.when(wide, a2 * inner).otherwise(0.0)).otherwise(F.sqrt(F.lit(0.5)) * outer)
    w = F.when((n >= 3) & (outer > 0), F.try_divide(top * top, F.col("ss")))
    y, k = F.log(F.greatest(1 - F.col("statistic"), F.lit(1e-300))), F.log(n)
    power = lambda x, cs: sum((F.lit(c) * F.pow(x, F.lit(i)) for i, c in enumerate(cs)), F.lit(0.0))
    #: Royston's mean and deviation of log(1 - W), up to 11 values and beyond.
    few = F.try_divide(-F.log(F.greatest(-2.273 + 0.459 * n - y, F.lit(1e-300))) - power(n, [0.5440, -0.39978, 0.025054, -0.0006714]), F.exp(power(n, [1.3822, -0.77857, 0.062767, -0.0020322])))
    many = (y - power(k, [-1.5861, -0.31082, -0.083751, 0.0038915])) / F.exp(power(k, [-0.4803, -0.082676, 0.0030302]))
    out = g.withColumn("statistic", w).withColumn("z_", F.when(n <= 11, few).otherwise(many))
    three = F.greatest(F.lit(0.0), 6 / np.pi * (F.asin(F.sqrt(F.least(F.col("statistic"), F.lit(1.0)))) - float(np.arcsin(np.sqrt(0.75)))))
    out = out.withColumn("p_value", F.when(F.col("statistic").isNotNull(), F.when(n == 3, three).otherwise(normal_upper_p(F.col("z_")))))
    return out.select(*by, "statistic", F.lit("Shapiro-Wilk").alias("test_name"), "p_value", (F.col("p_value") < alpha).alias("reject_normality_null"))


def normality(df: DataFrame, value: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    df = df if getattr(df, "_tidemark_staged", False) else staged(df.select(*by, F.col(value).cast("double").alias(value)))
    out = jarque_bera(df, value, by, alpha).unionByName(dagostino(df, value, by, alpha)).unionByName(shapiro(df, value, by, alpha))
    return out.withColumn("interpretation", F.when(F.col("reject_normality_null"), "normality_rejected").otherwise("normality_not_rejected"))


def diagnostics_summary(df: DataFrame, value: str, by: list[str], max_lag: int = 168, alpha: float = 0.05) -> DataFrame:
    """One row by group: moments, selected and extreme correlations, test outcomes and verdicts."""
    df = staged(df.select(*by, TIMESTAMP, F.col(value).cast("double").alias(value)))
    r = staged(acf(df, value, by, max_lag))
    both = r.join(pacf(r, by), [*by, "lag"])
    at = lambda c, k: F.max(F.when(F.col("lag") == k, F.col(c))).alias(f"{c}_lag_{k}")
    later = F.col("lag") > 0
    c = both.groupBy(*by).agg(F.max("bound").alias("acf_95_confidence_bound"), *(at(c, k) for c in ("acf", "pacf") for k in (1, 24, 168)), F.count_if("exceeds").alias("significant_acf_lags"), F.count_if(later & (F.abs("pacf") > F.col("bound"))).alias("significant_pacf_lags"), F.max(F.when(later, F.abs("acf"))).alias("max_abs_acf"), F.max(F.when(later, F.abs("pacf"))).alias("max_abs_pacf"))
    m = df.groupBy(*by).agg(F.count(value).alias("n_residuals"), F.avg(value).alias("residual_mean"), F.median(value).alias("residual_median"), F.stddev_samp(value).alias("residual_std"), corrected_skewness(value).alias("residual_skewness"), corrected_kurtosis(value).alias("residual_excess_kurtosis"))
    lb = ljung_box(r, by, alpha=alpha).groupBy(*by).agg(F.bool_and(~F.col("reject_white_noise_null")).alias("white_noise"))
    no = normality(df, value, by, alpha).groupBy(*by).agg(F.bool_and(~F.col("reject_normality_null")).alias("normal"))
    out = m.join(c, by).join(lb, by, "left").join(no, by).join(centre_and_randomness(df, value, by, alpha).drop("n"), by)
    random = F.when(~F.coalesce("white_noise", F.lit(True)), "residuals_autocorrelated").when(F.col("mean_zero_reject") | F.col("sign_balance_reject"), "residuals_biased").when(F.col("runs_test_reject"), "residuals_not_in_random_order").otherwise("residuals_consistent_with_white_noise")
    return out.withColumns({"residual_randomness_conclusion": random, "residual_normality_conclusion": F.when(F.col("normal"), "normality_not_rejected").otherwise("normality_rejected")})


def normal_fit(df: DataFrame, value: str, by: list[str], points: int = 300) -> DataFrame:
    """``(by..., x, density)``: the normal curve of each group's mean and deviation over its range."""
    g = df.groupBy(*by).agg(F.avg(value).alias("mean_"), F.stddev_samp(value).alias("sd_"), F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    x = F.col("lo_") + (F.col("hi_") - F.col("lo_")) * F.col("i_") / (points - 1)
    z = F.try_divide(F.col("x") - F.col("mean_"), F.col("sd_"))
    rows = g.withColumn("i_", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    return rows.select(*by, "x", F.try_divide(F.exp(-z * z / 2), F.col("sd_") * F.sqrt(F.lit(2 * np.pi))).alias("density"))


def qq_points(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``(by..., nth, sample, theoretical)``: ordered values against normal quantiles at (nth - 0.5) / n."""
    rows = ordered.numbered(df.select(*by, F.col(value).cast("double").alias("sample")), by, "sample", "nth", total="n_")
    rows = rows.withColumn("nth", (F.col("nth") + 1).cast("int"))
    return rows.select(*by, "sample", "nth", ordered.normal_quantile((F.col("nth") - 0.5) / F.col("n_")).alias("theoretical"))
