"""Lag, rolling and calendar features by row position; nothing of the current or a later row enters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..config import CALENDAR, LAGS, LOCAL_TZ, MEAN_WINDOWS, STD_WINDOWS, TARGET, TIMESTAMP, feature_columns, feature_set, positive_numbers
from ..functions.metrics import close
from . import ordered
from .timeaxis import calendar, local_time, over_time


def lag_columns(lags: list[int], series: list[str] = (), target: str = TARGET, w: WindowSpec | None = None) -> dict[str, Column]:
    """``w``: the window of ``ordered.chunks``, for series too long for one task each."""
    w = w or over_time(list(series))
    return {f"lag_{k}": F.lag(F.col(target).cast("double"), k).over(w) for k in positive_numbers(lags, "lags")}


def rolling_columns(means: list[int], stds: list[int], series: list[str] = (), target: str = TARGET, w: WindowSpec | None = None) -> dict[str, Column]:
    """Over the ``w`` rows before the current one; null until there are ``w``."""
    y = F.col(target).cast("double")

    def rolled(f, k: int) -> Column:
        rows = (w or over_time(list(series))).rowsBetween(-k, -1)
        return F.when(F.count(y).over(rows) == k, f(y).over(rows))

    return {f"rolling_mean_{k}": rolled(F.avg, k) for k in means} | {f"rolling_std_{k}": rolled(F.stddev_samp, k) for k in stds}


def centred_rolling(df: DataFrame, width: int = 168, series: list[str] = (), target: str = TARGET) -> DataFrame:
    """Exploratory mean and deviation over a centred window, from one row on."""
    back, ahead = width // 2, (width - 1) // 2
    rows = ordered.window(series).rowsBetween(-back, ahead)
    cut = ordered.chunks(df, series, TIMESTAMP, before=back, after=ahead)
    return ordered.own(cut.withColumns({"rolling_mean": F.avg(target).over(rows), "rolling_std": F.stddev_samp(target).over(rows)}))


def add_calendar(df: DataFrame, columns: list[str], tz: str = LOCAL_TZ) -> DataFrame:
    made = calendar(local_time(df, tz))
    return df.withColumns({c: made[c] for c in columns})


def engineered(df: DataFrame, kind: str, series: list[str] = (), tz: str = LOCAL_TZ, target: str = TARGET) -> DataFrame:
    """All features of a set as columns: all windows in one pass over sorted stretches with a halo of the rows that they look back."""
    s = feature_set(kind)
    w = ordered.window(series)
    columns = lag_columns(LAGS[s], series, target, w) | rolling_columns(MEAN_WINDOWS[s], STD_WINDOWS[s], series, target, w)
    cut = ordered.chunks(df, series, TIMESTAMP, before=max(*LAGS[s], *MEAN_WINDOWS[s], *STD_WINDOWS[s]))
    return add_calendar(ordered.own(cut.withColumns(columns)), CALENDAR[s], tz)


def drop_incomplete(df: DataFrame, columns: list[str], target: str = TARGET) -> DataFrame:
    return df.na.drop(subset=[target, *columns])


def feature_matrix(df: DataFrame, kind: str, series: list[str] = (), tz: str = LOCAL_TZ, target: str = TARGET, drop: bool = True) -> DataFrame:
    """``timestamp, target, features...`` in the order of the catalogue."""
    columns = feature_columns(kind)
    out = engineered(df, kind, series, tz, target).select(*series, TIMESTAMP, F.col(target).cast("double").alias(target), *columns)
    return drop_incomplete(out, columns, target) if drop else out


def leakage_check(matrix: DataFrame, source: DataFrame, kind: str, series: list[str] = (), tz: str = LOCAL_TZ, target: str = TARGET) -> DataFrame:
    """``(feature, checked_rows, mismatches, first_mismatch)``: the matrix against features made anew."""
    columns = feature_columns(kind)
    again = engineered(source, kind, series, tz, target).select(*series, TIMESTAMP, *(F.col(c).cast("double").alias(f"{c}__again") for c in columns))
    met = matrix.join(again, [*series, TIMESTAMP])
    bad = {c: ~close(F.col(c).cast("double"), F.col(f"{c}__again")) for c in columns}
    row = met.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(b).alias(f"{c}__n") for c, b in bad.items()), *(F.min(F.when(b, F.col(TIMESTAMP))).alias(f"{c}__t") for c, b in bad.items()))
    listed = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}__n").alias("mismatches"), F.col(f"{c}__t").alias("first_mismatch")) for c in columns))
    return row.select("rows", F.explode(listed).alias("x")).select("x.feature", F.col("rows").alias("checked_rows"), "x.mismatches", "x.first_mismatch")


def feature_group(name: Column) -> Column:
    """The group that a feature's name begins with."""
    out = F
    for prefix, group in (("lag_", "lag"), ("rolling_mean_", "rolling_mean"), ("rolling_std_", "rolling_std")):
        out = out.when(name.startswith(prefix), F.lit(group))
    return out.otherwise("calendar")


def feature_set_table(spark) -> DataFrame:
    """Features by set and group: counts and comma-joined names in catalogue order."""
    rows = spark.createDataFrame([(s, i, c) for s in ("basic", "advanced") for i, c in enumerate(feature_columns(s))], "feature_set string, nth int, feature string")
    rows = rows.withColumn("feature_group", feature_group(F.col("feature")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "feature"))), lambda x: x["feature"]), ",")
    return rows.groupBy("feature_set", "feature_group").agg(F.count(F.lit(1)).alias("n_features"), joined.alias("features"))


def evenly_sampled(df: DataFrame, size: int, series: list[str] = ()) -> DataFrame:
    """Rows at ``size`` evenly spaced positions, first and last included; all rows if there are no more."""
    keys = list(series)
    pos = ordered.numbered(df, keys, TIMESTAMP, "pos", total="n")
    step = (F.col("n") - 1) / F.lit(float(max(size - 1, 1)))
    nth = F.floor(F.col("pos") / F.when(step > 0, step) + 0.5)
    hit = F.exists(F.array(nth - 1, nth, nth + 1), lambda k: (k >= 0) & (k < size) & (F.floor(k * step + 1e-9) == F.col("pos")))
    return pos.filter((F.col("n") <= size) | hit).drop("pos", "n")
