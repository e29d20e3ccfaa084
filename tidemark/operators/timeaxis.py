"""The time axis: parsing, audits, daylight saving, hourly counts.

Series are rows ``(series..., timestamp, ...)``.  Windows that look back a bounded number of rows run
on stretches of a series (``ordered.chunks``), so one long series is as many tasks as it has stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LOCAL_TZ, TARGET, TIMESTAMP
from . import ordered


def over_time(series: list[str], time: str = TIMESTAMP):
    return Window.partitionBy(*(series or [F.lit(0)])).orderBy(time)


def hourly_counts(events: DataFrame, time: str = "ts", series: list[str] = ()) -> DataFrame:
    """``(series..., timestamp, trip_count)``: events per clock hour; partial counts come before the shuffle."""
    return events.groupBy(*series, F.date_trunc("hour", F.col(time).cast("timestamp")).alias(TIMESTAMP)).agg(F.count(F.lit(1)).alias(TARGET))


def dense(hourly: DataFrame, series: list[str] = (), step: str = "1 hour") -> DataFrame:
    """Every hour from a series' first to its last, missing ones as 0."""
    spans = hourly.groupBy(*series).agg(F.min(TIMESTAMP).alias("a"), F.max(TIMESTAMP).alias("b"))
    spine = spans.select(*series, F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(TIMESTAMP))
    return spine.join(hourly.select(*series, TIMESTAMP, TARGET), [*series, TIMESTAMP], "left").withColumn(TARGET, F.coalesce(TARGET, F.lit(0)))


def parse_timestamps(df: DataFrame, column: str = TIMESTAMP, strict: bool = True) -> DataFrame:
    """Text to timestamps; strict: an error that counts the offenders and names the first five."""
    out = df.withColumn(column, F.col(column).try_cast("timestamp"))
    if strict:
        bad = df.filter(F.col(column).try_cast("timestamp").isNull())
        first = [r[0] for r in bad.select(F.col(column).cast("string")).limit(5).collect()]
        if first:
            raise ValueError(f"{bad.count()} values of {column} are no timestamps, such as {first}")
    return out


def in_order(df: DataFrame, column: str = TIMESTAMP, *ties: str) -> DataFrame:
    return df.orderBy(column, *ties)


def duplicate_audit(df: DataFrame, column: str = TIMESTAMP) -> DataFrame:
    """Rows in groups of equal timestamps, how many timestamps, and the first ten."""
    twice = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicate_values"), F.slice(F.array_sort(F.collect_list(F.struct(column))), 1, 10)[column].alias("examples"))


def missing_hours(df: DataFrame, column: str = TIMESTAMP, step: str = "1 hour") -> DataFrame:
    """The expected timestamps between first and last that don't occur."""
    spine = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(column))
    return spine.join(df.select(column).distinct(), column, "left_anti")


def missing_audit(df: DataFrame, column: str = TIMESTAMP, step: str = "1 hour") -> DataFrame:
    """Expected, observed and missing counts and the first ten missing."""
    missing = missing_hours(df, column, step).agg(F.count(F.lit(1)).alias("missing"), F.slice(F.array_sort(F.collect_list(column)), 1, 10).alias("examples"))
    observed = df.agg(F.count_distinct(column).alias("observed"))
    return observed.join(missing).select((F.col("observed") + F.col("missing")).alias("expected"), "observed", "missing", "examples")


def spacing(df: DataFrame, column: str = TIMESTAMP, series: list[str] = (), seconds: int = 3600) -> DataFrame:
    """Counts of steps to the row before that aren't one hour, and of those that don't advance."""
    rows = ordered.chunks(df.select(*series, column), series, column, before=1)
    step = F.unix_timestamp(F.col(column).cast("timestamp")) - F.unix_timestamp(F.lag(column).over(ordered.window(series)).cast("timestamp"))
    return rows.withColumn("step", step).filter("own_").groupBy(*series).agg(F.count("step").alias("n_steps"), F.count_if(F.col("step") != seconds).alias("non_hourly"), F.count_if(F.col("step") <= 0).alias("non_positive"), F.min("step").alias("least_step"), F.max("step").alias("largest_step"))


def utc_of_local(local: Column, tz: str = LOCAL_TZ) -> Column:
    """UTC of naive local time; the repeated hour in autumn is taken for standard time, the later instant."""
    first = F.to_utc_timestamp(local.cast("timestamp"), tz)
    later = first + F.expr("interval 1 hour")
    return F.when(F.from_utc_timestamp(later, tz) == F.from_utc_timestamp(first, tz), later).otherwise(first)


def is_ambiguous(local: Column, tz: str = LOCAL_TZ) -> Column:
    """True in the hour that autumn repeats."""
    first = F.to_utc_timestamp(local.cast("timestamp"), tz)
    return (F.from_utc_timestamp(first + F.expr("interval 1 hour"), tz) == F.from_utc_timestamp(first, tz)) | (F.from_utc_timestamp(first - F.expr("interval 1 hour"), tz) == F.from_utc_timestamp(first, tz))


def is_nonexistent(local: Column, tz: str = LOCAL_TZ) -> Column:
    """True in the hour that spring skips."""
    at = local.cast("timestamp")
    return F.from_utc_timestamp(F.to_utc_timestamp(at, tz), tz) != at


def localize(df: DataFrame, column: str = TIMESTAMP, tz: str = LOCAL_TZ, strict: bool = True) -> DataFrame:
    """Adds ``timestamp_local_naive`` and ``is_dst_ambiguous_local_hour``; ``timestamp`` becomes UTC.

    Strict: a local time that doesn't exist is an error with examples.
    """
    at = F.col(column)
    if strict:
        bad = [str(r[0]) for r in df.filter(is_nonexistent(at, tz)).select(at).limit(5).collect()]
        if bad:
            raise ValueError(f"local times that don't exist in {tz}: {bad}")
    return df.withColumns({"timestamp_local_naive": at.cast("timestamp_ntz"), "is_dst_ambiguous_local_hour": is_ambiguous(at, tz), TIMESTAMP: utc_of_local(at, tz)})


def localize_dropping(df: DataFrame, column: str = TIMESTAMP, tz: str = LOCAL_TZ) -> DataFrame:
    """The exploratory variant: ambiguous and nonexistent hours become null."""
    at = F.col(column)
    return df.withColumn(TIMESTAMP, F.when(~is_ambiguous(at, tz) & ~is_nonexistent(at, tz), F.to_utc_timestamp(at.cast("timestamp"), tz)))


def calendar(at: Column) -> dict[str, Column]:
    """Hour, day of the week from Monday = 0, weekend flag and month of a local time."""
    day = F.weekday(at)
    return {"hour": F.hour(at).cast("smallint"), "day_of_week": day.cast("smallint"), "is_weekend": day.isin(5, 6).cast("tinyint"), "month": F.month(at).cast("smallint")}


def local_time(df: DataFrame, tz: str = LOCAL_TZ) -> Column:
    """The naive local column if there is one, else the UTC timestamp in ``tz``."""
    return F.col("timestamp_local_naive").cast("timestamp") if "timestamp_local_naive" in df.columns else F.from_utc_timestamp(TIMESTAMP, tz)


def day_name(at: Column) -> Column:
    return F.date_format(at, "EEEE")


def iso_format(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def future_index(df: DataFrame, horizon: int, series: list[str] = ()) -> DataFrame:
    """The next ``horizon`` hours after each series' last row."""
    last = df.groupBy(*series).agg(F.max(TIMESTAMP).alias("last"))
    return last.select(*series, F.posexplode(F.expr(f"sequence(last + interval 1 hour, last + interval {int(horizon)} hour, interval 1 hour)")).alias("k", TIMESTAMP)).select(*series, (F.col("k") + 1).alias("horizon_step"), TIMESTAMP)


def local_hours(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every local hour from ``first`` to ``last``, nonexistent ones included."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(timestamp'{first}', timestamp'{last}', interval 1 hour)")).alias(TIMESTAMP))


def prepare_series(raw: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """Parsed, localised, in order; duplicated UTC times are an error."""
    out = localize(parse_timestamps(raw), tz=tz)
    twice = duplicate_audit(out).first()
    if twice["duplicate_values"]:
        raise ValueError(f"{twice['duplicate_values']} timestamps occur more than once, such as {twice['examples']}")
    return out.withColumn(TARGET, F.col(TARGET).cast("double")).orderBy(TIMESTAMP)


def rebuilt_mismatches(df: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """Rows whose UTC time isn't what their local time gives."""
    return df.agg(F.count_if(~utc_of_local(F.col("timestamp_local_naive"), tz).eqNullSafe(F.col(TIMESTAMP))).alias("mismatches"))
