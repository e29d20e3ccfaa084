"""Hold-out and expanding-window splits by row position, origin blocks, and their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TARGET, TIMESTAMP
from . import ordered


def with_split(df: DataFrame, test_days: int, series: list[str] = ()) -> DataFrame:
    """Adds ``split``: final_test strictly after the last timestamp minus ``test_days`` days, else train_val."""
    keys = list(series)
    last = F.max(TIMESTAMP).over(Window.partitionBy(*keys)) if keys else None
    if keys:
        return df.withColumn("split", F.when(F.col(TIMESTAMP) > last - F.expr(f"interval {int(test_days)} day"), "final_test").otherwise("train_val"))
    cutoff = df.agg((F.max(TIMESTAMP) - F.expr(f"interval {int(test_days)} day")).alias("cutoff"))  # one row
    return df.join(F.broadcast(cutoff)).withColumn("split", F.when(F.col(TIMESTAMP) > F.col("cutoff"), "final_test").otherwise("train_val")).drop("cutoff")


def holdout(df: DataFrame, test_days: int, series: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(train_val, final_test)``."""
    both = with_split(df, test_days, series)
    return both.filter("split = 'train_val'").drop("split"), both.filter("split = 'final_test'").drop("split")


def split_audit(train: DataFrame, test: DataFrame, source: DataFrame, test_days: int) -> DataFrame:
    """One row: counts, order, overlap and whether source rows are kept."""
    a, b = (d.agg(F.count(F.lit(1)).alias(f"{n}_rows"), F.min(TIMESTAMP).alias(f"{n}_start"), F.max(TIMESTAMP).alias(f"{n}_end")) for d, n in ((train, "train"), (test, "test")))
    overlap = train.select(TIMESTAMP).intersect(test.select(TIMESTAMP)).agg(F.count(F.lit(1)).alias("overlap"))
    lost = source.select(TIMESTAMP).exceptAll(train.select(TIMESTAMP).unionAll(test.select(TIMESTAMP))).agg(F.count(F.lit(1)).alias("lost_rows"))
    whole = source.agg(F.count(F.lit(1)).alias("source_rows"))
    out = a.join(b).join(overlap).join(lost).join(whole)
    return out.withColumn("ordered", F.col("train_end") < F.col("test_start")).withColumn("rows_preserved", F.col("train_rows") + F.col("test_rows") == F.col("source_rows")).withColumn("test_rows_expected", F.lit(test_days * 24).cast("bigint"))


def fold_table(spark, n_rows: int, n_folds: int, val_horizon: int, gap: int = 0, least_train: int = 168) -> DataFrame:
    """``(fold, train_end, val_start, val_end)`` as positions, ends exclusive."""
    first = n_rows - n_folds * val_horizon
    if first - gap < least_train:
        raise ValueError(f"{n_rows} rows are too few for {n_folds} folds of {val_horizon} and {least_train} training rows")
    return spark.createDataFrame([(k + 1, first + k * val_horizon - gap, first + k * val_horizon, first + (k + 1) * val_horizon) for k in range(n_folds)], "fold int, train_end bigint, val_start bigint, val_end bigint")


def with_position(df: DataFrame, series: list[str] = ()) -> DataFrame:
    return ordered.numbered(df, series, TIMESTAMP, "pos")


def cv_rows(df: DataFrame, n_folds: int, val_horizon: int, gap: int = 0, series: list[str] = (), least_train: int = 168) -> DataFrame:
    """Rows by fold and role: all before the gap train, the fold's own stretch validates.

    Folds are counted back from each series' own end; the fold table is joined by position range.
    """
    keys = list(series)
    rows = ordered.numbered(df, keys, TIMESTAMP, "pos", total="n_rows")
    folds = F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("fold")
    rows = rows.filter(F.col("n_rows") >= least_train + gap + n_folds * val_horizon).select("*", folds)
    start = F.col("n_rows") - (F.lit(n_folds) - F.col("fold") + 1) * val_horizon
    role = F.when(F.col("pos") < start - gap, "train").when((F.col("pos") >= start) & (F.col("pos") < start + val_horizon), "validation")
    return rows.withColumn("val_start", start.cast("bigint")).withColumn("role", role).filter(F.col("role").isNotNull())


def origin_blocks(validation: DataFrame, horizon: int = 24) -> DataFrame:
    """Adds ``origin_block`` and ``horizon_step``, both from 1, to rows with ``pos`` and ``val_start``; the last block may be short."""
    at = F.col("pos") - F.col("val_start")
    return validation.withColumn("origin_block", (F.floor(at / horizon) + 1).cast("int")).withColumn("horizon_step", (F.pmod(at, F.lit(horizon)) + 1).cast("int"))


def block_table(source: DataFrame, rows: DataFrame, horizon: int = 24, series: list[str] = ()) -> DataFrame:
    """Per fold and block: origin (the row before), first and last timestamp, rows."""
    keys = list(series)
    cut = ordered.chunks(source.select(*keys, TIMESTAMP), keys, TIMESTAMP, before=1)
    before = ordered.own(cut.withColumn("forecast_origin", F.lag(TIMESTAMP).over(ordered.window(keys))))
    val = origin_blocks(rows.filter("role = 'validation'"), horizon).join(before, [*keys, TIMESTAMP])
    return val.groupBy(*keys, "fold", "origin_block").agg(F.min_by("forecast_origin", "pos").alias("forecast_origin"), F.min(TIMESTAMP).alias("block_start"), F.max(TIMESTAMP).alias("block_end"), F.count(F.lit(1)).alias("n_rows"))


def fold_metadata(rows: DataFrame, horizon: int = 24, gap: int = 0, series: list[str] = ()) -> DataFrame:
    """One row per fold: spans, positions, counts, boundary delta, odd steps and nested blocks."""
    keys = list(series)

    def of(role: str, name: str) -> list:
        m = F.col("role") == role
        return [F.min(F.when(m, F.col(TIMESTAMP))).alias(f"{name}_start"), F.max(F.when(m, F.col(TIMESTAMP))).alias(f"{name}_end"), F.min(F.when(m, F.col("pos"))).alias(f"{name}_start_pos"), (F.max(F.when(m, F.col("pos"))) + 1).alias(f"{name}_end_pos_exclusive"), F.count_if(m).alias(f"n_{name}_rows"), F.count_if(m & (F.col("step") != 3600)).alias(f"{name}_non_hourly_delta_count")]

    w = Window.partitionBy(*keys, "fold", "role").orderBy("pos")
    stepped = rows.withColumn("step", F.unix_timestamp(TIMESTAMP) - F.unix_timestamp(F.lag(TIMESTAMP).over(w)))
    out = stepped.groupBy(*keys, "fold").agg(*of("train", "train"), *of("validation", "validation"))
    delta = (F.unix_timestamp("validation_start") - F.unix_timestamp("train_end")) / 3600.0
    out = out.withColumn("observed_boundary_delta_hours", delta).withColumn("observed_gap_hours", delta - 1).withColumn("gap_rows", F.lit(gap))
    blocks = origin_blocks(rows.filter("role = 'validation'"), horizon).groupBy(*keys, "fold", "origin_block").agg(F.min(TIMESTAMP).alias("block_start"), F.max(TIMESTAMP).alias("block_end"), F.count(F.lit(1)).alias("rows"))
    nested = blocks.groupBy(*keys, "fold").agg(F.array_sort(F.collect_list(F.struct("origin_block", "block_start", "block_end", "rows"))).alias("rolling_origin_blocks"))
    return out.join(nested, [*keys, "fold"]).withColumn("n_origin_blocks", F.size("rolling_origin_blocks")).withColumn("last_origin_block_rows", F.element_at("rolling_origin_blocks", -1)["rows"])


def flat_metadata(metadata: DataFrame) -> DataFrame:
    return metadata.drop("rolling_origin_blocks")


def cv_audit(metadata: DataFrame, n_folds: int, val_horizon: int) -> DataFrame:
    """One row: fold ids complete, training expanding, no overlap, full validation stretches that follow each other."""
    w = Window.partitionBy(F.lit(0)).orderBy("fold")  # a row per fold
    m = metadata.withColumn("prev_train", F.lag("n_train_rows").over(w)).withColumn("prev_end", F.lag("validation_end_pos_exclusive").over(w))
    return m.agg(
        (F.sort_array(F.collect_set("fold")) == F.sequence(F.lit(1), F.lit(n_folds))).alias("fold_ids_complete"), F.bool_and(F.col("prev_train").isNull() | (F.col("n_train_rows") > F.col("prev_train"))).alias("training_expands"),
        F.bool_and(F.col("train_end") < F.col("validation_start")).alias("train_before_validation"), F.bool_and(F.col("n_validation_rows") == val_horizon).alias("validation_complete"),
        F.bool_and(F.col("prev_end").isNull() | (F.col("prev_end") == F.col("validation_start_pos"))).alias("validation_contiguous"),
    )


def training_rows(matrix: DataFrame, fold_train: DataFrame, series: list[str] = ()) -> DataFrame:
    """The rows of a feature matrix that a fold trains on."""
    return matrix.join(fold_train.select(*series, TIMESTAMP), [*series, TIMESTAMP], "left_semi")


def training_window(train: DataFrame, max_rows: int = 0) -> DataFrame:
    """The last ``max_rows`` rows, or all for 0."""
    if not max_rows:
        return train
    rows = ordered.numbered(train, total="n_")
    return rows.filter(F.col("pos_") >= F.col("n_") - max_rows).drop("pos_", "n_").orderBy(TIMESTAMP)


def period_summary(df: DataFrame, target: str = TARGET, by: list[str] = ()) -> DataFrame:
    y = F.col(target).cast("double")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.min(TIMESTAMP).alias("start"), F.max(TIMESTAMP).alias("end"), F.min(y).alias("target_min"), F.max(y).alias("target_max"), F.avg(y).alias("target_mean"))
