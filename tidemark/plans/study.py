"""The study end to end: each stage reads tables, writes tables and logs its run.

    python -m tidemark.plans.study --input hours.csv --format csv --output out --overwrite
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LOCAL_TZ, METRICS, Settings
from ..functions.metrics import grouped_metrics
from ..operators import analysis, comparison, contracts, features, forecast, models, splits, stats, timeaxis
from ..sources import tables, tracking


class Study:
    """One series' tables under a folder; ``overwrite=False`` makes an existing output an error."""

    def __init__(self, spark: SparkSession, output: str, settings: Settings | None = None, overwrite: bool = False, tz: str = LOCAL_TZ):
        self.spark, self.output, self.settings, self.overwrite, self.tz = spark, output.rstrip("/"), settings or Settings(), overwrite, tz

    def path(self, name: str) -> str:
        return f"{self.output}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def save(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        tables.write(df, self.path(name), overwrite=self.overwrite, by=list(by))
        return self.table(name)

    def stage(self, name: str, run) -> DataFrame:
        """Runs a stage and logs its time, or its failure before raising it again."""
        timer, status, message = tracking.Timer(), "success", ""
        try:
            return run()
        except Exception as e:
            status, message = "failed", str(e)[:500]
            raise
        finally:
            tracking.log_runtime(self.spark, tracking.runtime_record(name, model_name="none", total_runtime_seconds=timer.seconds(), status=status, error_message=message), self.path("runtime_log"))

    def preprocess(self, raw: DataFrame) -> DataFrame:
        return self.stage("preprocessing", lambda: self.save(timeaxis.prepare_series(raw, self.tz), "series"))

    def split(self) -> DataFrame:
        def run() -> DataFrame:
            series = self.table("series")
            out = self.save(splits.with_split(series, self.settings.test_days), "split", ("split",))
            contracts.require(contracts.final_scope(out.filter("split = 'train_val'"), out.filter("split = 'final_test'"), self.settings.horizon))
            return out

        return self.stage("split", run)

    def train_val(self) -> DataFrame:
        return self.table("split").filter("split = 'train_val'").drop("split")

    def engineer(self, kind: str) -> DataFrame:
        def run() -> DataFrame:
            train = self.train_val()
            out = self.save(features.feature_matrix(train, kind, tz=self.tz), f"features_{kind}")
            contracts.require(contracts.matrix_contract(out, kind))
            bad = features.leakage_check(out, train, kind, tz=self.tz).filter("mismatches > 0").collect()
            if bad:
                raise ValueError(f"features that differ from their definition: {[r['feature'] for r in bad]}")
            return out

        return self.stage(f"features_{kind}", run)

    def folds(self) -> DataFrame:
        s = self.settings
        return splits.cv_rows(self.train_val(), s.n_folds, s.val_horizon, s.gap)

    def tune(self, kind: str, space: dict[str, list], limit: int | None = None) -> DataFrame:
        """Tuning summary, best first; fold metrics and predictions are kept beside."""

        def run() -> DataFrame:
            grid = models.parameter_grid(space, f"xgb_{kind}", limit)
            predictions = self.save(models.grid_cv(self.train_val(), self.folds(), grid, kind, self.settings.horizon, tz=self.tz), f"cv_predictions_{kind}")
            metrics = self.save(grouped_metrics(predictions, ["parameter_set_id", "fold"]), f"cv_metrics_{kind}")
            return self.save(comparison.tuning_summary(metrics, models.parameter_frame(self.spark, grid)), f"tuning_{kind}")

        return self.stage(f"tuning_{kind}", run)

    def final_test(self, kind: str, params: dict, label: str, parameter_set_id: str = "best") -> DataFrame:
        """One fit on all training rows, one forecast of the final test."""

        def run() -> DataFrame:
            series, train = self.table("series"), self.train_val()
            rows = train.withColumn("role", F.lit("train")).withColumn("fold", F.lit(0))
            fitted = models.fit_grid(rows, features.feature_matrix(train, kind, tz=self.tz), [(parameter_set_id, params)], kind).drop("train_time_seconds", "n_train_rows")
            test = forecast.holdout_rows(series, self.settings.test_days)
            out = forecast.fitted_predictions(series, test, fitted, models.load_tree, kind, label, self.settings.horizon, tz=self.tz).withColumnRenamed("model_name", "model_label")
            out = self.save(analysis.with_errors(out, self.tz), f"final_{kind}")
            contracts.require(contracts.prediction_contract(out, test, self.settings.horizon))
            return out

        return self.stage(f"final_test_{kind}", run)

    def references(self) -> DataFrame:
        """The closed-form models' forecasts of the final test."""
        series = self.table("series")
        out = forecast.closed_form_predictions(series, forecast.holdout_rows(series, self.settings.test_days), horizon=self.settings.horizon).withColumnRenamed("model_name", "model_label")
        return self.save(analysis.with_errors(out, self.tz), "final_references")

    def analyse(self, predictions: DataFrame, pairs: list[tuple[str, str, str]], top: int = 20) -> dict[str, DataFrame]:
        """Metrics, rankings, error tables and comparison tests of aligned predictions."""
        n = predictions.select("model_label").distinct().count()
        contracts.require(contracts.models_aligned(predictions, n))
        metrics = grouped_metrics(predictions, ["model_label"])
        losses = stats.differentials(predictions, pairs)
        made = {
            "metrics": metrics, "ranking": comparison.metric_ranking(metrics, METRICS), "residuals": analysis.residual_distribution(predictions), "segments": analysis.segment_errors(predictions),
            "by_hour": analysis.errors_by(predictions, "local_hour"), "by_step": analysis.short_errors_by(predictions, "horizon_step"), "by_block": analysis.errors_by_block(predictions), "events": analysis.extreme_events(predictions),
            "top_errors": analysis.top_errors(predictions, top), "dm_block": stats.dm_by_block(losses), "dm_step": stats.dm_by_horizon(losses), "dm_time": stats.dm_by_timestamp(losses, self.settings.horizon),
        }
        return {k: self.save(v, f"analysis_{k}") for k, v in made.items()}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--format", default="csv")
    p.add_argument("--output", required=True)
    p.add_argument("--feature-set", default="basic")
    p.add_argument("--max-parameter-sets", type=int, default=3)
    p.add_argument("--n-folds", type=int, default=5)
    p.add_argument("--val-horizon", type=int, default=168)
    p.add_argument("--forecast-horizon", type=int, default=24)
    p.add_argument("--test-days", type=int, default=30)
    p.add_argument("--overwrite", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    study = Study(spark, a.output, Settings(a.forecast_horizon, a.n_folds, a.val_horizon, 0, a.test_days), a.overwrite)
    study.preprocess(tables.read_raw_hourly(spark, a.input, a.format))
    study.split()
    study.engineer(a.feature_set)
    space = {"n_estimators": [50, 100], "learning_rate": [0.1], "max_depth": [3, 5], "min_child_weight": [5]}
    best = comparison.best_parameters(study.tune(a.feature_set, space, a.max_parameter_sets)).first()
    params = {k.removeprefix("param_"): float(v) for k, v in best.asDict().items() if k.startswith("param_")}
    label = f"trees_{a.feature_set}"
    both = study.final_test(a.feature_set, params, label, best["parameter_set_id"]).unionByName(study.references(), allowMissingColumns=True)
    out = study.analyse(both, [("trees", "seasonal_24", label), ("season", "naive_1", "seasonal_24")])
    print(tables.markdown(out["ranking"].orderBy("mae")))


if __name__ == "__main__":
    main()
