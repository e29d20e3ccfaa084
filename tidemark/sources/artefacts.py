"""Stored artefacts of a study, read under contracts that are data.

A contract lists a table's columns by kind, which of them must be there, and the columns that are
derived where absent.  It compiles to one ``select`` (``conformed``) and one aggregate (``audit``):

========  ==========================================================================
text      as it is
number    a double; what is no number is a fault, null is none
lenient   a double; what is no number becomes null
whole     a whole number; null and fractions are faults
flag      true, 1, yes, y or false, 0, no, n in any case; null and all else are faults
time      a timestamp, in UTC where it names no zone; what is none is a fault, null is none
========  ==========================================================================
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LOCAL_TZ, METRICS, TIMESTAMP
from ..operators.analysis import by_model
from ..operators.comparison import bool_text, select_parameter_set
from ..operators.contracts import require_columns
from ..operators.timeaxis import calendar, day_name
from . import tables, tracking


@dataclass(frozen=True)
class Contract:
    """``required`` and ``optional``: column to kind; ``derived``: column to expression, in order; ``replaced``: the same, whether present or not."""

    name: str
    required: dict[str, str]
    optional: dict[str, str] = field(default_factory=dict)
    derived: dict[str, Callable[[], Column]] = field(default_factory=dict)
    replaced: dict[str, Callable[[], Column]] = field(default_factory=dict)
    order: tuple[str, ...] = ()
    by_model: bool = False

    def kinds(self, df: DataFrame) -> dict[str, str]:
        return self.required | {c: k for c, k in self.optional.items() if c in df.columns}


def _value(c: str, kind: str) -> Column:
    x = F.col(c)
    if kind in ("number", "lenient"):
        return x.try_cast("double")
    if kind == "whole":
        y = x.try_cast("double")
        return F.when(y == F.floor(y), y.try_cast("int"))
    return {"flag": lambda: bool_text(c), "time": lambda: x.try_cast("timestamp"), "text": lambda: x}[kind]()


def _fault(c: str, kind: str) -> Column:
    missing = _value(c, kind).isNull()
    return {"number": F.col(c).isNotNull() & missing, "time": F.col(c).isNotNull() & missing, "whole": missing, "flag": missing}.get(kind, F.lit(False))


def audit(df: DataFrame, contract: Contract) -> DataFrame:
    """``(column, kind, n_rows, faults, examples)`` by column, from one pass; missing required columns are an error."""
    require_columns(df, list(contract.required))
    kinds = contract.kinds(df)
    made = [F.count_if(_fault(c, k)).alias(f"n{i}") for i, (c, k) in enumerate(kinds.items())]
    examples = [F.min(F.when(_fault(c, k), F.col(c).cast("string"))).alias(f"e{i}") for i, (c, k) in enumerate(kinds.items())]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *made, *examples)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col("n_rows"), F.col(f"n{i}").alias("faults"), F.col(f"e{i}").alias("example")) for i, (c, k) in enumerate(kinds.items())]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def conformed(df: DataFrame, contract: Contract) -> DataFrame:
    """The table with its columns of their kinds, derived columns where absent, other columns as they are; faults become null."""
    require_columns(df, list(contract.required))
    out = df.withColumns({c: _value(c, k) for c, k in contract.kinds(df).items()})
    for c, make in contract.derived.items():
        if c not in df.columns:
            out = out.withColumn(c, make())
    for c, make in contract.replaced.items():
        out = out.withColumn(c, make())
    return out


def require_clean(df: DataFrame, contract: Contract) -> None:
    """An error that names every column with faults, their number and one of them."""
    bad = audit(df, contract).filter("faults > 0").collect()  # a row per column
    if bad:
        raise ValueError(f"{contract.name}: " + "; ".join(f"{r['faults']} values of {r['column']} are no {r['kind']}, such as {r['example']!r}" for r in bad))


def load(spark: SparkSession, path: str, contract: Contract, format: str = "csv", **options) -> DataFrame:
    """A stored table under its contract, in its order; an absent table, missing columns and faults are errors."""
    if not tables.exists(spark, path):
        raise FileNotFoundError(f"{contract.name}: {path} is absent")
    df = tables.read(spark, path, format, **options)
    require_clean(df, contract)
    out = conformed(df, contract)
    if contract.by_model:
        return by_model(out, *contract.order)
    return out.orderBy(*contract.order) if contract.order else out


def _local() -> Column:
    return F.from_utc_timestamp(TIMESTAMP, LOCAL_TZ)


_ERRORS = {"residual": lambda: F.col("actual") - F.col("predicted"), "absolute_error": lambda: F.abs("residual"), "squared_error": lambda: F.col("residual") * F.col("residual")}
_CALENDAR = {
    "local_hour": lambda: calendar(_local())["hour"].cast("int"), "local_day_of_week": lambda: calendar(_local())["day_of_week"].cast("int"),
    "local_is_weekend": lambda: F.col("local_day_of_week").isin(5, 6).cast("int"),
}
_MONTH = {"local_month": lambda: calendar(_local())["month"].cast("int")}
_NUMBERS = dict.fromkeys(METRICS, "number")
_LOCAL = dict.fromkeys(["local_hour", "local_day_of_week", "local_is_weekend"], "whole")
_SECONDS = {"prediction_time_seconds": "lenient", "retraining_train_time_seconds": "lenient"}
_FLAGS = {"used_actual_future_for_features": "flag", "final_test_used_for_tuning": "flag"}
_PREDICTED = {TIMESTAMP: "time", "actual": "number", "predicted": "number", "parameter_set_id": "text", "horizon_step": "whole", "prediction_time_seconds": "number", "used_actual_future_for_features": "flag"}

#: The final test's metrics, runtimes and predictions as the comparison reads them, and as the error analysis does.
FINAL_METRICS = Contract("final metrics", {"model_label": "text", "model_key": "text", "feature_set": "text", "parameter_set_id": "text"} | _SECONDS | _FLAGS | _NUMBERS, dict.fromkeys(["model_load_time_seconds", "total_runtime_seconds", "negative_prediction_count", "mean_error_actual_minus_predicted", "max_absolute_error"], "lenient"))
FINAL_RUNTIME = Contract("final runtime", dict.fromkeys(["model_label", "model_key", "parameter_set_id", "status"], "text") | dict.fromkeys(["model_load_time_seconds", "prediction_time_seconds", "total_runtime_seconds", "retraining_train_time_seconds"], "number"), {"model_predict_time_seconds": "number"})
FINAL_PREDICTIONS = Contract("final predictions", dict.fromkeys(["model_label", "model_key", "feature_set"], "text") | {"origin_block": "whole"} | _PREDICTED, dict.fromkeys(_ERRORS, "number") | _LOCAL, _ERRORS | _CALENDAR, order=("model_label", TIMESTAMP))
ANALYSED_METRICS = Contract("final metrics", {"model_label": "text", "parameter_set_id": "text"} | _SECONDS | _FLAGS | _NUMBERS, dict.fromkeys(["model_load_time_seconds", "total_runtime_seconds", "negative_prediction_count"], "lenient"), by_model=True)
ANALYSED_RUNTIME = Contract("final runtime", dict.fromkeys(["model_label", "parameter_set_id", "status"], "text") | dict.fromkeys(["prediction_time_seconds", "total_runtime_seconds", "retraining_train_time_seconds"], "number"), dict.fromkeys(["model_load_time_seconds", "model_predict_time_seconds"], "number"), by_model=True)
ANALYSED_PREDICTIONS = Contract("final predictions", {"model_label": "text", "origin_block": "whole"} | _PREDICTED, dict.fromkeys(_ERRORS, "number") | _LOCAL | {"local_month": "whole"}, _ERRORS | _CALENDAR | _MONTH, {"local_day_name": lambda: day_name(F.date_add(F.lit("2024-01-01").cast("date"), F.col("local_day_of_week")))}, (TIMESTAMP,), True)
#: Folds' metrics and predictions of a tuning run.
TUNING_METRICS = Contract("fold metrics", {"parameter_set_id": "text", "fold": "whole"} | _NUMBERS)
TUNING_PREDICTIONS = Contract("fold predictions", {"model_name": "text", "feature_set": "text", "fold": "whole"} | _PREDICTED, replaced=_ERRORS | _CALENDAR, order=("fold", TIMESTAMP))


def load_tuning(spark: SparkSession, folder: str, label: str, predictions: bool = False, format: str = "csv") -> dict:
    """A tuning run's best set: its parameters, and the rows of its metrics, summary, runtime and, if asked, predictions.

    All files must be there; a table without rows of the best set is an error.
    """
    names = {"best_metrics": "cv_metrics", "best_summary": "cv_metrics_summary", "best_runtime": "runtime_summary"} | ({"best_predictions": "cv_predictions"} if predictions else {})
    suffix = ".csv" if format == "csv" else ""
    paths = {k: f"{folder}/{n}{suffix}" for k, n in names.items()}
    wanted = [f"{folder}/best_params.json", *paths.values(), f"{folder}/experiment_metadata.json"]
    if missing := [p for p in wanted if not tables.exists(spark, p)]:
        raise FileNotFoundError(f"{label}: absent are {missing}")
    best = tracking.read_json(f"{folder}/best_params.json")
    chosen = str(best["parameter_set_id"])
    out = {"model_label": label, "output_dir": folder, "parameter_set_id": chosen, "params": dict(best.get("params", {})), "selection_rule": best.get("selection_rule", ""), "best_payload": best, "tuning_metadata": tracking.read_json(f"{folder}/experiment_metadata.json")}
    for key, path in paths.items():
        rows = select_parameter_set(tables.read(spark, path, format), chosen)
        contract = {"best_metrics": TUNING_METRICS, "best_predictions": TUNING_PREDICTIONS}.get(key)
        if contract:
            require_clean(rows, contract)
            rows = conformed(rows, contract)
            if key == "best_predictions":
                rows = rows.withColumn("model_label", F.lit(label)).orderBy(*contract.order)
        out[key] = rows
    return out
