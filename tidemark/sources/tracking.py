"""Control metadata on the driver, and the runtime log and journal as append-only tables."""

from __future__ import annotations

import json
import math
import time
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..config import RUNTIME_LOG_COLUMNS
from .commits import append_once, commits


def read_json(path: str, optional: bool = False) -> dict:
    """A JSON object; with ``optional`` an absent file is an empty one."""
    p = Path(path)
    if optional and not p.exists():
        return {}
    out = json.loads(p.read_text())
    if not isinstance(out, dict):
        raise ValueError(f"{path} is no JSON object")
    return out


def plain(value):
    """A value that JSON can hold: NaN and infinities null, paths and times text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (str, int, bool)) or value is None:
        return value
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def write_json(value: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(plain(value), indent=2, ensure_ascii=False))


def best_parameters(path: str) -> dict:
    out = read_json(path)
    if "parameter_set_id" not in out or not isinstance(out.get("params"), dict):
        raise ValueError(f"{path} lacks parameter_set_id or params")
    return out | {"parameter_set_id": str(out["parameter_set_id"])}


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Timer:
    def __init__(self):
        self.began = time.perf_counter()

    def seconds(self, digits: int = 6) -> float:
        out = round(time.perf_counter() - self.began, digits)
        if out < 0:
            raise ValueError("the clock went backwards")
        return out


def runtime_record(experiment_name: str, **fields) -> dict[str, str]:
    """A record of the runtime log: unknown fields go, absent ones are empty, the status is success."""
    if not experiment_name:
        raise ValueError("a record needs an experiment_name")
    given = {"timestamp_run": now(), "feature_set": "none", "status": "success"} | {k: v for k, v in fields.items() if v is not None} | {"experiment_name": experiment_name}

    def text(v) -> str:
        v = plain(v)
        return "" if v is None else str(round(v, 9)) if isinstance(v, float) else str(v)

    return {c: text(given.get(c)) for c in RUNTIME_LOG_COLUMNS}


def log_runtime(spark: SparkSession, record: dict, path: str, run_id: str | None = None) -> None:
    """One row of the runtime log.  With a ``run_id`` a repeated call adds no second row, and ``commits.read_committed`` reads the log."""
    row = spark.createDataFrame([[record[c] for c in RUNTIME_LOG_COLUMNS]], ", ".join(f"{c} string" for c in RUNTIME_LOG_COLUMNS)).coalesce(1)
    if run_id:
        append_once(row, path, run_id, "csv")
    else:
        row.write.mode("append").option("header", True).csv(path)


def log_run(spark: SparkSession, record: dict, path: str, run_id: str | None = None) -> None:
    """One line of the journal; time and status have defaults.  With a ``run_id`` a repeated call adds no second line."""
    full = plain({"timestamp_run": now(), "status": "success"} | record)
    row = spark.createDataFrame([(json.dumps(full),)], "value string").coalesce(1)
    if run_id:
        append_once(row, path, run_id, "text")
    else:
        row.write.mode("append").text(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The journal's lines as columns, those of run ids or plain ones."""
    found = commits(spark, path)
    return spark.read.json([f"{path.rstrip('/')}/{c['folder']}" for c in found.values()] or path)
