"""Appends that may be repeated: staged files and one commit for each run id.

``append_once`` writes the rows to a folder of their own and then creates the run's commit, a small
file that names that folder.  A commit is created once and never replaced, so a driver that dies
before it leaves rows that nobody reads, and one that runs again after it adds none.  Readers take
the folders that commits name.  Nothing is renamed, which keeps it right on object stores too.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .tables import union_by_name


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _commit_path(path: str, run_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.=-]+", run_id):
        raise ValueError(f"a run id is made of letters, digits and _ . = -, not {run_id!r}")
    return f"{path}/commits/{run_id}.json"


def is_committed(spark: SparkSession, path: str, run_id: str) -> bool:
    fs, p = _fs(spark, _commit_path(path, run_id))
    return fs.exists(p)


def commit(spark: SparkSession, path: str, run_id: str, folder: str, format: str) -> bool:
    """Makes a staged folder part of the table; false if the run id has one already."""
    fs, p = _fs(spark, _commit_path(path, run_id))
    try:
        out = fs.create(p, False)
    except Exception as e:  # the JVM's class of "exists already" differs by file system
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(json.dumps({"folder": folder, "format": format}).encode()))
    out.close()
    return True


def append_once(df: DataFrame, path: str, run_id: str, format: str = "parquet") -> bool:
    """Adds the rows under a run id; a second call with the same id adds nothing and gives false."""
    spark, path = df.sparkSession, path.rstrip("/")
    if is_committed(spark, path, run_id):
        return False
    folder = f"staged/{run_id}-{uuid.uuid4().hex}"
    writer = df.write.option("header", True) if format == "csv" else df.write
    writer.format(format).save(f"{path}/{folder}")
    return commit(spark, path, run_id, folder, format)


def commits(spark: SparkSession, path: str) -> dict[str, dict]:
    """Run id to folder and format of all commits, by run id."""
    fs, p = _fs(spark, f"{path.rstrip('/')}/commits")
    if not fs.exists(p):
        return {}
    out = {}
    for s in fs.listStatus(p):  # a file per run
        name, stream = s.getPath().getName(), fs.open(s.getPath())
        body = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        stream.close()
        if name.endswith(".json") and body:
            out[name.removesuffix(".json")] = json.loads(body)
    return dict(sorted(out.items()))


def read_committed(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of all commits; columns that a run lacks are null there.  No commit: an error, or an empty table of ``schema``."""
    path, found = path.rstrip("/"), commits(spark, path)
    by_format: dict[str, list[str]] = {}
    for c in found.values():
        by_format.setdefault(c["format"], []).append(f"{path}/{c['folder']}")
    if not by_format:
        if schema is None:
            raise FileNotFoundError(f"{path} has no committed run")
        return spark.createDataFrame([], schema)
    reader = lambda f: (spark.read.schema(schema) if schema is not None else spark.read).option("header", True)
    return union_by_name(*(reader(f).option("mergeSchema", True).format(f).load(folders) for f, folders in sorted(by_format.items())))


def remove_uncommitted(spark: SparkSession, path: str) -> int:
    """Deletes staged folders that no commit names, left by runs that died; call it while no run writes."""
    path = path.rstrip("/")
    fs, p = _fs(spark, f"{path}/staged")
    named = {c["folder"] for c in commits(spark, path).values()}
    stale = [s.getPath() for s in fs.listStatus(p) if f"staged/{s.getPath().getName()}" not in named] if fs.exists(p) else []
    for s in stale:
        fs.delete(s, True)
    return len(stale)


def reset(spark: SparkSession, paths: list[str]) -> None:
    """Deletes outputs of earlier runs; absent ones are no error."""
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
