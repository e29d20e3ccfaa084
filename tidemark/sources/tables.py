"""Tables: reading with checks, writing with guards.  Parquet is the default, CSV and JSON lines work alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COLUMN_ALIASES, LOCAL_TZ, TARGET, TIMESTAMP, feature_columns
from ..operators import contracts
from ..operators.timeaxis import rebuilt_mismatches


def normal_name(name) -> str:
    return str(name).strip().lower().replace(" ", "_")


def standard_columns(df: DataFrame, aliases: dict[str, str] = COLUMN_ALIASES) -> DataFrame:
    """Trimmed lower-case names with aliases resolved; duplicates and competing aliases are errors.  No job runs."""
    names = [normal_name(c) for c in df.columns]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"columns of the same name: {twice}")
    for standard in set(aliases.values()):
        found = [n for n in names if aliases.get(n) == standard]
        if standard not in names:
            if len(found) > 1:
                raise ValueError(f"{found} all stand for {standard}")
            names = [standard if n in found else n for n in names]
    return df.toDF(*names)


def read(spark: SparkSession, path: str, format: str = "parquet", schema=None, **options) -> DataFrame:
    reader = spark.read.options(**({"header": True} if format == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).format(format).load(path)


def read_raw_hourly(spark: SparkSession, path: str, format: str = "csv", standardise: bool = True, check: bool = True, **options) -> DataFrame:
    """The raw hourly table: names standardised, target checked, never empty."""
    df = read(spark, path, format, **options)
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    df = standard_columns(df) if standardise else df
    if check:
        contracts.require_columns(df, [TIMESTAMP, TARGET])
        contracts.require(contracts.target_domain(df))
    return df


def read_series(spark: SparkSession, path: str, format: str = "parquet", tz: str = LOCAL_TZ, **options) -> DataFrame:
    """A preprocessed or split series; its UTC times must be what its local times give."""
    df = read(spark, path, format, **options)
    contracts.require_columns(df, [TIMESTAMP, TARGET, "timestamp_local_naive"])
    df = df.withColumn(TIMESTAMP, F.col(TIMESTAMP).cast("timestamp")).withColumn("timestamp_local_naive", F.col("timestamp_local_naive").cast("timestamp_ntz"))
    if n := rebuilt_mismatches(df, tz).first()["mismatches"]:
        raise ValueError(f"{n} rows have a UTC time that their local time doesn't give")
    contracts.require(contracts.series_contract(df))
    return df.orderBy(TIMESTAMP)


def read_matrix(spark: SparkSession, path: str, kind: str, format: str = "parquet", target: str = TARGET, **options) -> DataFrame:
    df = read(spark, path, format, **options)
    contracts.require_columns(df, [TIMESTAMP, target, *feature_columns(kind)])
    contracts.require(contracts.matrix_contract(df, kind, target))
    return df.orderBy(TIMESTAMP)


def timestamps_only(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Only the timestamps are read: labels stay unread."""
    return read(spark, path, format, **options).select(F.col(TIMESTAMP).cast("timestamp").alias(TIMESTAMP)).distinct().orderBy(TIMESTAMP)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that one lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def strict_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Casts that fail on what is no number."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def lenient_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Casts that give null for what is no number."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def write(df: DataFrame, path: str, format: str = "parquet", overwrite: bool = False, append: bool = False, by: list[str] = ()) -> None:
    """Without ``overwrite`` or ``append`` an existing path is an error."""
    mode = "append" if append else "overwrite" if overwrite else "errorifexists"
    writer = df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)
    (writer.option("header", True) if format == "csv" else writer).format(format).save(path)


def write_split(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One table partitioned by ``split``: a reader of one split reads its files only."""
    write(df, path, overwrite=overwrite, by=["split"])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require_absent(spark: SparkSession, paths: list[str], overwrite: bool = False) -> None:
    if not overwrite and (found := [p for p in paths if exists(spark, p)]):
        raise FileExistsError(f"exists already: {found}")


def read_if_present(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame | None:
    return read(spark, path, format) if exists(spark, path) else None


def markdown(df: DataFrame, digits: int = 6) -> str:
    """A small table as Markdown: nulls empty, floats of fixed digits, bars escaped."""

    def text(v) -> str:
        if v is None or v != v:
            return ""
        if isinstance(v, float):
            return f"{v:.{digits}f}"
        return (v.isoformat() if hasattr(v, "isoformat") else str(v)).replace("|", "\\|")

    rows = [[text(v) for v in r] for r in df.collect()]  # a report table
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])
