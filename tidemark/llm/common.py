"""Shared helpers: the shared folder, document preparation and text hashing."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of every operator here: space and U+0009 to U+000D.
#: ``bytes.split()`` splits at exactly these and ``bytes.lower()`` lowers A-Z only,
#: so Python code works on UTF-8 bytes and never on ``str.split()``.
SPACES = " \t\n\x0b\x0c\r"

_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where unset, a folder of this process on a local master and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _FALLBACK[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later plans start from its files, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Removes the files of a table from ``written`` that no later plan reads."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of finished plans go, which executors keep on disk until the driver collects its garbage.

    Late events of a plan still refer to it for a moment, so this collects three times.
    """
    for k in range(3):
        if k:
            time.sleep(0.25)
        gc.collect()
        spark._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, UTF-8 bytes)`` of every row; a null text is empty, other columns are dropped."""
    return docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))


def remainder(id_col: str, n: int):
    """crc32(id as text) mod n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in text order, from the words' hashes."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    n = len(words) - width + 1
    h = words[:n].copy()
    for k in range(1, width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mixed(h)


_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS


class Words:
    """All words of a run of texts: ``hashes``, byte positions ``first`` and ``end`` in ``data``, and ``count`` by text.

    Words are runs of bytes other than the six spaces, with A-Z lowered.  A word's hash is a
    polynomial in its bytes, from prefix sums over all texts at once, mixed with its length.
    """

    def __init__(self, bodies: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*bodies, b""]).lower(), np.uint8)
        space = _IS_SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(self.data) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.first, self.end = edge[0::2], edge[1::2]
        up, down = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        self.hashes = mixed((sums[self.end] - sums[self.first]) * down[self.first] + (self.end - self.first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ends = np.cumsum([len(x) + 1 for x in bodies])
        self.count = np.diff(np.searchsorted(self.first, np.concatenate(([0], ends))))


def word_runs(bodies: Iterator[bytes], size: int = 1 << 20) -> Iterator[tuple[list[bytes], Words]]:
    """The texts in runs of about ``size`` bytes, each with its words."""
    held, n = [], 0
    for body in bodies:
        held.append(body)
        n += len(body) + 1
        if n >= size:
            yield held, Words(held)
            held, n = [], 0
    if held:
        yield held, Words(held)


def tree_summed(made: DataFrame, parts: int, dtype, join=np.add, fan: int = 64, merge=None) -> DataFrame:
    """``(block, body)`` arrays of all tasks joined block by block, at most ``fan`` copies at a time.

    ``made``: rows ``(block int, body binary)`` of numpy arrays of ``dtype``; ``parts``: how many
    partitions may hold a copy of a block, each at most one.  ``merge`` joins a list of copies at once.
    """

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        if merge:
            total = merge([np.frombuffer(x, dtype) for x in pdf["body"]])
        else:
            total = np.frombuffer(pdf["body"].iloc[0], dtype).copy()
            for x in pdf["body"].iloc[1:]:
                join(total, np.frombuffer(x, dtype), out=total)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["part"].iloc[:1], "body": [total.tobytes()]})

    made = made.withColumn("part", F.spark_partition_id())
    while True:
        parts = -(-parts // fan)
        made = made.withColumn("part", (F.col("part") / fan).cast("int")).groupBy("block", "part").applyInPandas(joined, "block int, part int, body binary")
        if parts <= 1:
            return made.select("block", "body")


def n_partitions(df: DataFrame) -> int:
    return max(1, df._jdf.queryExecution().toRdd().getNumPartitions())
