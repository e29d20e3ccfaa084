"""Exact length histogram: documents by encoded length, and suffix sums for every context limit.

Nulls: a null text is empty and has length 0.  Rows with equal ids count as often as they occur.
An empty table has an empty histogram.  Columns besides the text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder

#: Lengths in a block of the two-level suffix sums; blocks are summed apart, so no task sees all lengths.
BLOCK = 512


def length_histogram(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``(length, n_docs)``; each batch is counted before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(vocabulary), Counter()
        for b in batches:
            for t in b.column(0):
                seen[len(enc.ids(t.as_py() or ""))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["length", "n_docs"])

    counted = docs.select(F.col(text_col).cast("string").alias("body")).mapInArrow(run, "length long, n_docs long")
    return counted.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """For each occurring length as context limit: documents and tokens below and above it.

    ``docs_longer`` have more tokens than the limit; ``tokens_kept`` is the sum of
    min(length, limit), ``tokens_cut`` the rest; ``quantile`` is the share of documents of at
    most this length.  A limit between two occurring lengths follows by ``truncated_total``.
    """
    h = histogram.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"), *(F.sum(c).over(every).alias(f"{c}_all") for c in "dt"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.join(blocks, "block").withColumn("docs_longer", F.col("d_above") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("tokens_longer", F.col("t_above") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    kept = F.col("t_all") - F.col("tokens_longer") + F.col("docs_longer") * F.col("length")
    return h.select("length", "n_docs", "tokens", "docs_longer", "tokens_longer", kept.alias("tokens_kept"), (F.col("t_all") - kept).alias("tokens_cut"), ((F.col("d_all") - F.col("docs_longer")) / F.col("d_all")).alias("quantile"), F.col("d_all").alias("total_docs"), F.col("t_all").alias("total_tokens"))


def truncated_total(totals: DataFrame, limits: list[int]) -> DataFrame:
    """``(limit, total_tokens, tokens_kept)`` for any limits: at the largest length up to the limit, plus the limit for every longer document."""
    spark = totals.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    whole = totals.agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    up_to = asked.join(totals, totals["length"] <= asked["limit"]).groupBy("limit").agg(F.max_by("docs_longer", "length").alias("over"), F.max_by("tokens_longer", "length").alias("over_tokens"))
    out = asked.join(F.broadcast(whole)).join(up_to, "limit", "left")
    over, over_tokens = F.coalesce("over", "d"), F.coalesce("over_tokens", "t")
    return out.select("limit", F.coalesce("t", F.lit(0)).alias("total_tokens"), F.coalesce(F.col("t") - over_tokens + over * F.col("limit"), F.lit(0)).alias("tokens_kept"))


def length_quantile(totals: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, length)``: the least length that at least this share of documents doesn't exceed."""
    asked = totals.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return asked.join(totals, totals["quantile"] >= asked["share"]).groupBy("share").agg(F.min("length").alias("length"))
