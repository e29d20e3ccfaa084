"""Hard negatives by a two-dimensional block matrix product.

Components become ``floor(256 x)``; a row's score is its integer inner product with the anchor.  An
anchor's positives are its best rows of the same label; for each, its hard negatives are the best
rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's.

* Shards: rows are sorted by label and id over all tasks and cut into blocks of ``ROWS``, and each
  block's components into chunks of ``CHUNK``; anchors likewise into blocks of ``ANCHORS``.
* Product: groups of anchor blocks and row blocks meet chunk by chunk, one group pair and chunk a
  task; each gives a partial score tile (anchor block x row block).  Tiles of the same blocks are
  shuffled together and added as 64-bit integers.
* First pass: only blocks whose label ranges overlap meet; every tile gives each anchor's best rows
  of its label, of which the best over all tiles are its positives.
* Second pass: all blocks meet; every tile gives the best rows inside each positive's window, of
  which the best over all tiles are the negatives.

Anchors are a stated query set, so all anchors meet all rows in blocks; a tile has a bounded size,
and what leaves a tile is a few rows an anchor.  Nothing but block numbers and counts reaches the driver.

Nulls: rows with a null id, label or vector, or a null or non-finite component, take no part.  A
shorter vector counts as followed by zeros, an empty one as zeros.  ``floor(256 x)`` is held within
2^26, so that sums of 2,048 products are exact.  Repeated rows are rows of their own: a repeated
anchor is answered each time, a repeated candidate takes a place each time; rows with the anchor's
id are not its positives.  Ties go to the smaller id.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

#: Rows of a block, anchors of a block, components of a chunk; blocks of each side that meet in one task.
ROWS, ANCHORS, CHUNK = 2048, 256, 32
TOGETHER = 4
#: floor(256 x) is held within this; products of a chunk below 2^53 are added exactly as doubles.
MOST = 1 << 26
NEVER = np.iinfo(np.int64).max


def _usable(vectors: DataFrame, labels: Column, id_col: str, vector_col: str) -> DataFrame:
    """``(id, label, q)`` of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(v, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x, F.lit(-1e15)), F.lit(1e15)) * 256), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), labels.cast("long").alias("label"), F.when(fine, q).alias("q"))
    return rows.filter("id is not null and label is not null and q is not null")


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``(block, chunk, first, last, n, ids, labels, body)``: sorted rows in blocks, a row by chunk; ids and labels come with chunk 0."""
    parts = max(1, min(rows.count() // (4 * size), 4096))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nth = [], 0

        def block() -> pa.RecordBatch:
            nonlocal nth
            ids, labels = (np.array([r[k] for r in held], np.int64) for k in (0, 1))
            order = np.argsort(ids, kind="stable")
            wide = max(1, max(len(r[2]) for r in held))
            q = np.zeros((len(held), wide), np.int32)
            for i, k in enumerate(order):
                q[i, : len(held[k][2])] = held[k][2]
            ids, labels = ids[order], labels[order]
            out = [(nth, c // CHUNK, int(labels.min()), int(labels.max()), len(ids), ids.tobytes() if not c else None, labels.tobytes() if not c else None, np.ascontiguousarray(q[:, c : c + CHUNK]).tobytes()) for c in range(0, wide, CHUNK)]
            nth += 1
            held.clear()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["nth", "chunk", "first", "last", "n", "ids", "labels", "body"])

        for b in batches:
            for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                held.append(r)
                if len(held) == size:
                    yield block()
        if held:
            yield block()

    made = rows.repartitionByRange(parts, "label", "id").sortWithinPartitions("label", "id").mapInArrow(cut, "nth long, chunk int, first long, last long, n int, ids binary, labels binary, body binary")
    return written(made.withColumn("block", F.spark_partition_id().cast("long") * (1 << 32) + F.col("nth")).drop("nth"), name)


def _numbers(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, np.int32).reshape(n, -1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while they can't round, else in 64-bit integers."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    if wide * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _tiles(anchors: DataFrame, rows: DataFrame, same_label: bool) -> DataFrame:
    """``(a, b, chunk, body, a_ids, a_labels, b_ids, b_labels, ...)``: the partial tiles of all block pairs that may hold an answer.

    Both sides are dealt to a grid of (anchor group, row group, chunk), each cell holding a bounded number of blocks.
    """
    numbered = lambda df: df.select("block").distinct().withColumn("nth", F.row_number().over(Window.orderBy("block")) - 1)  # noqa: E731  one row a block
    grid = {}
    for side, df in (("a", anchors), ("b", rows)):
        nth = numbered(df)
        grid[side] = df.join(F.broadcast(nth), "block").withColumn(f"{side}_group", F.floor(F.col("nth") / TOGETHER).cast("int")).drop("nth")
    spans = {s: d.groupBy(f"{s}_group").agg(F.min("first").alias(f"{s}_first"), F.max("last").alias(f"{s}_last")) for s, d in grid.items()}  # a row for each group of blocks
    if same_label:
        cells = written(spans["a"].join(spans["b"], (F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last"))).select("a_group", "b_group"), "cells")
        left, right = grid["a"].join(cells, "a_group"), grid["b"].join(cells, "b_group")
    else:
        n = {s: (d.agg(F.max(f"{s}_group")).first()[0] or 0) + 1 for s, d in spans.items()}
        left = grid["a"].withColumn("b_group", F.explode(F.sequence(F.lit(0), F.lit(n["b"] - 1))))
        right = grid["b"].withColumn("a_group", F.explode(F.sequence(F.lit(0), F.lit(n["a"] - 1))))

    def multiply(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for a in x.itertuples():
            p = _numbers(a.body, a.n)
            for b in y.itertuples():
                if same_label and (a.first > b.last or b.first > a.last):
                    continue
                t = _product(p, _numbers(b.body, b.n))
                small = np.abs(t).max(initial=0) < 1 << 31
                yield pd.DataFrame({"a": [a.block], "b": [b.block], "body": [t.astype(np.int32 if small else np.int64).tobytes()], "wide": [4 if small else 8], "a_ids": [a.ids], "a_labels": [a.labels], "b_ids": [b.ids], "b_labels": [b.labels], "sought": [a.sought]})

    kinds = "a long, b long, body binary, wide int, a_ids binary, a_labels binary, b_ids binary, b_labels binary, sought binary"
    keys = ["a_group", "b_group", "chunk"]

    def met(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        made = list(multiply(x, y))
        return pd.concat(made) if made else pd.DataFrame(columns=[k.split()[0] for k in kinds.split(", ")])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(met, kinds)


def _summed(pdf: pd.DataFrame):
    """The whole tile, and what belongs to it."""
    head = pdf[pdf["a_ids"].notna()].iloc[0]
    a_ids, a_labels, b_ids, b_labels = (np.frombuffer(head[k], np.int64) for k in ("a_ids", "a_labels", "b_ids", "b_labels"))
    tile = np.zeros((len(a_ids), len(b_ids)), np.int64)
    for body, wide in zip(pdf["body"], pdf["wide"]):
        tile += np.frombuffer(body, np.int32 if wide == 4 else np.int64).reshape(tile.shape)
    return tile, a_ids, a_labels, b_ids, b_labels, head["sought"]


def _in_order(tile: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row: columns by falling score, then position, those that don't fit last; and the scores in that order."""
    n = tile.shape[1]
    if np.abs(tile).max(initial=0) < (1 << 62) // max(n, 1):
        key = np.where(fit, np.arange(n) - tile * n, NEVER)
        key.sort(axis=1)
        at = np.where(key == NEVER, 0, key % n)
    else:
        key = np.where(fit, -tile, NEVER)
        at = np.argsort(key, axis=1, kind="stable")
    last = np.arange(n) >= fit.sum(axis=1)[:, None]
    return at, np.where(last, -NEVER, np.take_along_axis(tile, at, 1))


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, every: int = 100, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for anchors with ids divisible by ``every``.

    Negatives satisfy ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    usable = written(_usable(vectors, F.col("label") if label is None else label, id_col, vector_col), "usable")
    rows = _blocks(usable, ROWS, "rows")
    anchors = _blocks(usable.filter(F.col("id") % every == 0), ANCHORS, "anchors")
    drop_written(usable)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        tile, a_ids, a_labels, b_ids, b_labels, _ = _summed(pdf)
        fit = (a_labels[:, None] == b_labels) & (a_ids[:, None] != b_ids)
        at, score = _in_order(tile, fit)
        i, k = np.nonzero(score[:, :positives] > -NEVER)
        return pd.DataFrame({"a": pdf["a"].iloc[0], "nth": i, "id": b_ids[at[i, k]], "score": score[i, k]})

    first = _tiles(anchors.withColumn("sought", F.lit(None).cast("binary")), rows, True).groupBy("a", "b").applyInPandas(best, "a long, nth int, id long, score long")
    by = Window.partitionBy("a", "nth").orderBy(F.desc("score"), "id")
    chosen = written(first.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= positives), "positives")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["nth", "k"])[["nth", "k", "id", "score"]].to_numpy(np.int64)
        return pd.DataFrame({"block": pdf["a"].iloc[:1], "sought": [p.tobytes()]})

    sought = chosen.groupBy("a").applyInPandas(packed, "block long, sought binary")  # a block's anchors, so of bounded size

    def windows(pdf: pd.DataFrame) -> pd.DataFrame:
        tile, a_ids, a_labels, b_ids, b_labels, wanted = _summed(pdf)
        p = np.frombuffer(wanted, np.int64).reshape(-1, 4)
        fit = a_labels[:, None] != b_labels
        at, score = _in_order(tile, fit)
        out = []
        for i, k, pid, ps in p.tolist():
            falling = -score[i]
            begin = int(np.searchsorted(falling, -(high * ps // 100), "left"))  # the first score <= high * ps / 100
            end = min(begin + negatives, int(np.searchsorted(falling, -(-(-low * ps // 100)), "right")))
            out += [(i, k, int(a_ids[i]), pid, ps, int(b_ids[at[i, j]]), int(score[i, j])) for j in range(begin, end) if score[i, j] > -NEVER]
        cols = ["nth", "k", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pd.DataFrame(out, columns=cols).assign(a=pdf["a"].iloc[0])[["a", *cols]]

    kinds = "a long, nth int, k int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _tiles(anchors.join(sought, "block"), rows, False).groupBy("a", "b").applyInPandas(windows, kinds)
    within = Window.partitionBy("a", "nth", "k").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
