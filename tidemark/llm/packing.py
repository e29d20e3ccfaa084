"""Packing by shortest pack first over the length histogram.

Documents are encoded once and cut into pieces of at most ``limit`` ids; only the pieces' lengths
and checksums are kept.  The histogram of piece lengths has at most ``limit`` rows whatever the
input, so the driver can place it: lengths from the longest on, each piece into the pack with the
most room, all packs of one pattern at a time.  A pattern is a run-length list of lengths with a
count.  Pieces then find their pack by their rank among the pieces of their length; ranks are
counted within (length, bucket), so a length that holds a third of all rows is split over buckets.

Nulls: a null text is empty; it still has its final id and so one piece.  A null document id stays
null.  Equal rows are packed once each.  An empty table gives an empty result.  Columns besides
the id and the text are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .encoding import encoder

Pattern = tuple[tuple[int, int], ...]


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[Pattern, int]]:
    """Patterns ``((length, times), ...)`` with their counts; lengths are from 1 to ``limit``."""
    packs: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    room: list[int] = []  # negated, as a heap

    def put(space: int, pattern: Pattern, count: int) -> None:
        if not packs[space]:
            heapq.heappush(room, -space)
        packs[space].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            while room and not packs[-room[0]]:
                heapq.heappop(room)
            if not room or -room[0] < length:  # no pack has room: open new ones, each at once as full as its turn would make it
                each = limit // length
                full, rest = divmod(left, each)
                for times, count in ((each, full), (rest, 1)):
                    if times and count:
                        put(limit - times * length, ((length, times),), count)
                break
            space = -room[0]
            pattern, count = packs[space].pop()
            used = min(left, count)
            if count > used:
                packs[space].append((pattern, count - used))
            grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
            put(space - length, grown, used)
            left -= used
    return [x for space in sorted(packs) for x in packs[space]]


def pieces(docs: DataFrame, vocabulary: str, limit: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, length, ids_crc32, doc_tokens)``: each document's ids and the end id, cut every ``limit`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([end_id], np.uint32)
        for b in batches:
            at, rows = [], []
            for k, t in enumerate(b.column(1)):
                ids = np.concatenate((enc.ids(t.as_py() or ""), end)).astype("<u4", copy=False)
                for s in range(0, len(ids), limit):
                    part = ids[s : s + limit]
                    at.append(k)
                    rows.append((s, len(part), zlib.crc32(part.tobytes()), len(ids)))
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), (), ()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, vocabulary: str, limit: int = 2048, end_id: int = 1, bucket_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``; sequences are gapless from offset 0."""
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary, limit, end_id, id_col, text_col), "pieces")
    n_buckets = max(64, cut.count() // bucket_rows)
    bucket = F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(n_buckets))
    by_bucket = cut.groupBy("length", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows

    slots, first_id, taken = [], 0, defaultdict(int)
    for pattern, count in shortest_pack_first(histogram, limit):
        offset = 0
        for length, times in pattern:
            slots.append((length, taken[length], first_id, times, offset))
            taken[length] += count * times
            offset += length * times
        first_id += count
    # Rows of one length follow each other on one number line of ranks, so that one sorted search finds a row's slot.
    base, total = np.zeros(limit + 2, np.int64), 0
    for length in range(1, limit + 1):
        base[length], total = total, total + taken[length]
    table = np.array(slots, np.int64).reshape(-1, 5)
    starts = base[table[:, 0]] + table[:, 1]
    order = np.argsort(starts)
    shared = spark.sparkContext.broadcast((base, starts[order], table[order]))  # bounded by the patterns, not by the rows

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "bucket", "ahead")
    within = Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("ahead"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, starts, table = shared.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = base[length] + rank
            s = np.searchsorted(starts, at, side="right") - 1
            nth, slot = at - starts[s], table[s]
            placed = slot[:, 2] + nth // slot[:, 3], slot[:, 4] + length * (nth % slot[:, 3])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), *(pa.array(x, pa.int64()) for x in placed)], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
