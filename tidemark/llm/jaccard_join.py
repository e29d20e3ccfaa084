"""N-gram Jaccard join with adaptive multi-match prefixes.

A text is the set of its word shingles.  Texts with equal sets are one class.  Two classes link
when ``|x & y| >= t |x | y|``; linked sets share at least ``ceil(t |x|)`` shingles, so in any common
order of shingles their first ``|x| - ceil(t |x|) + l`` shingles have at least ``l`` in common.

* Order: rare shingles first, by a sketch of document counts over all documents; the sketch grows
  with the table up to a bound and changes costs, never results.
* Prefix: each text starts with ``l = 1``; the more candidates the sketch lets expect from its
  prefix, the larger ``l``.  A pair is a candidate when it shares min(l_x, l_y) prefix shingles.
* Bound: of two prefixes the one that ends first in the order holds all that it shares with the
  other text, so a pair that shares ``s`` prefix shingles shares at most ``s`` plus the longer rest.
* Short lists: a shingle in the prefixes of up to ``SHORT`` classes gives all its pairs; they are
  counted by pair, which costs each prefix shingle a bounded number of rows.
* Long lists: their classes would meet in pairs without end, so they meet a pivot ``p`` instead,
  the class of the list with the largest share of its shingles in long lists (lists that overlap
  take the same).  With ``x = p - A + B`` a pair shares ``|p| - |Ax| - |Ay| + s`` shingles, where ``s``
  counts what the differences ``D = A u B`` have in common; so x and y link exactly when

      (100 + t) s >= Wx + Wy - (100 - t) |p|,     W = 100 |A| + t |B|   (t in percent).

  Both may link with p, and are then in one component already.  Else the right side asks ``y``, the
  one of lesser W, to share that many of its differences: those are matched by prefixes once more,
  now multi-match prefixes of differences, of which copies of one text share next to none.
* Parities: a set's hashes are counted by their leading bits, and of the counts only the parities
  are kept, two to four bits a hash.  Two sets' parities differ in no more places than there are
  hashes in one set alone, so most pairs that can't link go before any whole set travels.
* Verification: every pair left is counted on whole sets of 64-bit hashes.  The last pairs are
  made after the first links have joined components; pairs inside a component can't change it.

Prefixes are the largest table that is shuffled: they are made and met in ``TURNS`` turns, each with
its part of the shingles, and the files of one turn go before the next.

Nulls: a null text has an empty set and links with nothing; a null id takes part and its row's
component is that of its text.  Equal rows are one class.  An empty table gives an empty result.
Columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, mixed, n_partitions, release, tree_summed, window_hashes, word_runs, written
from .graph import components

#: Counters of the sketch and bits of the row filter, as powers of two: what small tables get, and the most (64 and 32 MB).
SKETCH_BITS = (20, 24)
BLOOM_BITS = (20, 28)
BLOCK = 1 << 14
#: Expected candidates of a prefix from which on one more shared shingle is asked for.
COSTS = (64, 512, 4096, 32768)
#: Lists of shingles that the sketch holds for frequent are dealt to as many tasks, and long from the start.
SALTS = 16
#: Partners in a list with which a class is paired directly, and how far ahead in a list it looks for them.
SHORT = 8
AHEAD = 256
#: Sets that meet one set in one task.
MEETING = 512
#: Turns in which the prefixes are shuffled; each cuts all texts into words once more.
TURNS = 2


def shingle_sets(bodies, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for held, words in word_runs(bodies):
        every = window_hashes(words.hashes, width)
        at = 0
        for n in words.count.tolist():
            if n >= width:
                s = np.sort(every[at : at + n - width + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif n:
                yield window_hashes(words.hashes[at : at + n], n) ^ np.uint64(0x5851F42D4C957F2D * n & (1 << 64) - 1)
            else:
                yield words.hashes[:0]
            at += n


def class_of(s: np.ndarray) -> int:
    """A hash of a set as a signed 64-bit number."""
    mask = (1 << 64) - 1
    h = int(s.sum(dtype=np.uint64)) * 0x9E3779B97F4A7C15 & mask
    h = (h ^ h >> 31 ^ int(np.bitwise_xor.reduce(s)) * 0xC2B2AE3D27D4EB4F ^ len(s)) * 0xBF58476D1CE4E5B9 & mask
    h ^= h >> 29
    return h - (1 << 64) if h >> 63 else h


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text; a null text counts as empty, a null id as no other."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"), row_key(id_col, text_col).alias("key"))


def _members(texts: DataFrame, width: int, kind: str) -> tuple[DataFrame, np.ndarray]:
    """``(id, class, n, key)`` of every row, and the sketch of shingle frequencies; one pass over the texts."""
    names = ["id", "class", "n", "key", "block", "body"]
    bits = min(max(SKETCH_BITS[0], int(texts.count()).bit_length()), SKETCH_BITS[1])

    def counted(sets: list[np.ndarray]) -> np.ndarray:
        return np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.int32)
        kind = None
        for b in batches:
            kind, bodies = b.column(0).type, b.column(1).to_pylist()
            cls, n, held, size = [], [], [], 0
            for s in shingle_sets(bodies, width):
                cls.append(class_of(s) if len(s) else None)
                n.append(len(s))
                held.append(s)
                size += len(s)
                if size > 1_000_000:
                    sketch += counted(held).astype(np.int32)
                    held, size = [], 0
            if size:
                sketch += counted(held).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), b.column(2), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        if sketch.any():
            blocks = sketch.reshape(-1, BLOCK)
            k = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kind), *(pa.nulls(k, pa.int64()) for _ in range(3)), pa.array(range(k), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names)

    made = written(texts.mapInArrow(run, f"id {kind}, class long, n long, key long, block int, body binary").withColumn("part", F.spark_partition_id()), "classes")
    sketch = np.zeros(1 << bits, np.int64)
    for r in _summed_counts(made.filter(F.col("block").isNotNull()).select("block", "body", "part"), n_partitions(texts)).collect():  # the sketch
        sketch[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(bytes(r["body"]), np.int64)
    release(texts.sparkSession)
    return made.filter(F.col("block").isNull()).select("id", "class", "n", "key"), sketch


def _summed_counts(arrays: DataFrame, parts: int) -> DataFrame:
    """As ``tree_summed`` for 32-bit counts that were written with their partition; sums are 64-bit."""

    def wide(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for x in pdf["body"]:
            total += np.frombuffer(x, np.int32) if len(x) == 4 * BLOCK else np.frombuffer(x, np.int64)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["part"].iloc[:1], "body": [total.tobytes()]})

    while True:
        parts = -(-parts // 64)
        arrays = arrays.withColumn("part", (F.col("part") / 64).cast("int")).groupBy("block", "part").applyInPandas(wide, "block int, part int, body binary")
        if parts <= 1:
            return arrays.select("block", "body")


def excess_of(sketch: np.ndarray) -> np.ndarray:
    """Documents of a bucket beyond what chance explains."""
    mean = float(sketch.mean())
    return np.maximum(sketch - mean - 3 * mean**0.5 - 1, 0).astype(np.float32)


def levels_of(sketch: np.ndarray) -> np.ndarray:
    """0 for a bucket of ordinary size, then by powers of two of its excess."""
    return np.floor(np.log2(np.maximum(excess_of(sketch), 0.5)) + 1).astype(np.int8)


def _bucket(s: np.ndarray, counters: int) -> np.ndarray:
    return (s >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def _prefixes(texts: DataFrame, width: int, percent: int, sketch: np.ndarray, turn: int) -> DataFrame:
    """``(t, salt, c, n, l)``: the prefix shingles of every class that are of this turn, its size, and the matches that it asks for."""
    shared = texts.sparkSession.sparkContext.broadcast((levels_of(sketch), excess_of(sketch)))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        level, expected = shared.value
        out: list[tuple[np.ndarray, int, int, int]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            t = np.concatenate([x[0] for x in out])
            c, n, need = (np.repeat([x[k] for x in out], [len(x[0]) for x in out]) for k in (1, 2, 3))
            out.clear()
            hot = level[_bucket(t, len(level))] > 8
            salt = np.where(hot, 1 + (c.astype(np.int64).view(np.uint64) % np.uint64(SALTS)).astype(np.int64), 0)
            return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(c.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(need.astype(np.int32))], ["t", "salt", "c", "n", "l"])

        for b in batches:
            for s in shingle_sets(b.column(0).to_pylist(), width):
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(c)
                bucket = _bucket(s, len(level))
                spare = len(s) + (-percent * len(s) // 100)
                order = np.argsort(level[bucket], kind="stable")  # within a level by hash
                cost = float(expected[bucket[order[: spare + 1]]].sum())
                need = min(1 + sum(cost > x for x in COSTS), len(s) - spare)
                prefix = s[order[: spare + need]]
                prefix = prefix[prefix % np.uint64(TURNS) == turn]
                if not len(prefix):
                    continue
                out.append((prefix, c, len(s), need))
                size += len(prefix)
                if size > 100_000:
                    yield rows()
                    size = 0
        if out:
            yield rows()

    return texts.select("body").mapInArrow(run, "t long, salt int, c long, n int, l int")


def _lists(prefixes: DataFrame) -> DataFrame:
    """``(t, salt, c, n, l)`` of the rows whose shingle stands in the prefixes of two classes at least.

    Lists lie sorted in partitions and are read as a stream of batches; none is ever held whole.
    Repeats of a class, which equal texts in several tasks give, are dropped on the way.  Rows of
    lists that are dealt to several tasks all stay.
    """
    names = ["t", "salt", "c", "n", "l"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, given = None, False  # the last row of the batch before, and whether it is given out
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if last is not None:
                rows = [np.concatenate(x) for x in zip(last, rows)]
            same = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
            fresh = np.concatenate(([True], ~same | (rows[2][1:] != rows[2][:-1])))
            again = (~np.concatenate(([True], ~same)))[fresh]  # in the list of the row before
            rows = [x[fresh] for x in rows]
            keep = (rows[1] > 0) | again
            keep[:-1] |= again[1:]
            out = keep.copy()
            out[0] &= not given
            last, given = [x[-1:] for x in rows], bool(keep[-1]) or len(keep) == 1 and given
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in rows], names)

    return prefixes.repartition("t", "salt").sortWithinPartitions("t", "salt", "c").mapInArrow(run, "t long, salt int, c long, n int, l int")


def _paired(lists: DataFrame, percent: int) -> DataFrame:
    """``(c, n, l, c2, n2, l2)`` of pairs that a list lets link, and the rows ``(t, c, n)`` of classes with too many such partners.

    A class shares at most ``most`` shingles with any other whose prefix doesn't end before its own:
    those of its prefix that stand in lists, and all of the rest.  So a pair can link only if the
    greater ``most`` reaches what its sizes ask for, which texts that share a passage alone fail.
    Lists are read by size as streams, each class looking ahead over those not too large for it; one
    with over ``SHORT`` partners, or over ``AHEAD`` to look at, leaves itself and them to a pivot.
    """
    own = lists.groupBy("c").agg(F.count(F.lit(1)).cast("int").alias("listed"))
    rows = lists.join(own, "c").withColumn("most", (F.col("listed") + F.ceil(F.col("n") * percent / 100) - F.col("l")).cast("int"))
    names = ["t", "c", "n", "l", "c2", "n2", "l2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reach = None, 0  # rows of the last list that may meet more, their marks, and up to what size all its rows are marked

        for b in chain(batches, (None,)):
            if b is not None and not b.num_rows or b is None and held is None:
                continue
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(6)] + [np.zeros(b.num_rows, bool)] if b is not None else [x[:0] for x in held]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            t, salt, n, c, need, most, long = now
            n, most = n.astype(np.int64), most.astype(np.int64)
            size = len(t)
            nth = np.concatenate(([0], np.cumsum((t[1:] != t[:-1]) | (salt[1:] != salt[:-1]))))
            end = size if b is None else max(int(np.searchsorted(nth, nth[-1])), size - AHEAD)
            long |= salt > 0
            i = np.flatnonzero(salt[:end] == 0)
            met, partners = [], np.zeros(size, np.int64)
            for d in range(1, AHEAD + 1):
                i = i[i + d < size]
                i = i[(nth[i + d] == nth[i]) & (percent * n[i + d] <= 100 * n[i])]
                if not len(i):
                    break
                if d < AHEAD:
                    hit = i[(100 + percent) * np.maximum(most[i], most[i + d]) >= percent * (n[i] + n[i + d])]
                    partners[hit] += 1
                    met.append((hit, hit + d))
            left = np.zeros(size, bool)
            left[i] = True  # not all looked at
            dense = left | (partners > SHORT)
            to = nth * (1 << 40) + np.where(left, 100 * n // percent, 0)
            to[0] = max(int(to[0]), reach)
            to = np.maximum.accumulate(to) - nth * (1 << 40)
            long |= dense | (to >= n)
            out = []
            if met:
                x, y = (np.concatenate(z) for z in zip(*met))
                many = dense[x]
                long[y[many]] = True
                x, y = x[~many], y[~many]
                if len(x):
                    out.append([pa.nulls(len(x), pa.int64()), *(pa.array(z[k]) for k in (x, y) for z in (c, now[2], need))])
            if (k := np.flatnonzero(long[:end])).size:
                none = pa.nulls(len(k), pa.int64())
                out.append([pa.array(z[k]) for z in (t, c, now[2], need)] + [none, none.cast(pa.int32()), none.cast(pa.int32())])
            held = [x[end:] for x in (t, salt, now[2], c, need, now[5], long)] if end < size else None
            reach = int(to[-1]) if end < size else 0
            for x in out:
                yield pa.RecordBatch.from_arrays(x, names)

    dealt = rows.select("t", "salt", "n", "c", "l", "most").repartition("t", "salt").sortWithinPartitions("t", "salt", "n", "c")
    return dealt.mapInArrow(run, "t long, c long, n int, l int, c2 long, n2 int, l2 int")


def _candidates(lists: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: pairs of short lists that share enough prefix shingles; what a pair shares in long lists its pivot answers for."""
    rest = lambda n, l: F.ceil(F.col(n) * percent / 100) - F.col(l)
    needed = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent))
    counted = lists.filter(F.col("t").isNull()).groupBy("c", "n", "l", "c2", "n2", "l2").agg(F.count(F.lit(1)).alias("s"))
    enough = (F.col("s") >= F.least("l", "l2")) & (F.col("s") + F.greatest(rest("n", "l"), rest("n2", "l2")) >= needed)
    return counted.filter(enough).select(F.col("c").alias("a"), F.col("c2").alias("b"))


def _pivots(lists: DataFrame) -> DataFrame:
    """``(c, p)``: every class of a long list and the list's pivot.

    A list is led by its class with the most of its shingles in long lists; each class then goes by
    the best lead of its lists and each list by the best of its classes, so that lists of one group agree.
    """
    rows = lists.filter(F.col("t").isNotNull()).select("t", "c", "n")
    share = rows.groupBy("c").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    rows = rows.join(share, "c").select("t", "c", F.struct("share", F.xxhash64("c").alias("h"), F.col("c").alias("p")).alias("by"))
    lead = rows.groupBy("t").agg(F.max("by").alias("by"))
    root = rows.select("t", "c").join(lead, "t").groupBy("c").agg(F.max("by").alias("by"))
    rooted = rows.select("t", "c").join(root, "c")
    of = rooted.groupBy("t").agg(F.max("by").alias("by"))
    return rows.select("t", "c").join(of, "t").select("c", F.col("by.p").alias("p")).distinct()


def _row_filter(keys: DataFrame) -> np.ndarray:
    """A field of bits, of bounded size, in which all keys' bits are set; more keys than it can tell apart only cost time."""
    size = min(max(BLOOM_BITS[0], (64 * keys.count()).bit_length()), BLOOM_BITS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << size - 3, np.uint8)
        for b in batches:
            at = mixed(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - size)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        blocks = bits.reshape(-1, 1 << 14)
        full = np.flatnonzero(blocks.any(axis=1))
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([blocks[k].tobytes() for k in full], pa.binary())], ["block", "body"])

    bits = np.zeros(1 << size - 3, np.uint8)
    for r in tree_summed(keys.mapInArrow(run, "block int, body binary"), n_partitions(keys), np.uint8, np.bitwise_or).collect():  # the field
        bits[r["block"] << 14 : (r["block"] + 1) << 14] = np.frombuffer(bytes(r["body"]), np.uint8)
    return bits


def _in_filter(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = mixed(keys.view(np.uint64)) >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def parities(s: np.ndarray) -> bytes:
    """The size of a set, then whether the number of its hashes with the same leading bits is odd."""
    size = max((2 * len(s) - 1).bit_length(), 3)
    odd = np.bincount((s >> np.uint64(64 - size)).astype(np.int64), minlength=1 << size) & 1
    return np.int64(len(s)).tobytes() + np.packbits(odd.astype(bool)).tobytes()


def may_link(nx: int, x: np.ndarray, ny: int, y: np.ndarray, percent: int) -> bool:
    """Whether sets of ``nx`` and ``ny`` hashes with the parities ``x`` and ``y`` (0 or 1 each) can link."""
    while len(x) > len(y):
        x = x[0::2] ^ x[1::2]
    while len(y) > len(x):
        y = y[0::2] ^ y[1::2]
    return (100 + percent) * (nx + ny - int(np.count_nonzero(x != y))) >= 2 * percent * (nx + ny)


def _sets(texts: DataFrame, width: int, bits: np.ndarray, given: Callable[[np.ndarray], bytes]) -> DataFrame:
    """``(c, s)``: what is ``given`` of the sets of the rows whose key's bit is set; other texts aren't cut into words."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits = set(), shared.value
        for b in batches:
            hit = _in_filter(b.column(1).to_numpy(zero_copy_only=False), bits)
            cs, sets, held = [], [], 0
            for s in shingle_sets(b.column(0).filter(pa.array(hit)).to_pylist(), width):
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(c)
                cs.append(c)
                sets.append(given(s))
                held += len(sets[-1])
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(sets, pa.binary())], ["c", "s"])
                    cs, sets, held = [], [], 0
            if cs:
                yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(sets, pa.binary())], ["c", "s"])

    return texts.select("body", "key").mapInArrow(run, "c long, s binary")


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``y``, both sorted."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _asked(n: int, gone: int, cut: int, d: int, percent: int, link: bool) -> int:
    """How many of its first ``d`` differences from a pivot of size ``gone`` a class of size ``n`` can be asked for by ``_open_pairs``."""
    w, room, every = 100 * cut + percent * (d - cut), (100 - percent) * gone, 100 + percent
    below = -(-(w + max(w - room, 1)) // every)
    above = max(-(-(w - room + max(w - 100 * (n * (100 - percent) // percent), 0)) // every), 1)
    return max(d - (below if link else min(below, above)) + 1, 0)


def _meetings(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(b, salt, a, wide, s)`` of ``pairs (a, b, wide)``: each b, with a null ``a``, lies before its partners in a partition.

    Partitions are read as streams; a set with many partners lies in several.  ``sets`` are joined
    once, and may hold sets that no pair has, and repeats.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("salts"))
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("a"), F.col("salts"))).otherwise(0).cast("int").alias("salt")
    dealt = pairs.join(many, "b").select("b", salt, "a", "wide", F.col("a").alias("c"))
    heads = many.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), F.lit(False).alias("wide"), F.col("b").alias("c"))
    rows = heads.unionByName(dealt).join(sets, "c").select("b", "salt", "a", "wide", "s")
    return rows.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").isNotNull(), "a")


def _near(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs (a, b)`` whose parities in ``marks`` let them link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, before = None, None
        for b in batches:
            out = []
            for u, v, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(4)):
                if (u, v) == before:  # a set that several rows gave
                    continue
                before, s = (u, v), np.frombuffer(s.as_buffer(), np.uint8)
                x = int(s[:8].view(np.int64)[0]), np.unpackbits(s[8:])
                if v is None:
                    y = x
                elif may_link(*x, *y, percent):
                    out.append((v, u))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return _meetings(pairs.select("a", "b", F.lit(False).alias("wide")), marks).mapInArrow(run, "a long, b long").withColumn("wide", F.lit(False))


def _met(pairs: DataFrame, sets: DataFrame, percent: int, level: np.ndarray | None = None) -> DataFrame:
    """``(a, b, link, wide, cut, gone, n, d)`` of ``pairs (a, b, wide)``: whether they link and, where ``wide``, how ``a`` differs from ``b``.

    ``cut`` counts what a lacks of b, ``gone`` and ``n`` are the sizes of b and a, and ``d`` holds as
    many differences as can be asked for, those that few others will have first.  Pairs that neither
    link nor are wide go.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(level)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, y, before = shared.value, None, None
        rarity = np.exp2(level.astype(np.float32)) if level is not None else None
        for b in batches:
            out = []
            for u, v, wide, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                if (u, v) == before:  # a set that several rows gave
                    continue
                before = (u, v)
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if v is None:
                    y = s.copy()
                    if rarity is not None:
                        own = rarity[_bucket(y, len(level))]
                        usual = float(np.median(own))
                    continue
                inside = _common(s, y)
                both = int(inside.sum())
                link = 100 * both >= percent * (len(s) + len(y) - both)
                d = None
                if wide:
                    more, lost = s[~inside], ~_common(y, s)
                    few = np.concatenate((rarity[_bucket(more, len(level))], np.maximum(np.maximum(usual - own[lost], usual / 8), 1) + 0.5))
                    d = np.concatenate((more, y[lost]))
                    d = d[np.lexsort((d, few))][: _asked(len(s), len(y), len(y) - both, len(d), percent, link)].view(np.int64)
                if link or wide:
                    out.append((v, u, link, wide, len(y) - both, len(y), len(s), d))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], ["a", "b", "link", "wide", "cut", "gone", "n", "d"])

    return _meetings(pairs, sets).mapInArrow(run, "a long, b long, link boolean, wide boolean, cut int, gone int, n int, d array<long>")


def _open_pairs(differences: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: classes of one pivot, in different components, that share enough of their differences from it to link."""
    every = 100 + percent
    parts = parts.select(F.col("v").alias("c"), "component")
    rows = differences.select(F.col("a").alias("c"), F.col("b").alias("p"), "cut", "gone", "n", "d").join(parts, "c", "left").withColumn("k", F.coalesce("component", "c"))
    rows = rows.join(parts.select(F.col("c").alias("p"), F.col("component").alias("kp")), "p", "left").withColumn("apart", F.col("k") != F.coalesce("kp", "p"))
    more = F.col("n") - F.col("gone") + F.col("cut")
    rows = rows.withColumn("all", F.col("cut") + more)
    rows = rows.withColumn("w", (100 * F.col("cut") + percent * more).cast("long")).withColumn("room", ((100 - percent) * F.col("gone")).cast("long"))
    least = rows.filter("apart").groupBy("p").agg(F.min(F.col("w") - F.col("room")).alias("over"))
    rows = rows.join(least, "p")  # pivots all of whose classes are in one component go
    below = F.ceil((F.col("w") + F.greatest(F.col("w") - F.col("room"), F.col("over"), F.lit(1))) / every)
    apart = 100 * F.floor(F.col("n") * (100 - percent) / percent)  # at most so much less can the other's w be
    above = F.greatest(F.ceil((F.col("w") - F.col("room") + F.greatest(F.col("w") - apart, F.lit(0))) / every), F.lit(1))

    def prefix(need: Column) -> Column:
        return F.explode(F.slice("d", F.lit(1), F.greatest(F.col("all") - need.cast("int") + 1, F.lit(0)))).alias("t")

    keys = ("p", F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("w").alias("w2"), F.col("k").alias("k2"))
    y = rows.select(*keys, prefix(below))
    x = rows.filter("apart").select("p", "c", "n", "w", "k", prefix(above))
    before = (F.col("w2") < F.col("w")) | ((F.col("w2") == F.col("w")) & (F.col("c2") < F.col("c")))
    fits = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    met = x.join(y, ["p", "t"]).filter(before & (F.col("k") != F.col("k2")) & fits)
    small = F.col("n") < F.col("n2")
    return met.select(F.when(small, F.col("c")).otherwise(F.col("c2")).alias("a"), F.when(small, F.col("c2")).otherwise(F.col("c")).alias("b")).distinct()


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """``(id, n_shingles, key, component)`` of every document: rows of one component reach each other by links."""
    texts = _texts(docs, id_col, text_col)
    members, sketch = _members(texts, width, docs.schema[id_col].dataType.simpleString())
    turns = []
    for k in range(TURNS):
        turns.append(written(_lists(_prefixes(texts, width, percent, sketch, k)), "lists"))
        release(docs.sparkSession)
    lists = written(_paired(reduce(DataFrame.union, turns), percent), "paired")
    for x in turns:
        drop_written(x)
    release(docs.sparkSession)
    wide = _pivots(lists).filter("c <> p").select(F.col("c").alias("a"), F.col("p").alias("b"), F.lit(True).alias("wide"))
    narrow = _candidates(lists, percent).select("a", "b", F.lit(False).alias("wide"))
    pairs = written(wide.unionByName(narrow).groupBy("a", "b").agg(F.max("wide").alias("wide")), "pairs")
    drop_written(lists)

    reps = members.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("key").alias("key"))

    def of_pairs(pairs: DataFrame, given: Callable[[np.ndarray], bytes], name: str) -> DataFrame:
        needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        keys = written(needed.join(reps, "class").select("key"), "keys")
        found = written(_sets(texts, width, _row_filter(keys), given), name)
        drop_written(keys)
        return found

    marks = of_pairs(pairs, parities, "marks")
    near = written(pairs.filter("wide").unionByName(_near(pairs.filter("not wide"), marks, percent)), "near")
    drop_written(pairs)
    sets = of_pairs(near, np.ndarray.tobytes, "sets")
    first = written(_met(near, sets, percent, levels_of(sketch)), "met")
    drop_written(near)
    release(docs.sparkSession)
    links = first.filter("link").select(F.col("a").alias("u"), F.col("b").alias("v"))
    parts = written(components(links), "components")

    more = written(_near(_open_pairs(first.filter("wide"), parts, percent), marks, percent), "pairs")
    if not more.isEmpty():
        found = written(_met(more, sets, percent), "met")
        joined = components(parts.select(F.col("v").alias("u"), F.col("component").alias("v")).union(found.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        before, parts = parts, written(joined, "components")
        drop_written(before)
        drop_written(found)
        release(docs.sparkSession)
    for x in (more, first, sets, marks):
        drop_written(x)
    of = F.coalesce("component", "class")
    return members.join(parts.withColumnRenamed("v", "class"), "class", "left").select("id", F.col("n").alias("n_shingles"), "key", of.alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """``(id, n_shingles, component_id)``: the least id that a document reaches by links, its own included."""
    rows = similar_classes(docs, id_col, text_col, width, percent)
    least = rows.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("id").alias("least"))
    out = rows.join(least, "component", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each component: that of the least id, null ids last, and of the least hash among equal ids.

    Equal ids with texts that don't link stay both.  Rows without words link with nothing and all
    stay; of equal rows (same id, same text) with words one stays.
    """
    rows = written(similar_classes(docs, id_col, text_col, width, percent), "rows")
    best = rows.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))).alias("x"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    grouped = rows.filter("n_shingles > 0").join(best.select("component", F.col("x.key").alias("best")), "component")
    marked = written(grouped.groupBy("key").agg(F.first(F.col("key") == F.col("best")).alias("chosen"), F.count(F.lit(1)).alias("times")).filter("not chosen or times > 1"), "marked")
    drop_written(rows)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), row_key(id_col, text_col).alias("key"))
    bits = docs.sparkSession.sparkContext.broadcast(_row_filter(marked.select("key")))  # of bounded size

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        return pd.Series(_in_filter(key.to_numpy(), bits.value))

    rest = whole.withColumn("maybe", maybe("key"))  # only rows that the filter doesn't clear go through the joins
    left = rest.filter("maybe").join(marked.select("key"), "key", "left_anti")
    once = rest.filter("maybe").join(marked.filter("chosen").select("key"), "key", "left_semi").dropDuplicates(["key"])
    return rest.filter("not maybe").select("whole.*").unionByName(left.select("whole.*")).unionByName(once.select("whole.*"))
