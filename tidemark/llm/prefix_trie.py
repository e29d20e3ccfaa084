"""Prefix trie of conversations, built level by level.

Every conversation is rebuilt: the first ``h`` turns of its group's first conversation, then its own
turns after its first ``h``.  A node is a distinct sequence of turns; conversations that begin with
it are its members, and the least member's id names it at its depth.

* Down: at each depth the live conversations are grouped by (parent node, next turn); the least
  ``conv_id`` of a group names the new node, and an aggregate joined back hands it to the members.
  Turns are compared by 128 bits of a digest.  A conversation that is alone in its node leaves the
  loop: its later nodes form a chain with itself as the only member.
* Up: from the deepest level on, the nodes of a level are summed by parent (children, leaves, saved
  tokens) and joined to the level above.
* Digests of the ids that end in a node: ids are sorted over all tasks and joined to texts of a few
  kilobytes, which one task hashes in order as a stream.  SHA-256 is sequential, so the texts of one
  node pass through one task, but its ids never meet in memory.

A conversation's turns are numbered in stretches of turn numbers, so that a conversation of very
many turns is sorted by many tasks; only equal turn numbers of one conversation meet in one.

Nulls: a null role or text is empty, a null turn comes first, rows without ``conv_id`` belong to no
conversation and are left out.  Equal turn numbers are ordered by role, then text, in UTF-8 order;
repeated rows are turns of their own.  An empty table gives no rows.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, shared_dir, written

#: Turn numbers of one stretch, and letters of one text of joined ids.
STRETCH, LETTERS = 1 << 16, 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def _numbered(conversations: DataFrame) -> DataFrame:
    """``(c, at, turn_key, words)``: the turns of each conversation, numbered from 1."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH).cast("long"), F.lit(-(1 << 62))))
    own = rows.groupBy("c", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.withColumn("offset", F.sum("n").over(before)).filter("offset > 0").select("c", "stretch", "offset")
    nth = F.row_number().over(Window.partitionBy("c", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256), 1, 32))
    counted = rows.select("c", "stretch", nth.cast("long").alias("nth"), key.alias("turn_key"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    return counted.join(offsets, ["c", "stretch"], "left").select("c", (F.col("nth") + F.coalesce("offset", F.lit(0))).alias("at"), "turn_key", "words")


def rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(c, size)`` of every conversation and ``(c, pos, turn_key, words)`` of its rebuilt turns, as written tables."""
    turns = written(_numbered(conversations), "turns")
    counts = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    bases = counts.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    plans = counts.withColumn("base", F.col("c") - F.col("c") % group).join(bases, "base", "left").withColumn("h", h)
    plans = plans.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    plans = written(plans.select("c", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "plans")
    own = turns.join(plans, "c").filter("at > h").select("c", (F.col("at") - F.col("h") + F.col("taken")).alias("pos"), "turn_key", "words")
    # at most ``group`` conversations share a base, and only its first turns are handed out
    first = turns.filter((F.col("c") % group == 0) & (F.col("at") < most)).withColumnRenamed("c", "base")
    handed = first.join(plans.select("c", "base", "h"), "base").filter("at <= h").select("c", F.col("at").alias("pos"), "turn_key", "words")
    made = written(own.union(handed).repartitionByRange("pos", "c").sortWithinPartitions("pos", "c"), "rebuilt")
    drop_written(turns)
    return plans.select("c", "size"), made


def _joined_ids(ends: DataFrame) -> DataFrame:
    """``(depth, node, ends_sha256)`` of ``ends (depth, node, c)``: the digest of the ids in order, comma-joined."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, letters = None, [], 0
        out: list[tuple] = []

        def close() -> None:
            if ids:
                out.append((*at, ids[0], ",".join(map(str, ids))))

        for b in batches:
            for d, node, c in zip(*(b.column(k).to_pylist() for k in range(3))):
                if (d, node) != at or letters > LETTERS:
                    close()
                    at, ids, letters = (d, node), [], 0
                ids.append(c)
                letters += len(str(c)) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["depth", "node", "first", "ids"])
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["depth", "node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for b in batches:
            out = []
            for d, node, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 3))):
                if (d, node) != at:
                    if at:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (d, node), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "node", "ends_sha256"])
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, digest.hexdigest())], ["depth", "node", "ends_sha256"])

    short = ends.repartitionByRange("depth", "node", "c").sortWithinPartitions("depth", "node", "c").mapInArrow(texts, "depth long, node long, first long, ids string")
    return short.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(hashed, "depth long, node long, ends_sha256 string")


def _own_digest(ends: Column) -> Column:
    return F.when(ends, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING))


def prefix_trie(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conv_id`` (least member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    """
    spark = conversations.sparkSession
    convs, turns = rebuilt(conversations, group, most)
    path = f"{shared_dir(spark)}/tidemark/trie-{uuid.uuid4().hex}"
    one = convs.agg(F.min("c").alias("root"), F.count(F.lit(1)).alias("n")).first()
    empty = spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    if not one["n"]:
        return empty

    # down: (c, size, parent, child, n, words) of the live conversations of each depth
    kinds = "c long, size long, parent long, child long, n long, words int"
    level = lambda d: spark.read.schema(kinds).parquet(f"{path}/levels/depth={d}")
    live, depth = convs.withColumn("node", F.lit(one["root"]).cast("long")), 0
    while True:
        now = turns.filter(F.col("pos") == depth + 1).drop("pos").join(live, "c")
        groups = now.groupBy("node", "turn_key").agg(F.min("c").alias("child"), F.count(F.lit(1)).alias("n"))
        met = now.join(groups, ["node", "turn_key"]).select("c", "size", F.col("node").alias("parent"), "child", "n", "words")
        met.write.parquet(f"{path}/levels/depth={depth + 1}")
        if level(depth + 1).isEmpty():
            break
        depth += 1
        shared = level(depth).filter("n > 1 and size > " + str(depth))
        if shared.isEmpty():
            break
        live = shared.select("c", "size", F.col("child").alias("node"))

    # up: a node's row is that of its least member
    node_kinds = "conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long"
    nodes = lambda d: spark.read.schema(node_kinds).parquet(f"{path}/nodes/depth={d}")
    below = lambda d: nodes(d).groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    none = spark.createDataFrame([], "conv_id long, children long, leaves long, saved long")
    for d in range(depth, 0, -1):
        own = level(d).filter("c = child").withColumnRenamed("child", "conv_id")
        own = own.join(below(d + 1) if d < depth else none, "conv_id", "left")
        alone = F.col("n") == 1
        row = own.select("conv_id", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(alone, (F.col("size") > d).cast("long")).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), ((F.col("n") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), "size")
        row.write.parquet(f"{path}/nodes/depth={d}")

    names = empty.columns
    top = convs.filter("size = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(one["root"]).cast("long").alias("node"), "c")
    if depth:
        levels = spark.read.schema(f"{kinds}, depth long").option("basePath", f"{path}/levels").parquet(f"{path}/levels")
        every = spark.read.schema(f"{node_kinds}, depth long").option("basePath", f"{path}/nodes").parquet(f"{path}/nodes")
        sums = below(1).select("children", "leaves", "saved")
    else:
        levels = spark.createDataFrame([], f"{kinds}, depth long")
        every = spark.createDataFrame([], f"{node_kinds}, depth long")
        sums = spark.createDataFrame([(0, 1, 0)], "children long, leaves long, saved long")
    digests = _joined_ids(top.union(levels.filter("n > 1 and size = depth").select("depth", F.col("child").alias("node"), "c")))
    root = sums.select(F.lit(one["root"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(one["n"]).cast("long").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    shared = every.filter("n_convs > 1").select(*names[:-1]).union(root).join(digests.withColumnRenamed("node", "conv_id"), ["conv_id", "depth"], "left")
    shared = shared.select(*names[:-1], F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    alone = every.filter("n_convs = 1").withColumn("ends_sha256", _own_digest(F.col("size") == F.col("depth"))).select(*names)
    from_here = levels.filter("n = 1").select("c", "size", "depth")
    later = turns.select("c", "pos").join(from_here, "c").filter("pos > depth")
    chain = later.select(F.col("c").alias("conv_id"), F.col("pos").alias("depth"), F.col("c").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (F.col("pos") < F.col("size")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "size")
    chain = chain.withColumn("ends_sha256", _own_digest(F.col("size") == F.col("depth"))).select(*names)
    return shared.union(alone).union(chain)
