"""Near duplicates among embeddings by a robust-pruned flat graph.

Vectors are compared within their label only.  Equal vectors are one class.  Classes of a large
label are dealt to the clusters of centroids fitted on a bounded sample: each is at home with its
nearest and visits every earlier cluster that a vector in range of it could be at home with, by a
bound on the angle.  So each pair in range meets once, however the centroids lie; where the bound
excludes nothing, all vectors of the label meet.  Clusters are cut into blocks of bounded size;
every pair of a cluster's blocks is one group of rows, and so is every block with a tile of
visitors, which is searched by brute force.  In a group of two blocks the block's classes are spread over overlapping shards (each in its two nearest), a
neighbour graph is built in each shard and pruned robustly, and the shards' adjacency lists are
united.  Each query descends greedily from the shards' medoids and, where it meets vectors in
range, expands to all their neighbours in range.  A share of each group's queries is held against
brute force; a group whose recall falls short is searched by brute force, which its bounded size
allows.  Links are verified by the cosine in double precision.

A group gives out sums of links by class and one spanning edge for each class at most, never its
pairs.

Vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows
with a null label, nor vectors of different lengths.  A null id takes part.  Equal rows are
distinct vectors.  An empty table gives an empty result.  Columns besides id, vector and label
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written
from .graph import components

DEGREE, BEAM, SLACK, ALPHA = 16, 24, 0.04, 1.2
LEAST_RECALL = 0.98


def nearest_centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means, started from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        for j in range(k):
            if (at == j).any():
                m = x[at == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def two_nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    s = x @ c.T
    return np.argsort(-s, axis=1, kind="stable")[:, :2]


def home_and_visits(x: np.ndarray, c: np.ndarray, least: float) -> list[list[int]]:
    """For each unit vector the nearest centroid, then every earlier one that a vector of cosine ``least`` or more with it could be nearest to.

    Such a vector lies beyond the bisecting plane of the two centroids, so the angle to the plane is
    at most that of ``least``.
    """
    sine = np.sqrt(1 - max(least, 0.0) ** 2)
    squares, out = (c * c).sum(axis=1), []
    for s in range(0, len(x), 1024):
        cos = x[s : s + 1024] @ c.T
        home = cos.argmax(axis=1)
        apart = np.sqrt(np.maximum(0.0, squares[home][:, None] + squares - 2 * (c[home] @ c.T)))
        near = cos.max(axis=1)[:, None] - cos <= sine * apart + 1e-6
        out += [[int(h), *np.flatnonzero(n[:h]).tolist()] for h, n in zip(home, near)]
    return out


def pruned(p: int, near: np.ndarray, dist: np.ndarray, between: np.ndarray) -> list[int]:
    """Robust pruning: keep the nearest candidate, drop those that it is nearer to by ``ALPHA``, and so on."""
    order = np.argsort(dist, kind="stable")
    alive, kept = np.ones(len(near), bool), []
    for i in order:
        if alive[i]:
            kept.append(int(near[i]))
            if len(kept) == DEGREE:
                break
            alive &= ALPHA * between[i] > dist
            alive[i] = False
    return kept


def shard_graph(x: np.ndarray, members: np.ndarray, lists: list[set[int]]) -> int:
    """Adds the pruned neighbours within a shard to the united adjacency lists, both ways; returns the shard's medoid."""
    v = x[members]
    dist = np.sqrt(np.maximum(0.0, 2 - 2 * (v @ v.T)))
    np.fill_diagonal(dist, np.inf)
    width = min(48, len(members) - 1)
    if width > 0:
        near = np.argpartition(dist, width - 1, axis=1)[:, :width]
        for p in range(len(members)):
            n = near[p]
            for q in pruned(p, n, dist[p, n], dist[np.ix_(n, n)]):
                lists[members[p]].add(int(members[q]))
                lists[members[q]].add(int(members[p]))
    mean = v.mean(axis=0)
    return int(members[(v @ mean).argmax()])


class FlatGraph:
    def __init__(self, x: np.ndarray, shard: int = 400):
        self.x = x
        k = max(1, -(-len(x) // shard))
        lists: list[set[int]] = [set() for _ in x]
        if k == 1:
            shards = [np.arange(len(x))]
        else:
            at = two_nearest(x, nearest_centroids(x, k))
            shards = [m for j in range(k) if len(m := np.flatnonzero((at == j).any(axis=1)))]
        self.medoids = np.array(sorted({shard_graph(x, m, lists) for m in shards}))
        self.lists = [np.array(sorted(s), np.int64) for s in lists]

    def in_range(self, q: np.ndarray, start: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Indices and cosines found at ``least`` or more for one query; ``start``: its cosines with the medoids."""
        seen = np.zeros(len(self.x), bool)
        cos = np.full(len(self.x), -2.0)
        first = self.medoids[np.argsort(-start)[:3]]
        seen[first] = True
        cos[first] = self.x[first] @ q
        beam, done = list(first), set()
        while True:  # greedy: expand the best of the beam that isn't expanded yet
            todo = [i for i in beam if i not in done][:2]
            if not todo:
                break
            done.update(todo)
            new = np.concatenate([self.lists[i] for i in todo])
            new = np.unique(new[~seen[new]])
            if len(new):
                seen[new] = True
                cos[new] = self.x[new] @ q
                beam = sorted([*beam, *new.tolist()], key=lambda i: -cos[i])[:BEAM]
            if cos[beam[0]] >= least and cos[todo[0]] < least - 0.2:
                break
        near = np.flatnonzero(cos >= least - SLACK)
        frontier = near[[i not in done for i in near]] if len(near) else near
        while len(frontier):  # range expansion: all neighbours of what lies in range, until nothing new does
            new = np.concatenate([self.lists[i] for i in frontier])
            new = np.unique(new[~seen[new]])
            if not len(new):
                break
            seen[new] = True
            cos[new] = self.x[new] @ q
            frontier = new[cos[new] >= least - SLACK]
        hit = np.flatnonzero(cos >= least)
        return hit, cos[hit]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    up = np.arange(n)
    while True:
        m = np.minimum(up[a], up[b])
        before = up.copy()
        np.minimum.at(up, a, m)
        np.minimum.at(up, b, m)
        up = up[up]
        if (up == before).all():
            return up


def _joined(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``up``, each row's root, after joining the roots of ``a`` and ``b``."""
    while len(a):
        p, q = up[a], up[b]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up[up] != up).any():
            up = up[up]
        open_ = up[a] != up[b]
        a, b = a[open_], b[open_]
    return up


def visited(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """As ``search_group``, between a block and a tile of visitors: all pairs, in slices of bounded size."""
    x, mult = np.stack(pdf["x"].to_numpy()).astype(np.float64), pdf["m"].to_numpy()
    guest = pdf["visits"].to_numpy()
    index, queries = np.flatnonzero(~guest), np.flatnonzero(guest)
    links, up = np.zeros(len(x), np.int64), np.arange(len(x))
    of = x[index]
    for s in range(0, len(queries), 256):
        some = queries[s : s + 256]
        a, b = np.nonzero(x[some] @ of.T >= least)
        a, b = some[a], index[b]
        np.add.at(links, a, mult[b])
        np.add.at(links, b, mult[a])
        up = _joined(up, a, b)
    c, met = pdf["c"].to_numpy(), np.flatnonzero(links > 0)
    return pd.DataFrame({"c": c[met], "links": links[met], "root": c[up[met]]})


def search_group(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between the two blocks of a group (or within its one): per class the links' multiplicity and a spanning edge."""
    x = np.stack(pdf["x"].to_numpy()).astype(np.float64)
    own, other = pdf["block"].to_numpy() == pdf["i"].to_numpy(), pdf["block"].to_numpy() == pdf["j"].to_numpy()
    index, queries = np.flatnonzero(own), np.flatnonzero(other)
    found_a, found_b = [], []
    if len(index) and len(queries):
        graph = FlatGraph(x[index])
        starts = x[queries] @ graph.x[graph.medoids].T
        audited = found = 0
        for k, q in enumerate(queries):
            hit, _ = graph.in_range(x[q], starts[k], least)
            if k % 50 == 0:
                audited += int((graph.x @ x[q] >= least).sum())
                found += len(hit)
            found_a.append(np.full(len(hit), q))
            found_b.append(index[hit])
        if found < LEAST_RECALL * audited:
            found_a, found_b = [], []
            for s in range(0, len(queries), 512):
                a, b = np.nonzero(x[queries[s : s + 512]] @ graph.x.T >= least)
                found_a.append(queries[s + a])
                found_b.append(index[b])
    a, b = (np.concatenate(f) if f else np.empty(0, np.int64) for f in (found_a, found_b))
    keep = a != b
    lo, hi = np.minimum(a, b)[keep], np.maximum(a, b)[keep]  # a link may be found from one side only
    pair = np.unique(lo * len(x) + hi)
    a, b = pair // len(x), pair % len(x)
    mult = pdf["m"].to_numpy()
    links = np.bincount(a, mult[b], len(x)) + np.bincount(b, mult[a], len(x))
    roots = _roots(len(x), a, b)
    c = pdf["c"].to_numpy()
    some = np.flatnonzero(links > 0)
    return pd.DataFrame({"c": c[some], "links": links[some].astype(np.int64), "root": c[roots[some]]})


def link_vectors(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = 4096, sample_rows: int = 20_000, most_centroids: int = 4096
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row."""
    spark = vectors.sparkSession
    v = F.col(vector_col)
    finite = F.coalesce(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.cast("array<double>").alias("v")).withColumn("ok", finite & F.col("label").isNotNull() & F.coalesce(F.exists("v", lambda e: e != 0), F.lit(False)))
    rows = rows.withColumn("c", F.when(F.col("ok"), F.xxhash64("label", "v")))
    rows = written(rows, "vectors")
    classes = rows.filter("ok").groupBy("c").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("m"))
    scale = F.array_max(F.transform("v", F.abs))
    unit = F.transform("v", lambda e: e / F.col("scale"))
    classes = classes.withColumn("scale", scale).withColumn("v", unit)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    classes = classes.withColumn("norm", norm).select("c", "label", "m", F.transform("v", lambda e: e / F.col("norm")).alias("x"), F.size("v").alias("dim"))
    classes = written(classes, "unit")

    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * block_rows)
    large = sizes.orderBy(F.desc("n"), "label", "dim").limit(most_centroids // 2).collect()  # the largest labels; any others are dealt to blocks at once
    total = sum(r["n"] for r in large)
    centroids: dict[tuple, np.ndarray] = {}
    if large:
        share = min(1.0, sample_rows / total)
        keys = spark.createDataFrame([(r["label"], r["dim"]) for r in large], classes.select("label", "dim").schema)
        sample = classes.join(F.broadcast(keys), ["label", "dim"]).filter(F.pmod(F.xxhash64("c"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("c").limit(2 * sample_rows).select("label", "dim", "x").toPandas()
        for (label, dim), g in sample.groupby(["label", "dim"]):
            n = next(r["n"] for r in large if (r["label"], r["dim"]) == (label, dim))
            k = int(min(-(-n // block_rows), max(2, most_centroids * n // total), len(g)))
            centroids[label, dim] = nearest_centroids(np.stack(g["x"].to_numpy()), k)
    shared = spark.sparkContext.broadcast(centroids)  # at most most_centroids vectors
    label_kind = classes.schema["label"].dataType.simpleString()

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = [[0]] * len(pdf)
            for key, rows_at in pdf.groupby(["label", "dim"]).indices.items():
                if key in shared.value and len(shared.value[key]) > 1:
                    for r, some in zip(rows_at, home_and_visits(np.stack(pdf["x"].to_numpy()[rows_at]), shared.value[key], least)):
                        at[r] = some
            pdf["clusters"] = at
            yield pdf

    dealt = classes.mapInPandas(assigned, f"c long, label {label_kind}, m long, x array<double>, dim int, clusters array<int>")
    dealt = written(dealt, "dealt")
    at = dealt.select("c", "label", "m", "x", "dim", F.posexplode("clusters").alias("nth", "cluster")).withColumn("visits", F.col("nth") > 0).drop("nth")
    by = ["label", "dim", "cluster"]
    count = lambda kind, size: F.ceil(F.count_if(kind) / size).cast("int")
    blocks = at.groupBy(*by).agg(count(~F.col("visits"), block_rows).alias("blocks"), count(F.col("visits"), 4 * block_rows).alias("tiles"))
    met = at.join(blocks, by).filter("blocks > 0")
    met = met.withColumn("block", F.pmod(F.xxhash64("c", F.lit(7)), F.when(F.col("visits"), F.col("tiles")).otherwise(F.col("blocks"))).cast("int") + F.when(F.col("visits"), F.col("blocks")).otherwise(0))
    others = F.sequence(F.lit(0), F.col("blocks") - 1 + F.when(F.col("visits"), 0).otherwise(F.col("tiles")))  # tiles are numbered after the blocks; two tiles don't meet
    met = met.withColumn("to", F.explode(others)).withColumn("i", F.least("block", "to")).withColumn("j", F.greatest("block", "to"))
    got = met.groupBy(*by, "i", "j").applyInPandas(lambda pdf: (visited if pdf["visits"].any() else search_group)(pdf, least), "c long, links long, root long")
    got = written(got, "links")

    parts = components(got.select(F.col("c").alias("u"), F.col("root").alias("v")))
    links = got.groupBy("c").agg(F.sum("links").alias("links"))
    of = classes.select("c", "m").join(links, "c", "left").join(parts.withColumnRenamed("v", "c"), "c", "left")
    of = of.select("c", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "c").alias("component"))
    out = written(rows.select("id", "c").join(of, "c", "left"), "found")
    first = out.filter("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    out = out.join(first, "component", "left").withColumn("component_id", F.coalesce("least", "id"))
    for t in (rows, dealt):
        drop_written(t)
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def recall(vectors: DataFrame, found: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50) -> DataFrame:
    """``(n_queries, true_links, found_links)``: the links of every row whose id is divisible by ``every``, by brute force against all rows in blocks, and as found."""
    v = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, e: s + e * e))
    asked = v.filter(F.col("id") % every == 0).select(F.col("id").alias("q"), "label", F.col("v").alias("w"))
    true = asked.join(v, "label").filter((F.col("q") != F.col("id")) & (dot >= least * norm("v") * norm("w"))).groupBy("q").agg(F.count(F.lit(1)).alias("true"))
    met = asked.select("q").join(true, "q", "left").join(found.select(F.col(id_col).alias("q"), "n_links"), "q")
    return met.agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("true"), F.lit(0)).alias("true_links"), F.sum("n_links").alias("found_links"))
