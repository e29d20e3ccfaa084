"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

``P(word | history) = P(class | history) * P(word | class)``.  A word's class comes from its
ending; class 0 is the end of a text.  ``P(class | history)`` is a softmax over hashed n-gram and
skip features of the preceding words; ``P(word | class)`` is the softmax of one weight per word,
whose fitted value is the smoothed count.  Both factors sum to one.

A feature's weight for a class is a scale times ``log(1 + c / (SMOOTH p))``, where ``c`` is how often
the class followed the feature in training and ``p`` the class's share.  The scales, one for each
template and frequency band, are trained by gradient updates over all training tokens.

Four passes over the texts, each in bounded numpy batches:

1. word counts of all training tokens, counted per batch before the shuffle;
2. counts of (feature, class), summed over the tasks as integers in a tree of bounded groups;
3. a gradient update: every task sums gradient and curvature of the scales at the same point, with
   each token left out of its own features' counts, and the driver takes one step (more with
   ``rounds``);
4. scores.  The most frequent words (a bounded number, chosen by a count threshold) travel with
   the tasks; all other words of a text go through a join with the rest of the counts, so every
   count used is the exact one.

All of it are sums over tokens, so the number and size of the tasks decide nothing.

Features of the preceding word grow with the corpus: every word that occurs often enough in
training (``own_least``) has a weight row of its own, up to ``own_words`` rows, the most frequent
first; rarer words share hashed rows.

Words are known by 64-bit hashes.  Nulls: a null text is empty (one end token); a null id stays
null and isn't held out.  Equal rows are scored once each and all count in training.  An empty
table gives an empty result.  Columns besides the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_bytes, n_partitions, remainder, tree_summed, word_runs, written

CLASSES = 32
#: Shared rows of the weight table by template: previous word without a row of its own; three preceding classes; the word before the previous; classes two to four back.
ROWS = (1 << 13, 1 << 14, 1 << 12, 1 << 12)
STARTS = tuple(int(x) for x in np.cumsum((0, *ROWS[:-1])))
BLOCK = 256
#: Added to a class's count in a feature, in units of the class's share.
SMOOTH = 8.0
#: Frequency bands of a feature by powers of two; the last one is open.
BANDS = 16
#: The scales before training, and the weight of that prior in units of curvature.
START_SCALE, PRIOR = 0.4, 10.0
END = np.uint64(0x2545F4914F6CDD1D & ~(CLASSES - 1))  # the end token's hash, of class 0
#: Characters that don't belong to a word's ending.
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b".,;:!?\"'()[]|#$%&*")] = True


def chunks(bodies) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(documents, token hashes, first token of each document)`` for runs of whole documents.

    The lowest five bits of a hash are the word's class, from 1 on, by its last two bytes without
    marks; each document ends with the end token.
    """
    for held, w in word_runs(x.as_py() for x in bodies):
        last = w.end
        for _ in range(3):
            last = last - (_IS_MARK[w.data[last - 1]] & (last - 1 > w.first))
        ending = w.data[last - 1].astype(np.uint64) * np.uint64(257) + np.where(last - 1 > w.first, w.data[last - 2], 0).astype(np.uint64)
        k = np.uint64(1) + (ending * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(CLASSES - 1)
        starts = np.concatenate(([0], np.cumsum(w.count + 1)[:-1])).astype(np.int64)
        h = np.full(len(w.hashes) + len(held), END, np.uint64)
        h[np.arange(len(w.hashes)) + np.repeat(np.arange(len(held)), w.count)] = w.hashes & ~np.uint64(CLASSES - 1) | k
        yield len(held), h, starts


class OwnRows:
    """Words with a weight row of their own: sorted hashes, and the rows in order of frequency behind the shared ones."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, least: int, most: int):
        often = np.flatnonzero(counts >= least)
        often = often[np.lexsort((hashes[often], -counts[often]))[:most]]
        order = np.argsort(hashes[often])
        self.hashes, self.rows = hashes[often][order], (sum(ROWS) + order).astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def of(self, h: np.ndarray) -> np.ndarray:
        """The row of each token's word, -1 for none."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.rows[at], np.int32(-1))


def features(h: np.ndarray, starts: np.ndarray, own: OwnRows) -> list[np.ndarray]:
    """Weight rows active at each token, one array per template, counted from the template's first."""
    k = (h & np.uint64(CLASSES - 1)).astype(np.uint32)
    nth = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))

    def back(x: np.ndarray, n: int) -> np.ndarray:
        y = np.roll(x, n)
        y[nth < n] = 0
        return y

    k1, k2, k3, k4 = (back(k, n) for n in range(1, 5))
    out = []
    for x, bits in ((back(h, 1), 13), ((k1 * 32 + k2) * 32 + k3, 14), (back(h, 2) ^ np.uint64(1), 12), (((k2 * 32 + k3) * 32 + k4) ^ np.uint32(1 << 20), 12)):
        out.append((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.uint16))
    if len(own):
        row = back(own.of(h) + 1, 1)  # 0 for none
        out[0] = np.where(row > 0, row - 1, out[0].astype(np.int32))
    return out


def class_logits(weights: np.ndarray, bias: np.ndarray, f: list[np.ndarray]) -> np.ndarray:
    z = weights.take(f[0], axis=0)
    for t in range(1, len(f)):
        z += weights[STARTS[t] :].take(f[t], axis=0)
    z += bias
    z -= z.max(axis=1, keepdims=True)
    return z


def band(n: np.ndarray) -> np.ndarray:
    """The frequency band of features that occur ``n`` times."""
    return np.minimum(np.log2(n + 1.0).astype(np.int64), BANDS - 1)


class MaxEnt:
    """Class sizes, features' class counts as logs, and the scales: 4 MB, and 136 bytes for each row of ``own``."""

    def __init__(self, tokens: np.ndarray, words: np.ndarray, own: OwnRows):
        self.tokens, self.words = tokens, words  # by class
        self.n_tokens, self.n_words = int(tokens.sum()), int(words.sum())
        self.share = (tokens + 1.0) / (tokens.sum() + CLASSES)
        self.bias = np.log(self.share).astype(np.float32)
        self.own = own
        self.size = -(-(sum(ROWS) + len(own)) // BLOCK) * BLOCK
        self.logs = np.zeros((self.size, CLASSES), np.float32)
        self.seen = np.zeros(self.size, np.int64)
        self.scales = np.full((len(ROWS), BANDS), START_SCALE)

    def count(self, rows: slice, counts: np.ndarray) -> None:
        """Takes the class counts of some rows."""
        self.logs[rows] = np.log1p(counts / (SMOOTH * self.share))
        self.seen[rows] = counts.sum(axis=1)

    def weights(self) -> np.ndarray:
        template = np.zeros(self.size, np.int64)  # words of their own belong to the first
        for t in range(1, len(ROWS)):
            template[STARTS[t] : STARTS[t] + ROWS[t]] = t
        return self.logs * self.scales[template, band(self.seen)].astype(np.float32)[:, None]

    def slopes(self, f: list[np.ndarray], k: np.ndarray) -> np.ndarray:
        """Gradient and curvature of the tokens' log-likelihood by the scales, as one array.

        A token is left out of the counts that predict it: what is known of its own class is one less.
        """
        at = np.arange(len(k))
        logs, bands = [], []
        z = np.tile(self.bias, (len(k), 1))
        for t, rows in enumerate(f):
            rows = rows.astype(np.int64) + STARTS[t]
            x, unit = self.logs.take(rows, axis=0), SMOOTH * self.share[k]
            x[at, k] = np.log1p(np.maximum(np.expm1(x[at, k].astype(float)) * unit - 1, 0) / unit)
            b = band(np.maximum(self.seen[rows] - 1, 0))
            z += x * self.scales[t, b].astype(np.float32)[:, None]
            logs.append(x)
            bands.append(t * BANDS + b)
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        size = self.scales.size
        expected = [z * x for x in logs]
        mean = [x.sum(axis=1, dtype=np.float64) for x in expected]
        slope, curve = np.zeros(size), np.zeros(size * size)
        for t in range(len(f)):
            slope += np.bincount(bands[t], logs[t][at, k] - mean[t], minlength=size)
            for q in range(t, len(f)):
                both = np.bincount(bands[t] * size + bands[q], np.einsum("ij,ij->i", expected[t], logs[q]) - mean[t] * mean[q], minlength=size * size)
                curve += both
                if q > t:
                    curve += both.reshape(size, size).T.ravel()
        return np.concatenate((slope, curve))

    def step(self, sums: np.ndarray) -> None:
        """One update of the scales from all tokens' slopes: a step of Newton's method with a prior around the start."""
        size = self.scales.size
        slope, curve = sums[:size] - PRIOR * (self.scales.ravel() - START_SCALE), sums[size:].reshape(size, size) + PRIOR * np.eye(size)
        self.scales = np.clip(self.scales + np.linalg.solve(curve, slope).reshape(self.scales.shape), 0, 2)


def training_rows(docs: DataFrame, id_col: str, held_out: tuple[int, int]) -> DataFrame:
    mod, left = held_out
    return docs.filter(F.coalesce(remainder(id_col, mod) != left, F.lit(True)))


def word_counts(texts: DataFrame) -> DataFrame:
    """``(h, c)``: occurrences of each token, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            h, c = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(h, kind="stable")
            u, first = np.unique(h[order], return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.add.reduceat(c[order], first))], ["h", "c"])

        for b in batches:
            for _, h, _ in chunks(b.column(1)):
                held.append(np.unique(h, return_counts=True))
                if len(held) == 40:
                    yield merged()
        if held:
            yield merged()

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def class_counts(texts: DataFrame, model: MaxEnt) -> None:
    """Counts the classes that follow each feature over all texts, into ``model``."""
    shared = texts.sparkSession.sparkContext.broadcast((model.own, model.size))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = shared.value
        counts = np.zeros(size * CLASSES, np.int64)
        for b in batches:
            for _, h, starts in chunks(b.column(1)):
                k = (h & np.uint64(CLASSES - 1)).astype(np.int64)
                for t, rows in enumerate(features(h, starts, own)):
                    cells, n = np.unique((rows.astype(np.int64) + STARTS[t]) * CLASSES + k, return_counts=True)
                    counts[cells] += n
        counts = counts.reshape(-1, BLOCK * CLASSES)
        for block in np.flatnonzero(counts.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts[block].tobytes()], pa.binary())], ["block", "body"])

    made = tree_summed(texts.mapInArrow(run, "block int, body binary"), n_partitions(texts), np.int64)
    sums: dict[int, np.ndarray] = {}
    for r in made.toLocalIterator():  # the feature table, a block at a time
        x = np.frombuffer(bytes(r["body"]), np.int64)
        sums[r["block"]] = sums.get(r["block"], 0) + x
    for block, x in sums.items():
        model.count(slice(block * BLOCK, (block + 1) * BLOCK), x.reshape(BLOCK, CLASSES))
    shared.unpersist()


def gradient_round(texts: DataFrame, model: MaxEnt, batch: int) -> None:
    """One update of the scales from the slopes of all tokens."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = shared.value, None
        for b in batches:
            for _, h, starts in chunks(b.column(1)):
                f, k = features(h, starts, model.own), (h & np.uint64(CLASSES - 1)).astype(np.int64)
                for s in range(0, len(h), batch):
                    x = model.slopes([x[s : s + batch] for x in f], k[s : s + batch])
                    sums = x if sums is None else sums + x
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["block", "body"])

    made = tree_summed(texts.mapInArrow(run, "block int, body binary"), n_partitions(texts), np.float64).collect()  # one array
    model.step(sum(np.frombuffer(bytes(r["body"])) for r in made))
    shared.unpersist()


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (7, 2), rounds: int = 1, batch: int = 8192, head_words: int = 1 << 19,
    own_words: int = 1 << 19, own_least: int = 32,
) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every document.

    ``held_out = (m, r)``: rows with crc32(id as text) mod m = r are not learnt from.
    ``head_words`` bounds the words that travel with the tasks (16 bytes each), ``own_words`` those
    of them with a weight row of their own (128 bytes each), which occur ``own_least`` times or more.
    ``rounds``: gradient updates of the scales, each a pass over the training texts.
    """
    spark = docs.sparkSession
    texts = id_and_bytes(docs, id_col, text_col)
    train = training_rows(texts, id_col, held_out)
    counts = written(word_counts(train), "counts")
    klass = F.col("h").bitwiseAND(F.lit(CLASSES - 1))
    sizes = counts.groupBy(klass.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # a row per class
    by_count = counts.groupBy(F.least(F.floor(F.log2("c") * 16), F.lit(1023)).alias("b")).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("v")).orderBy(F.desc("b")).collect()  # bins of counts
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sizes:
        tokens[r["k"]], words[r["k"]] = r["n"], r["v"]
    least, held = 1 << 62, 0
    for r in by_count:
        held += r["v"]
        if held > head_words:
            break
        least = r["c"]
    head = counts.filter(F.col("c") >= least).toArrow()  # at most head_words rows
    hh, hc = (head.column(c).to_numpy() for c in ("h", "c"))
    hh = hh.view(np.uint64)
    order = np.argsort(hh)
    hh, hc = hh[order], hc[order]
    model = MaxEnt(tokens, words, OwnRows(hh, hc, own_least, own_words))
    if model.n_tokens:
        class_counts(train, model)
        for _ in range(rounds):
            gradient_round(train, model, batch)

    n, v = model.n_tokens, model.n_words
    in_class = np.log10(tokens + words + 1)
    base_all = math.log10(n + v + 1)
    shared = spark.sparkContext.broadcast((hh, hc, model.weights(), model.bias, model.own, in_class))  # of bounded size
    ln10 = math.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hh, hc, weights, bias, own, in_class = shared.value
        for b in batches:
            row = 0
            for docs_in, h, starts in chunks(b.column(1)):
                f, k = features(h, starts, own), (h & np.uint64(CLASSES - 1)).astype(np.int64)
                logp = np.empty(len(h))
                for s in range(0, len(h), 8192):
                    z = class_logits(weights, bias, [x[s : s + 8192] for x in f])
                    logp[s : s + 8192] = (z[np.arange(len(z)), k[s : s + 8192]] - np.log(np.exp(z).sum(axis=1))) / ln10
                u, inv = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(hh, u), max(len(hh) - 1, 0))
                found = hh[at] == u if len(hh) else np.zeros(len(u), bool)
                c = (np.where(found, hc[at], 0) if len(hh) else np.zeros(len(u)))[inv]
                known = found[inv]
                logc = np.where(known, np.log10(c + 1.0), 0.0)  # the others' come by the join
                ends = np.append(starts[1:], len(h))
                sums = [np.add.reduceat(x, starts) for x in (logc, logp - in_class[k], known.astype(np.int64))]
                doc = np.repeat(np.arange(docs_in), ends - starts)[~known]
                pairs, times = np.unique(doc * len(u) + inv[~known], return_counts=True)
                offsets = pa.array(np.searchsorted(pairs, np.arange(docs_in + 1) * len(u)), pa.int32())
                rare = pa.ListArray.from_arrays(offsets, pa.array(u[pairs % len(u)].view(np.int64)))
                often = pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, docs_in), pa.array(ends - starts, pa.int64()), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), rare, often], ["id", "n_tokens", "known", "logc", "logp", "rare", "often"])
                row += docs_in

    kind = docs.schema[id_col].dataType.simpleString()
    part = texts.mapInArrow(run, f"id {kind}, n_tokens long, known long, logc double, logp double, rare array<long>, often array<long>")
    part = written(part.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = part.select("row", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.often").alias("n"))
    rest = counts.filter(F.col("c") < least)
    more = rare.join(rest, "h").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logc_more"), F.sum("n").alias("known_more"))
    out = part.drop("rare", "often").join(more, "row", "left").na.fill(0, ["logc_more", "known_more"])
    logc = F.col("logc") + F.col("logc_more")
    return out.select(
        F.col("id").alias(id_col), F.coalesce(remainder("id", held_out[0]) == held_out[1], F.lit(False)).alias("held_out"), "n_tokens", (F.col("known") + F.col("known_more")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (logc - F.col("n_tokens") * base_all).alias("base_score"), (logc + F.col("logp")).alias("score"),
    )
