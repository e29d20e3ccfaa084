"""Toxicity by a counterfactual-regularised linear classifier.

A text's features are its words and their beginnings (the first four, five and six bytes), present
or absent.  Features are chosen by their association with the label, then a logistic model is
fitted.  Identity terms in labelled sentences are swapped for others of their kind, and the squared
change of the score is part of the loss: a group's mention alone can't move a score.

The model is fitted on a bounded sample of labelled rows (``sample_rows``); every whole text is
scored.  Labels, language, source and id are no inputs of a score.

Nulls: a null text is empty and scored by the bias alone; a null id stays null and isn't held out;
rows with a null label are not learnt from.  Equal rows get equal scores.  Without documents the
result is empty; without labelled rows of both kinds every score is the share of toxic rows, or 0.
Columns besides the id, the text and the labels' id and ``toxic`` are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, id_and_bytes, remainder, written

#: Identity terms by kind; a swap stays within a kind.
IDENTITY_TERMS = {
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"],
    "religion_plural": ["muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"],
    "origin": ["african", "american", "arab", "asian", "european", "indian", "mexican", "chinese", "polish", "turkish"],
    "colour": ["black", "white", "brown", "latino", "hispanic"],
    "gender": ["woman", "man", "girl", "boy", "female", "male", "transgender"],
    "gender_plural": ["women", "men", "girls", "boys", "females", "males"],
    "orientation": ["gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"],
    "ability": ["disabled", "blind", "deaf", "autistic"],
    "status": ["immigrant", "refugee", "foreigner", "native", "citizen"],
}
SWAPS = {t.encode(): [o.encode() for o in terms if o != t] for terms in IDENTITY_TERMS.values() for t in terms}
#: Characters stripped from both ends of a word.
MARKS = b".,;:!?\"'()[]{}<>|#$%&*+-=_/\\`~^@"
ENDS = b".!?\n"


class WordFeatures(dict):
    """The features of a word: hashes of the word and of its beginnings."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 400_000:
            self.clear()
        w = word.strip(MARKS)
        made = tuple({xxhash.xxh3_64_intdigest(w[:n]) >> 1 if n < 99 else xxhash.xxh3_64_intdigest(w + b" ") >> 1 for n in (4, 5, 6, 99) if len(w) >= min(n, 3)}) if w else ()
        self[word] = made
        return made


def present(body: bytes, known: WordFeatures) -> set[int]:
    found: set[int] = set()
    for f in map(known.__getitem__, set(body.lower().split())):
        found.update(f)
    return found


def counterfactuals(body: bytes) -> list[tuple[bytes, bytes]]:
    """Sentences that name an identity, each with its copy in which the next term of the kind stands."""
    low, out = body.lower(), []
    if not any(t in low for t in SWAPS):
        return out
    sentence: list[bytes] = []
    for w in [*low.split(), b"."]:
        sentence.append(w)
        if w[-1] in ENDS:
            bare = [x.strip(MARKS) for x in sentence]
            if any(x in SWAPS for x in bare):
                out.append((b" ".join(bare), b" ".join(SWAPS[x][len(sentence) % len(SWAPS[x])] if x in SWAPS else x for x in bare)))
            sentence = []
    return out


class ToxicityModel:
    """Weights by feature hash and a bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias


def _logistic(rows: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], n: int, l2: float, fairness: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the mean log loss + l2 |w|^2 / 2 + fairness * mean (change of score)^2 / 2."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    size = np.maximum(1.0, np.bincount(at, minlength=len(rows)))
    p_at = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]) if pairs else np.empty(0, np.int64)
    p_col = np.array([c for a, b in pairs for c in (*a, *b)], np.int64)
    p_sign = np.array([s for a, b in pairs for s in (*(1.0 for _ in a), *(-1.0 for _ in b))])
    p = y.mean()
    w, b = np.zeros(n), math.log(p / (1 - p))
    vw, vb, rate = w.copy(), b, 1.0 / (0.25 * (float(np.max(size)) + 1) + l2 + fairness * max((len(x) + len(y) for x, y in pairs), default=0))
    for k in range(steps):
        z = np.bincount(at, vw[col], len(rows)) + vb
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(col, g[at], n) / len(y) + l2 * vw
        if pairs:
            d = np.bincount(p_at, p_sign * vw[p_col], len(pairs))
            gw += fairness * np.bincount(p_col, p_sign * d[p_at], n) / len(pairs)
        w1, b1 = vw - rate * gw, vb - rate * g.mean()
        m = k / (k + 3)
        vw, vb, w, b = w1 + m * (w1 - w), b1 + m * (b1 - b), w1, b1
    return w, b


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: tuple[int, int] = (5, 0),
    sample_rows: int = 24_000, n_features: int = 4096, least_rows: int = 4, l2: float = 1e-5, fairness: float = 1.0, steps: int = 400,
) -> ToxicityModel:
    """Fits on at most ``sample_rows`` labelled rows, the least by a hash of their id."""
    mod, left = held_out
    chosen = labels.filter(F.col(label_col).isNotNull() & (remainder(id_col, mod) != left)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id", F.lit(11)), "y").limit(sample_rows)
    texts = id_and_bytes(docs, id_col, text_col).withColumnRenamed(id_col, "id")
    sample = written(texts.join(F.broadcast(chosen), "id").select("y", "body"), "labelled")  # bounded: sample_rows rows of 12 bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows, toxic = WordFeatures(), Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(rows)
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, [rows[k] for k in keys], [toxic[k] for k in keys])], ["f", "n", "t"])
            rows.clear(), toxic.clear()
            return made

        for b in batches:
            for y, body in zip(b.column(0), b.column(1)):
                f = present(body.as_py(), known)
                rows.update(f)
                if y.as_py():
                    toxic.update(f)
                if len(rows) > 500_000:
                    yield out()
        yield out()

    n, t = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < t < n:
        drop_written(sample)
        return ToxicityModel({}, 30.0 if t else -30.0)
    counted = sample.mapInArrow(count, "f long, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).filter(F.col("n") >= least_rows)

    def part(seen, share):  # a term of the log-likelihood ratio
        return F.when(seen > 0, seen * F.log(seen / (F.col("n") * share))).otherwise(0.0)

    gain = part(F.col("t").cast("double"), F.lit(t / n)) + part((F.col("n") - F.col("t")).cast("double"), F.lit(1 - t / n))
    best = [r["f"] for r in counted.select("f", gain.alias("gain")).filter(F.col("gain") > 6).orderBy(F.desc("gain"), "f").limit(n_features).collect()]
    place = {f: i for i, f in enumerate(best)}

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()

        def of(body: bytes) -> list[int]:
            return sorted(place[f] for f in present(body, known) if f in place)

        for b in batches:
            ys, xs, ps = [], [], []
            for y, body in zip(b.column(0), b.column(1)):
                body = body.as_py()
                ys.append(y.as_py())
                xs.append(of(body))
                ps.append([[of(a), of(c)] for a, c in counterfactuals(body)])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(xs, pa.list_(pa.int32())), pa.array(ps, pa.list_(pa.list_(pa.list_(pa.int32()))))], ["y", "x", "p"])

    rows = sample.mapInArrow(reduced, "y int, x array<int>, p array<array<array<int>>>").collect()  # at most sample_rows short rows
    pairs = [(p[0], p[1]) for r in rows for p in r["p"] if p[0] != p[1]]
    w, b = _logistic([r["x"] for r in rows], np.array([float(r["y"] > 0) for r in rows]), pairs, len(best), l2, fairness, steps)
    drop_written(sample)
    return ToxicityModel({f: float(x) for f, x in zip(best, w) if x}, float(b))


class Scorer:
    """Logits of texts; words without weighted features, almost all of them, cost one look-up."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.made, self.words = WordFeatures(), {}

    def features(self, word: bytes) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= 400_000:
                self.words.clear()
            found = self.words[word] = tuple(f for f in self.made.__missing__(word) if f in self.weights)
            self.made.clear()
        return found

    def logit(self, body: bytes) -> float:
        found: set[int] = set()
        for f in filter(None, map(self.features, set(body.lower().split()))):
            found.update(f)
        return self.bias + sum(self.weights[f] for f in sorted(found))

    def probability(self, body: bytes) -> float:
        return 1 / (1 + math.exp(-min(max(self.logit(body), -700.0), 700.0)))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.probability(x.as_py()) for x in b.column(1)], pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return id_and_bytes(docs, id_col, text_col).withColumnRenamed(id_col, "id").mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (5, 0), **options) -> DataFrame:
    """``(id, held_out, score, predicted)``: fit, then score every row."""
    model = fit(docs, labels, id_col, text_col, held_out=held_out, **options)
    out = F.coalesce(remainder(id_col, held_out[0]) == held_out[1], F.lit(False))
    return score(docs, model, id_col, text_col).select(id_col, out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under ``threshold``."""
    model = fit(docs, labels, id_col, text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value)
        for bodies in batches:
            yield pd.Series([scorer.probability(x) for x in bodies])

    return docs.filter(scored(F.coalesce(F.col(text_col), F.lit("")).cast("binary")) < threshold)
