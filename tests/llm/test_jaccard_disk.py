"""What the Jaccard join keeps off the disk: whole sets of pairs that can't link, and prefixes of all shingles at once."""

import random

import numpy as np

from . import brute


def similar_texts(rng):
    """20 pairs of texts that share much and don't link, and 5 pairs that do."""
    rows = []
    for k in range(25):
        base = [f"w{k}_{i}" for i in range(200)]
        other = list(base)
        at = rng.randrange(20, 100)
        size = 50 if k < 20 else 8
        other[at : at + size] = [f"v{k}_{i}" for i in range(size)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    return rows


def watched(monkeypatch):
    from tidemark.llm import jaccard_join

    seen, write = [], jaccard_join.written

    def written(df, name):
        out = write(df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "written", written)
    return jaccard_join, seen


def test_whole_sets_only_of_pairs_that_may_link(spark, monkeypatch):
    join, seen = watched(monkeypatch)
    rows = similar_texts(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join.near_duplicates(docs).collect()}
    assert got == brute.jaccard_components(rows)
    assert [n for name, n in seen if name == "sets"] == [10]


def test_prefixes_are_dealt_to_turns(spark, monkeypatch):
    join, seen = watched(monkeypatch)
    rows = similar_texts(random.Random(5))
    join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    lists = [n for name, n in seen if name == "lists"]
    assert sum(lists) > 500 and max(lists) < 0.7 * sum(lists)


def test_parities_never_part_sets_that_link():
    from tidemark.llm.jaccard_join import may_link, parities

    rng, parted = np.random.default_rng(9), 0
    for _ in range(3000):
        common, more, less = (int(rng.integers(0, k)) for k in (rng.integers(2, 400), 130, 130))
        x = rng.integers(0, 2**64, common + more + less + 1, dtype=np.uint64)
        a, b = np.sort(x[: common + more + 1]), np.sort(np.concatenate((x[:common], x[common + more + 1 :])))
        if not len(b):
            continue
        (na, pa), (nb, pb) = ((int(np.frombuffer(s[:8], np.int64)[0]), np.unpackbits(np.frombuffer(s[8:], np.uint8))) for s in (parities(a), parities(b)))
        assert (na, nb) == (len(a), len(b))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (na + nb - both):
            assert may_link(na, pa, nb, pb, 75)
        else:
            parted += not may_link(na, pa, nb, pb, 75)
    assert parted > 1000
