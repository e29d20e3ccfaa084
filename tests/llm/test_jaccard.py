"""The Jaccard join where it is hard: groups of near copies, shared passages, streams cut anywhere, awkward rows."""

import random

import pytest

from . import brute


def near_copies(rng, n, size, most, start, base_too):
    """Copies of one text of ``size`` words with up to ``most`` words replaced, deleted or inserted."""
    base = [f"b{start}_{i}" for i in range(size)]
    rows = [(start, " ".join(base))] if base_too else []
    for i in range(start + len(rows), start + n):
        w = list(base)
        for _ in range(rng.randint(0 if base_too else 1, most)):
            at = rng.randrange(len(w))
            kind = rng.random()
            if kind < 0.7:
                w[at] = f"x{rng.randrange(10**7)}"
            elif kind < 0.85:
                del w[at]
            else:
                w.insert(at, f"y{rng.randrange(10**7)}")
        rows.append((i, " ".join(w)))
    return rows


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("base_too", [True, False])
def test_large_group_of_near_copies(spark, base_too):
    """1,200 near copies, of which some link with few others or none, with the text they come from and without it."""
    from tidemark.llm.jaccard_join import near_duplicates

    rows = near_copies(random.Random(7), 1200, 90, 5, 0, base_too)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute.jaccard_components(rows)
    assert 1 < len({c for _, c in want.values()})
    assert result(near_duplicates(docs)) == want


def test_streams_cut_anywhere(spark, monkeypatch):
    """Batches of a few rows, a short look ahead and few direct partners give the same components."""
    from tidemark.llm import jaccard_join

    rng = random.Random(11)
    rows = near_copies(rng, 120, 40, 3, 0, True) + near_copies(rng, 60, 25, 2, 1000, False)
    passage = [f"p{i}" for i in range(30)]
    rows += [(i, " ".join(passage + [f"o{i}_{k}" for k in range(rng.randrange(1, 25))])) for i in range(2000, 2150)]
    rows += [(i, t) for i, (_, t) in zip(range(3000, 3060), rng.sample(rows, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.jaccard_components(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for short, ahead in ((2, 4),):
            source = {"SHORT": short, "AHEAD": ahead, "MEETING": 10}
            for k, v in source.items():
                monkeypatch.setattr(jaccard_join, k, v)
            assert result(jaccard_join.near_duplicates(docs)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_one_of_each_of_awkward_rows(spark):
    """Equal ids keep their unlinked texts; null ids, repeats, rows without words and clashing columns have a defined result."""
    from tidemark.llm.jaccard_join import one_of_each

    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "x1 x2 x3 x4 x5 x6")
    rows = [(5, a), (5, b), (7, a), (None, b), (None, c), (None, c), (9, None), (9, ""), (9, None), (3, "few"), (2, "few")]
    more = ("key", "class", "component", "whole", "times", "n_shingles", "t")
    docs = spark.createDataFrame([(*r, *more) for r in rows], "doc_id long, text string, " + ", ".join(f"{x} string" for x in more))
    out = one_of_each(docs)
    assert out.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(5, a), (5, b), (None, c), (9, None), (9, ""), (9, None), (2, "few")], key=str)
    assert one_of_each(docs.filter("false")).collect() == []
