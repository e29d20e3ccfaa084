"""The longest alignment of votes against all chains."""

import itertools
import random

from pyspark.sql import functions as F

from tidemark.llm.license_scan import _in_order


def longest(votes):
    """The length of the longest chain, and the starts that chains of that length can have."""
    for n in range(len(votes), 0, -1):
        starts = set()
        for c in itertools.combinations(sorted(votes), n):
            if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:])):
                starts.add(c[0][1] - c[0][0])
        if starts:
            return n, starts
    return 0, set()


def test_against_all_chains(spark):
    rng = random.Random(1)
    rows = [(i, sorted({(rng.randrange(8), rng.randrange(12)) for _ in range(rng.randint(1, 9))})) for i in range(150)]
    rows += [(150, [(0, 0), (1, 30), (2, 2), (3, 3)]), (151, [(k, k + 5) for k in range(10)]), (152, [(0, 9), (0, 3), (0, 1), (1, 2)])]
    df = spark.createDataFrame(rows, "i int, met array<struct<t:int,p:int>>")
    for r in df.select("i", _in_order(F.col("met")).alias("x")).collect():
        n, starts = longest(rows[r["i"]][1])
        assert r["x"]["n"] == n and r["x"]["start"] in starts


def test_an_early_vote_on_a_later_diagonal_drops_nothing(spark):
    """One stray vote ahead of all others: it is left out, and the others count."""
    votes = [(0, 7), (1, 90), *((k, k + 7) for k in range(2, 60))]
    r = spark.createDataFrame([(votes,)], "met array<struct<t:int,p:int>>").select(_in_order(F.col("met")).alias("x")).first()["x"]
    assert (r["n"], r["start"]) == (59, 7)
