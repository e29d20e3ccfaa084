"""The randomness battery: power by length, words left alone, and its false-discovery control against plain Python."""

import random
import string

WORDS = "the river carries small boats toward harbour every morning while people watch from bridges above water gently flowing into distant valleys".split()


def table(spark, natural=1500, each=60):
    rng, rows = random.Random(3), []

    def name():
        ws = [rng.choice(WORDS) for _ in range(rng.randint(4, 6))]
        kind = rng.randrange(5)
        if kind == 0:
            return "".join(w.capitalize() for w in ws) + str(rng.randint(0, 99))
        if kind == 1:
            return "/".join(ws) + f"/{rng.randint(0, 2030)}"
        if kind == 2:
            return "_".join(ws) + f"_{rng.randint(0, 9)}"
        return "".join(str(rng.randint(0, 9)) for _ in range(22)) if kind == 3 else "".join(ws)

    for length in (24, 28, 32, 40, 64):
        for _ in range(each):
            token = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(length))
            rows.append((len(rows), length, f"{name()} some words {token} more words"))
    for _ in range(natural):
        rows.append((len(rows), 0, f"{name()} and {name()} then {name()}"))
    return spark.createDataFrame(rows, "doc_id long, length int, text string").repartition(3)


def test_power_by_length(spark):
    from tidemark.llm.secrets_scan import scan

    found = {}
    for r in scan(table(spark)).collect():
        n, hits = found.get(r.length, (0, 0))
        found[r.length] = n + 1, hits + any(x.kind == "random" for x in r.spans)
    share = {k: hits / n for k, (n, hits) in found.items()}
    assert share[24] > 0.8 and all(share[k] > 0.95 for k in (28, 32, 40, 64)), share
    assert share[0] < 0.01, share


def test_thresholds_are_benjamini_hochberg(spark):
    from collections import defaultdict

    from pyspark.sql import functions as F

    from tidemark.llm import secrets_scan as s

    docs = table(spark, 300, 20)
    rows = docs.select(F.col("text").alias("text_")).select(F.explode(s._found()[1]).alias("x")).select("x.band", "x.decibel").collect()
    strata, want = defaultdict(list), {}
    for r in rows:
        strata[r.band].append(r.decibel)
    for band, values in strata.items():
        values.sort(reverse=True)
        ok = [d for d in values if 10 ** (-d / 10) <= 0.01 * sum(v >= d for v in values) / len(values)]
        if ok:
            want[band] = min(ok)
    assert want and dict(s.thresholds(docs)) == want


def test_secrets_of_awkward_tables(spark):
    from tidemark.llm.secrets_scan import redact, scan

    clash = "doc_id long, text string, start int, spans string, base_ string, text_ string, kind string"
    docs = spark.createDataFrame([(None, None, 1, "s", "b", "t", "k"), (1, "", 1, "s", "b", "t", "k"), (1, "token=abcdefgh", 1, "s", "b", "t", "k")], clash)
    out = redact(docs)
    assert out.dtypes == docs.dtypes and sorted(str(r.text) for r in out.collect()) == ["", "None", "[secret]"]
    plain = docs.select("doc_id", "text")
    assert scan(plain.filter("false")).collect() == [] and redact(docs.filter("false")).collect() == []
