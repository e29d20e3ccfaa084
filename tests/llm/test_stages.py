"""The pipeline's filtering stages on awkward rows, and the whole pipeline on empty tables."""

import random

from tidemark.llm.quality_rules import judge, keep_good
from tidemark.llm.toxicity import reject_toxic

CLASHES = "id long, body string, row long, row_ long, h long, w string, n long, word string, whole string, kept boolean"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
SPARE = (1, "b", 2, 3, 4, "w", 5, "x", "y", False)


def texts():
    rng = random.Random(1)
    plain = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(30)]
    odd = [None, "", " \n\t ", "x" * 200_000, "a b c d e f g h " * 30, "\n".join(f"line {k} of many {k * 7}" for k in range(50_000)), "too few words", "repeat " * 500]
    return plain + odd + plain[:2]


def docs(spark):
    rows = [(i if i != 7 else None, t, "en", None if i % 4 == 0 else "s", len(t or ""), *SPARE) for i, t in enumerate(texts())]
    rows += [rows[3]] * 3  # equal rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality_rules_keep_what_they_judge_good(spark):
    df = docs(spark)
    got = keep_good(df)
    assert got.dtypes == df.dtypes
    judged = judge(df.select("doc_id", "text", "source")).filter("kept").select("doc_id", "text", "source")
    assert table(got.select("doc_id", "text", "source")) == table(judged)
    assert got.filter("doc_id is null").count() == 1 and got.filter("doc_id = 3").count() == 4
    assert keep_good(df.limit(0)).count() == 0


def test_lines_of_many_documents_go_with_their_documents(spark):
    """A line that 60 documents share: those that keep too few words without it are rejected, the others stay."""
    line = " ".join(f"shared{k}" for k in range(30))
    rows = [(i, f"{line}\nown{i} words{i} few{i}" if i < 40 else line + "\n" + " ".join(f"o{i}_{k}" for k in range(60)), "en", "s", 1, *SPARE) for i in range(60)]
    got = {r["doc_id"] for r in keep_good(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == set(range(40, 60))


def test_first_of_near_copies_stays(spark):
    """60 near copies that share body lines: the first that passes the base rules stays, and a notice still goes from the others."""
    body = [" ".join(f"b{j}w{k}" for k in range(12)) for j in range(4)]
    notice = "this notice stands in every one of the documents of this host and is long enough to deplete"
    rows = [(i, "\n".join([notice, *body, f"own{i} words{i}"]), "en", "s", 1, *SPARE) for i in range(10, 70)]
    rows += [(i, "\n".join([notice, *body]) + "\n" + "again " * 60, "en", "s", 1, *SPARE) for i in range(5, 10)]  # fail the base rules
    rows += [(i, notice + "\n" + " ".join(f"o{i}_{k}" for k in range(5 if i < 130 else 60)), "en", "s", 1, *SPARE) for i in range(100, 160)]
    rows += [(None, "\n".join([notice, *body, "no id"]), "en", "s", 1, *SPARE)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {r["doc_id"] for r in keep_good(df).collect()} == set(range(130, 160))
    kept = keep_good(df, first_keeps=True)
    assert {r["doc_id"] for r in kept.collect()} == {10, *range(130, 160)}
    judged = judge(df.select("doc_id", "text", "source"), first_keeps=True).filter("kept")
    assert table(kept.select("doc_id", "text", "source")) == table(judged.select("doc_id", "text", "source"))
    assert keep_good(df.limit(0), first_keeps=True).count() == 0


def test_toxicity_keeps_rows_and_columns(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    df = docs(spark).drop("doc_id").selectExpr("cast(null as long) as doc_id", "*")
    more = real.selectExpr("doc_id", "text", "lang", "source", "n_chars", *[f"cast(null as {t}) as {n}" for n, t in (c.split() for c in CLASHES.split(", "))])
    both = df.unionByName(more.selectExpr(*df.columns))
    got = reject_toxic(both, labels)
    assert got.dtypes == both.dtypes
    kept, given = table(got.select("text")), table(both.select("text"))
    assert 0.8 * len(given) < len(kept) <= len(given) and got.filter("text is null").count() == 1
    assert reject_toxic(both.limit(0), labels).count() == 0


def test_the_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "start", "length", "sequence_id"} <= set(out.columns)
