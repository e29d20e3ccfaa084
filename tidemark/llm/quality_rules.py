"""Quality rules from cross-document line frequency.  DataFrame functions only.

Lines are normalised (lower case, white space to single spaces, trimmed) and hashed.  For each
host and line the distinct documents are counted, where documents with the same normalised lines in
the same order count once, so that copies of one text don't turn its own lines into boilerplate.  Lines above the limit
are removed from a document; a document that keeps too small a share of its words is rejected.
With ``first_keeps`` a host's first document with a line (the least id of those that pass the base
rules; a null id is no first) keeps the line: of a group of near copies, whose shared lines are
above the limits by the group alone, the first stays.

Base measures come from the whole text: words and their letters, symbols, repeated lines, and words
inside eight-word windows that occur twice or more.

Nulls: a null text has no words; a null host is a host of its own; a null id stays null.  Equal
rows get equal results.  An empty table gives an empty result.  Columns besides the id, the text
and the host are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 8
#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Runs of anything but space and U+0009 to U+000D."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[ \\t-\\r]+", " "))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value made once: a lambda's variable can't be put back in place by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(windows: Column) -> Column:
    """Positions under windows that have an equal, from all windows' hashes in text order."""

    def marked(pairs: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(pairs, F.lit(1), F.size(pairs) - 1))
        after = F.slice(pairs, F.lit(2), F.size(pairs))
        beside = F.zip_with(F.zip_with(pairs, before, lambda p, q: F.struct(p.alias("p"), q["h"].alias("b"))), after, lambda x, q: F.when(x["p"]["h"].eqNullSafe(x["b"]) | x["p"]["h"].eqNullSafe(q["h"]), x["p"]["i"]))
        return F.sort_array(F.array_compact(beside))

    def summed(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    return let(let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), marked), summed)


def _word_counts(words: Column) -> Column:
    """Words, and those inside windows of eight that occur twice or more."""
    n = F.size(words)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW)))))
    repeated = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(0))
    return F.struct(n.cast("long").alias("n"), repeated.cast("long").alias("repeated"))


def _passes(counts: Column) -> Column:
    """The base rules on ``_word_counts``."""
    return (counts["n"] >= 20) & (100 * counts["repeated"] <= 30 * counts["n"])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("counts_", let(words_of(text), _word_counts))
    d = d.withColumn("lines_", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    d = d.withColumn("n_words", F.col("counts_.n")).withColumn("n_repeat_words", F.col("counts_.repeated")).withColumn("word_chars", F.length(F.regexp_replace(text, "[ \\t-\\r]+", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("counts_", "lines_")


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_docs: int = 50, most_share: float = 0.002, always_docs: int = 500, first_keeps: bool = False) -> DataFrame:
    """``(host, line, first)``: hashes of lines that stand in more than ``most_docs`` distinct documents of a host and more than ``most_share`` of them or ``always_docs``, with ``first_keeps`` each with the first document that holds it.

    One distinct count spread over (host, line, document) keys: no key gathers a host's rows.
    """
    lines = _lines(docs, text_col, host_col, id_col if first_keeps else None)
    once = lines.select("host", "whole", *lines.columns[3:], F.explode("lines").alias("line"))
    once = once.groupBy("host", "line", "whole").agg(F.min("id").alias("first")) if first_keeps else once.distinct()
    counted = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), *([F.min("first").alias("first")] if first_keeps else []))
    hosts = lines.select("host", "whole").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    hosts = hosts.withColumnRenamed("host", "of")
    return counted.filter(F.col("n") > most_docs).join(hosts, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > F.least(most_share * F.col("all"), F.lit(float(always_docs)))).select("host", "line", *(["first"] if first_keeps else []))


def _lines(docs: DataFrame, text_col: str, host_col: str, id_col: str | None = None) -> DataFrame:
    """Per row: its host, a hash of all its lines in order, its distinct lines' hashes, and, with ``id_col``, its id if it passes the base rules."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")
    hashes = F.transform(lines, lambda x: F.xxhash64(x))
    ids = [F.when(let(let(words_of(text), _word_counts), _passes), F.col(id_col)).alias("id")] if id_col else []
    d = docs.select(F.col(host_col).alias("host"), hashes.alias("l"), *ids)
    return d.select("host", F.xxhash64("l").alias("whole"), F.array_distinct("l").alias("lines"), *d.columns[2:])


def row_hash(*columns: str) -> Column:
    """A hash of a row's columns that tells nulls apart; equal rows share it."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.col(c))))


def _words_cut(rows: DataFrame, id_col: str, text_col: str, host_col: str, frequent: DataFrame) -> DataFrame:
    """``(row_, n, words_cut)`` of the rows that hold frequent lines of an earlier document: their words, and those in such lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    per_line = F.transform(F.split(text, "\n"), lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(words_of(x)).cast("long").alias("words")))
    counted = let(per_line, lambda x: F.struct(x.alias("lines"), F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y["words"]).alias("n")))
    lines = rows.select("row_", F.col(host_col).alias("host"), F.col(id_col).alias("id"), counted.alias("x")).select("row_", "host", "id", F.col("x.n").alias("n"), F.posexplode("x.lines").alias("nth", "y"))
    named = frequent.toDF(*("of", "frequent", "first")[: len(frequent.columns)])
    hit = lines.select("row_", "n", "nth", "host", "id", "y.line", "y.words").join(named, F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("frequent")))
    if "first" in hit.columns:
        hit = hit.filter(F.coalesce(F.col("id") != F.col("first"), F.lit(True)))
    return hit.groupBy("row_", "n", "nth").agg(F.first("words").alias("words")).groupBy("row_", "n").agg(F.sum("words").alias("words_cut"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_docs: int = 50, most_share: float = 0.002, least_kept: float = 0.5, always_docs: int = 500, first_keeps: bool = False) -> DataFrame:
    """``docs`` with the measures, ``words_left`` after removing frequent lines, and ``kept``."""
    rows = docs.withColumn("row_", row_hash(id_col, text_col, host_col))
    cut = written(_words_cut(rows, id_col, text_col, host_col, frequent_lines(docs, id_col, text_col, host_col, most_docs, most_share, always_docs, first_keeps)), "cut")  # its size is known when the join is planned
    out = measures(rows, id_col, text_col).join(cut.select("row_", "words_cut"), "row_", "left")
    left = F.col("n_words") - F.coalesce(F.col("words_cut"), F.lit(0))
    return out.withColumn("words_left", left).withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= least_kept * F.col("n_words"))).drop("row_", "words_cut")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)``."""
    out = judge(docs.select(id_col, text_col, host_col), id_col, text_col, host_col, **limits)
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_docs: int = 50, most_share: float = 0.002, least_kept: float = 0.5, always_docs: int = 500, first_keeps: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns as they were, that the rules keep.

    The base rules are one expression whose counts are made once, wherever the optimizer puts it;
    depleted rows leave by their hashes.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), *(F.col(c) for c in dict.fromkeys((id_col, text_col, host_col)))).withColumn("row_", row_hash(id_col, text_col, host_col))
    cut = _words_cut(whole, id_col, text_col, host_col, frequent_lines(docs, id_col, text_col, host_col, most_docs, most_share, always_docs, first_keeps))
    depleted = written(cut.filter(F.col("n") - F.col("words_cut") < least_kept * F.col("n")).select("row_"), "depleted")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return whole.filter(let(let(words_of(text), _word_counts), _passes)).join(depleted, "row_", "left_anti").select("whole.*")
