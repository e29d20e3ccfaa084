"""URL filters: host-suffix and path-prefix expressions met with rules by hash.

A rule ``(host, path, verdict)`` fits a URL when the URL's host is the rule's or a subdomain of it,
and the URL's path starts with the rule's; the longest fitting rule wins.

* Expressions: the rules' shapes (labels of the host, letters of the path) say which last labels and
  first letters of a URL can be a rule, so a URL has at most one expression a shape, however long it is.
* Join: expressions and rules meet on the first 32 bits of their SHA-256; the full digest confirms.
* Precedence: a number per hit (own rule before method's, then letters, then letters of the host,
  then block before allow), of which the greatest stays; one row a URL leaves each map task.

Where no rule fits the URL as it stands, the method decides on its canonical form: user and port
left out, dots at the ends and repeated dots of the host dropped, repeated slashes of the path made
one and an empty path read as ``/``.  Where no rule fits that either, the default verdict holds.

Nulls: a null URL or one without ``://`` has empty host and path and gets the default verdict; a
null page id is kept.  Repeated rows are judged each.  An empty table gives no rows, no rules give
the default to all.  Rules with a null host, path or verdict, or no host, are left out.  Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Rules up to this number (their digests take a few MB) travel to all tasks; more are joined by a shuffle.
SENT = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://`` with A-Z lowered, and the path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host, path = (F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """Without user and port, with single dots and slashes, and ``/`` for an empty path."""
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"[.]+", "."), r"^[.]|[.]$", "")
    path = F.regexp_replace(path, r"/+", "/")
    return host, F.when((path == "") & (host != ""), "/").otherwise(path)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every row."""
    good = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path").filter("verdict in ('allow', 'block') and path is not null and host <> ''")
    keys = good.groupBy(F.sha2(F.concat("host", "path"), 256).alias("full")).agg(F.max((F.col("verdict") == "block").cast("int")).alias("block"))
    keys = keys.withColumn("short", F.substring("full", 1, 8))
    shapes = good.select(F.size(F.split("host", "[.]")).alias("labels"), F.length("path").alias("letters")).distinct()
    shapes = sorted(tuple(r) for r in shapes.collect())  # as many as the rules have shapes; rows of the pages don't count
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id_"), host.alias("host"), path.alias("path"))
    if not shapes:
        return rows.select(F.col("id_").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    def expressions(host: Column, path: Column, own: int) -> list[Column]:
        n = F.size(F.split(host, "[.]"))
        out = []
        for labels, letters in shapes:
            end = F.substring_index(host, ".", -labels)
            start = F.substring(path, 1, letters)
            rank = F.lit(own << 62).bitwiseOR(F.shiftleft((F.length(end) + letters).cast("long"), 32)).bitwiseOR(F.shiftleft(F.length(end).cast("long"), 1))
            out.append(F.when((n >= labels) & (F.length(path) >= letters), F.struct(F.sha2(F.concat(end, start), 256).alias("made"), rank.alias("rank"))))
        return out

    clean_host, clean_path = canonical(F.col("host"), F.col("path"))
    rows = rows.withColumns({"row_": F.monotonically_increasing_id(), "clean_host": clean_host, "clean_path": clean_path})
    changed = (F.col("clean_host") != F.col("host")) | (F.col("clean_path") != F.col("path"))
    more = [F.when(changed, e) for e in expressions(F.col("clean_host"), F.col("clean_path"), 0)]
    listed = F.filter(F.array(*expressions(F.col("host"), F.col("path"), 1), *more), lambda e: e.isNotNull())
    spread = rows.select("row_", "id_", "host", "path", F.explode_outer(listed).alias("e")).select("row_", "id_", "host", "path", "e.made", "e.rank", F.substring("e.made", 1, 8).alias("short"))
    few = keys.limit(SENT + 1).count() <= SENT
    met = spread.join(F.broadcast(keys) if few else keys, "short", "left")
    hit = F.when(F.col("made") == F.col("full"), F.col("rank").bitwiseOR(F.col("block").cast("long")))
    best = met.groupBy("row_", "id_", "host", "path").agg(F.max(hit).alias("best"))
    own = F.col("best") >= (1 << 62)
    wide = F.shiftright(F.col("best"), 1).bitwiseAND((1 << 31) - 1).cast("int")
    total = F.shiftright(F.col("best"), 32).bitwiseAND((1 << 30) - 1).cast("int")
    rule = F.when(own, F.concat(F.right("host", wide), F.left("path", total - wide)))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best").bitwiseAND(1) == 1, "block").otherwise("allow")
    return best.select(F.col("id_").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))
