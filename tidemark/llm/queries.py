"""The queries of this subpackage, each applying one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoding_digests
from .common import read_table, written
from .embedding_dedup import link_vectors
from .hard_negatives import mine
from .jaccard_join import near_duplicates
from .license_scan import scan
from .lm_scoring import score_documents
from .packing import pack
from .prefix_trie import prefix_trie
from .quality_rules import verdicts
from .secrets_scan import digests
from .token_counts import context_totals, length_histogram
from .toxicity import classify
from .url_filters import judge, rule_table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; any other path does as well."""
    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), held_out=(7, 2))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_totals(written(length_histogram(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")), "histogram"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=5, percent=75)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=2048, end_id=1)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read_table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), held_out=(5, 0))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read_table(spark, sf_dir, "embeddings"), least=0.93)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"), group=20, most=4)


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), rule_table(spark))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read_table(spark, sf_dir, "embeddings"), positives=5, negatives=5, low=80, high=100, every=100, label=label)


QUERIES: dict[str, Query] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_token_counts": op3_token_counts,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scans": op7_license_scans,
    "op8_toxicity": op8_toxicity,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_bpe": op10_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_url_filters": op12_url_filters,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Words are runs of anything but the six separators; A-Z alone are lowered, as translate() does.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t-\\r]+'), lambda w: w <> '')"
_REACH = """
    reach(u, v) AS (SELECT {id}, {id} FROM {table} UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
    least AS (SELECT u, min(v) AS component FROM reach GROUP BY u)"""

#: SQL of the operators that it can express whole: brute force on all rows.
ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": f"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        met AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT u, v FROM met JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * m >= 75 * (x.n + y.n - m)),
        {_REACH.format(id="doc_id", table="documents")}
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.component AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON least.u = d.doc_id""",
    "op6_quality_rules": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
        w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("t")} AS w FROM d),
        at8 AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) >= 8)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM at8) WHERE k > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM twice, generate_series(0, 7) g(o) GROUP BY doc_id),
        l AS MATERIALIZED (SELECT doc_id, host, list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(lower(x), '[ \\t-\\r]+', ' ', 'g'))) AS l FROM d),
        whole AS (SELECT DISTINCT host, list_filter(l, lambda x: x <> '') AS whole FROM l),
        many AS (
            SELECT f.host, f.line FROM (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT host, whole, unnest(whole) AS line FROM whole) GROUP BY ALL) f
            JOIN (SELECT host, count(*) AS n_all FROM whole GROUP BY host) h ON f.host IS NOT DISTINCT FROM h.host
            WHERE n > 50 AND n > least(0.002 * n_all, 500)),
        cut AS (
            SELECT doc_id, sum(len({_WORDS.format("x.line")})) AS n FROM (SELECT doc_id, host, unnest(l) AS line FROM l) x
            JOIN many ON x.host IS NOT DISTINCT FROM many.host AND x.line = many.line GROUP BY doc_id),
        m AS (
            SELECT d.doc_id, len(w.w) AS n_words, length(regexp_replace(t, '[ \\t-\\r]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                (SELECT count(x) - count(DISTINCT x) FROM (SELECT unnest(string_split(t, chr(10))) AS x) WHERE regexp_matches(x, '[^ \\t-\\r]')) AS n_dup_lines,
                coalesce(rep.n_repeat_words, 0) AS n_repeat_words, len(w.w) - coalesce(cut.n, 0) AS words_left
            FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN cut USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND words_left >= 0.5 * n_words AS kept, words_left::BIGINT AS words_left
        FROM m""",
    "op9_embedding_dedup": f"""
        WITH RECURSIVE e AS MATERIALIZED (
            SELECT vec_id, label, v FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
            WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
        links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        {_REACH.format(id="vec_id", table="embeddings")},
        n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
        SELECT x.vec_id, coalesce(n.n, 0) AS n_links, least.component AS component_id, x.vec_id = least.component AS kept
        FROM embeddings x LEFT JOIN n ON n.u = x.vec_id JOIN least ON least.u = x.vec_id""",
    "op11_prefix_trie": """
        WITH o AS MATERIALIZED (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS at, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL),
        steps AS (SELECT c, list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))) AS s FROM o GROUP BY c),
        h AS (SELECT c, xor(list_reduce(s, lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295) % 4 AS h FROM steps),
        r AS (
            SELECT h.c, o.at AS ord, 0 AS own, role, text FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.at <= h.h
            UNION ALL SELECT h.c, o.at, 1, role, text FROM h JOIN o ON o.c = h.c AND o.at > h.h),
        p AS MATERIALIZED (
            SELECT c, row_number() OVER w AS depth, string_agg(md5(length(role)::VARCHAR || ':' || role || text), '') OVER w AS path, len(list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '')) AS words
            FROM r WINDOW w AS (PARTITION BY c ORDER BY own, ord)
            UNION ALL SELECT c, 0, '', 0 FROM h),
        size AS (SELECT c, max(depth) AS size FROM p GROUP BY c),
        nodes AS MATERIALIZED (
            SELECT depth, path, min(c) AS conv_id, count(*) AS n, min(words) AS words, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = size), '') AS ends
            FROM p JOIN size USING (c) GROUP BY depth, path),
        kids AS MATERIALIZED (SELECT depth - 1 AS depth, path[:32 * (depth - 1)] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        sums AS (
            SELECT a.depth, a.path, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((b.n - 1) * b.words)::BIGINT AS saved_tokens
            FROM nodes a JOIN nodes b ON b.depth >= a.depth AND b.path[:32 * a.depth] = a.path LEFT JOIN kids k ON k.depth = b.depth AND k.path = b.path GROUP BY ALL)
        SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(x.ends) AS ends_sha256
        FROM nodes x JOIN sums s ON s.depth = x.depth AND s.path = x.path
        LEFT JOIN nodes u ON u.depth = x.depth - 1 AND u.path = x.path[:32 * (x.depth - 1)] LEFT JOIN kids k ON k.depth = x.depth AND k.path = x.path""",
    "op12_url_filters": f"""
        WITH u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
        p AS (SELECT k, page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1)")} AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
        q AS (
            SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+', '.', 'g'), '^[.]|[.]$', '', 'g') AS h2, regexp_replace(path, '/+', '/', 'g') AS p1 FROM p),
        c AS (SELECT *, CASE WHEN p1 = '' AND h2 <> '' THEN '/' ELSE p1 END AS p2 FROM q),
        rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(verdict, h, p)),
        hits AS (
            SELECT k, arg_max(struct_pack(rule := CASE WHEN own THEN h || p END, verdict := verdict), struct_pack(own := own, n := length(h) + length(p), h := length(h))) AS best
            FROM (
                SELECT k, true AS own, r.* FROM c JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)
                UNION ALL SELECT k, false, r.* FROM c JOIN rules r ON (h2 = r.h OR ends_with(h2, '.' || r.h)) AND starts_with(p2, r.p))
            GROUP BY k)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM c LEFT JOIN hits USING (k)""",
    "op13_hard_negatives": """
        WITH e AS MATERIALIZED (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS s FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
        p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
        SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
        FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s
        WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) QUALIFY rank <= 5""",
}
