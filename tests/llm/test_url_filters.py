"""URL filters against a plain matcher, with awkward URLs and rules."""

import random
import re

from tidemark.llm import url_filters

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return m[1].translate(LOWER), m[2]


def fitting(host, path, rules):
    fits = [(len(h) + len(p), len(h), v == "block", h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits) if fits else None


def plain(url, rules, default="allow"):
    host, path = parts(url)
    own = fitting(host, path, rules)
    if own:
        return host, path, own[3], "block" if own[2] else "allow"
    clean = re.sub(r"[.]+", ".", re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", host))).strip(".")
    slashes = re.sub(r"/+", "/", path) or ("/" if clean else "")
    more = fitting(clean, slashes, rules)
    return host, path, None, ("block" if more[2] else "allow") if more else default


def found(spark, urls, rules=url_filters.RULES, default="allow"):
    df = spark.createDataFrame([(i, u, "e", 1, "short") for i, u in enumerate(urls)], "page_id long, url string, made string, row_ int, host string").repartition(3)
    got = url_filters.judge(df, url_filters.rule_table(spark, rules), default).collect()
    assert len(got) == len(urls)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}


URLS = [
    None, "", "no scheme/en/", "http://net/", "http://net", "http://a.net/x", "http://anet/x", "HTTP://A.B.NET/X", "https://example.net/en/1", "https://www.example.net/en", "https://www.example.net/en/?a=/de/",
    "http://notexample.net/en/1", "http://example.com/de/", "http://x.example.com/DE/", "http://x.example.com/de/1#/fr/", "http://example.org/fr/", "http://org/fr/x", "a://b://net/x", "http://net?x/", "http://net#/", "http://user@net/x",
    "http://a.net:80/x", "http://a.net.:80//x", "http://..net../x", "http://.net/x", "http://net./x", "http://ÉXAMPLE.net/x", "http://a.net" + "/" + "y" * 100_000, "http://" + "a." * 20_000 + "net/x", "://net/x", "http:///en/", "http://net/\nline", "http://org\n.net/fr/",
]


def test_urls(spark):
    got = found(spark, URLS)
    for i, u in enumerate(URLS):
        assert got[i] == plain(u, url_filters.RULES), u


def test_longest_rule_and_repeats(spark):
    rules = [("block", "b.c", "/"), ("allow", "a.b.c", ""), ("block", "c", "/x/y"), ("allow", "c", "/x/y"), ("allow", "b.c", "/xy"), ("block", "c", "/a/b/c"), ("block", "A.C", "/Q")]
    rng = random.Random(5)
    urls = ["http://" + ".".join(rng.choices("abc", k=rng.randint(1, 4))) + rng.choice(["", "/", "/x/y/z", "/xy", "/a/b/c/d", "/Q"]) for _ in range(300)]
    lower = [(v, h.translate(LOWER), p) for v, h, p in rules]
    got = found(spark, urls * 2, rules, "block")
    for i, u in enumerate(urls * 2):
        assert got[i] == plain(u, lower, "block"), u


def test_many_rules_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "SENT", 3)
    got = found(spark, URLS)
    assert all(got[i] == plain(u, url_filters.RULES) for i, u in enumerate(URLS))


def test_null_rules_and_empty_tables(spark):
    rules = [("block", None, "/"), ("block", "net", None), (None, "net", "/"), ("block", "", "/")]
    assert found(spark, ["http://net/x"], rules) == {0: ("net", "/x", None, "allow")}
    assert found(spark, []) == {}
    twice = spark.createDataFrame([(None, "http://net/"), (None, "http://net/")], "page_id long, url string")
    assert [tuple(r) for r in url_filters.judge(twice, url_filters.rule_table(spark)).collect()] == [(None, "net", "/", "net/", "block")] * 2
