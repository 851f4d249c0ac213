import random

import pytest

from chorale.llm import url_filter
from chorale.llm.url_filter import Rule


def _brute(url, rules):
    """Rule and verdict by trying every rule."""
    host, path = url_filter.split_url(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def _urls(rng, n):
    hosts, segments = ["com", "a.com", "b.a.com", "A.com", "xa.com", "net", "é.net", "", "a.com.", "a..com"], ["en", "e", "en7", "", "\u0001q", "x y", "日"]
    urls = [None, "", "no mark", "://", "http://", "http://a.com/x\u0001http://z.org/y", "http://a.com/en/\u0001q", "a://b://a.com/en", "http://a.com?x/en/", "http://a.com#/en/"]
    for _ in range(n):
        end = rng.choice(["", "?q=/en/", "#/en/", "?"])
        urls.append(f"{rng.choice(['http', 'ftp', ''])}://{rng.choice(hosts)}{''.join('/' + rng.choice(segments) for _ in range(rng.randint(0, 4)))}{end}")
    return urls


@pytest.mark.parametrize("limits", [{}, {"max_trie_rules": 0}, {"max_trie_chars": 0}])
def test_trie_and_join_agree_with_trying_every_rule(spark, limits):
    rng = random.Random(11)
    paths = ["", "/", "/en", "/en/", "/en/e", "/e", "/en/\u0001", "//", "/日/"]
    rules = [Rule(rng.choice(["allow", "block"]), rng.choice(["com", "a.com", "b.a.com", "net", "é.net", ""]), rng.choice(paths)) for _ in range(25)]
    urls = _urls(rng, 300)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = {i: _brute(u, rules) for i, u in enumerate(urls)}
    for given in (rules, spark.createDataFrame(rules, "verdict string, host string, path string")):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, given, **limits).collect()}
        assert got == want


@pytest.mark.parametrize("limit", [500_000, 0])
def test_rules_of_null_parts_and_capitals(spark, limit):
    rows = [("block", "Com", "en/"), ("allow", "a.COM", None), (None, "com", "/"), ("block", None, "/"), ("block", "com", "/en/")]
    pages = spark.createDataFrame([(1, "http://x.com/en/1"), (2, "http://a.com/q"), (3, "http://com/")], "page_id long, url string")
    given = spark.createDataFrame(rows, "verdict string, host string, path string")
    for rules in (given, [Rule(*r) for r in rows]):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, rules, max_trie_rules=limit).collect()}
        assert got == {1: ("com/en/", "block"), 2: ("a.com", "allow"), 3: (None, "allow")}


@pytest.mark.parametrize("limit", [500_000, 0])
def test_empty_tables_repeated_rows_and_clashing_names(spark, limit):
    names = "page_id long, url string, host string, path string, rule string, verdict string"
    rules = [url_filter.parse_rule("block", "com/en/")]
    assert url_filter.url_filter(spark.createDataFrame([], names), rules, max_trie_rules=limit).count() == 0
    long = "http://com/en/" + "x" * 200_000
    rows = [(1, "http://com/en/1", "h", "p", "r", "v")] * 2 + [(None, None, None, None, None, None), (2, long, "", "", "", "")]
    got = url_filter.url_filter(spark.createDataFrame(rows, names), rules, max_trie_rules=limit)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted([(r["page_id"], r["verdict"]) for r in got.collect()], key=str) == [(1, "block"), (1, "block"), (2, "block"), (None, "allow")]
    assert {r["verdict"] for r in url_filter.url_filter(spark.createDataFrame(rows, names), [], max_trie_rules=limit).collect()} == {"allow"}
