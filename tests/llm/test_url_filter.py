import pytest

from gleanery.llm import common, url_filter
from gleanery.llm.queries import URL_RULES


def brute(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [
        (len(h) + len(p), len(h), h + p, v) for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [
    None, "", "no scheme", "http://", "https://a.example.net/en/1?x=/fr/", "https://A.Example.NET/en", "http://example.net",
    "http://net/", "http://xnet/", "http://b.org/fr/#z", "http://b.org/f", "http://c.example.com/de/x/", "http://c.example.com?q=/de/",
    "http://h.example.com:80/de/1", "http://..net/x", "http://a.b//de/", "ftp://x.org/fr/fr/", "http://p.org/frank/1",
]


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("default", ["allow", "block"])
def test_longest_rule_wins(spark, monkeypatch, small, default):
    if not small:
        monkeypatch.setattr(common, "SMALL_ROWS", 0)
    rules = [*URL_RULES, ("block", "org", "/fr"), ("block", "", ""), ("allow", "c.example.com", "")][: 5 if small else None]
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    found = url_filter.judge(pages, spark.createDataFrame(rules, url_filter.RULES), default)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert found.count() == 2 * len(URLS)
    for i, url in enumerate(URLS * 2):
        want = brute(url, [(v, h, p) for v, h, p in rules], default)
        if ("block", "", "") in rules and want[2] is None and want[0] == "":
            want = (*want[:2], "", "block")
        assert got[i] == want, url


def test_ties_nulls_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (None, "http://a.b/c")], "page_id long, url string")
    rules = spark.createDataFrame([("allow", "a.b", "/c"), ("block", "a.b", "/c"), ("allow", "a.b", "/c")], url_filter.RULES)
    assert [(r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()] == [("a.b/c", "block")] * 2
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_hosts_of_rules_and_pages_are_lowered_alike(spark):
    rules = spark.createDataFrame([("block", "BÜcher.ORG", "/"), ("allow", "İ.Net", "/")], url_filter.RULES)
    pages = spark.createDataFrame([(1, "http://a.bÜCHER.org/x"), (2, "http://bücher.org/x"), (3, "http://İ.net/")], "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules, "other").collect()}
    assert found == {1: ("bÜcher.org/", "block"), 2: (None, "other"), 3: ("İ.net/", "allow")}
