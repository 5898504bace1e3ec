import re
from collections import Counter

from rillflow.llm.queries import URL_RULES
from rillflow.llm.url_filters import filter_urls

URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/7?x#y", "https://example.com/en/81", "http://a.example.com/en/77/en/", "http://notexample.com/en/7", "http://x.net/de/8",
    "http://example.net/de/8", "http://m.example.net/de/81#", "http://example.net?/de/8", "http://org/es/", "ftp://a.b.org/es/x?y://c", "http://example.com./en/7", "http://com/en", "http://..com/en/", "http://exam\nple.com/en/\n", "http://x.com/EN/", "http://ÉX.com/en/é",
]


def plain(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("", "") if m is None else (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2])
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, "allow"))


def test_against_every_rule(spark):
    rows = [(i if i % 5 else None, u) for i, u in enumerate(URLS * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "url as host", "1 as rule", "'x' as judged_url")
    got = Counter(map(tuple, filter_urls(pages, URL_RULES).collect()))
    assert got == Counter((i, *plain(u, URL_RULES)) for i, u in rows)


def test_other_rules_and_default(spark):
    rules = [("a.com", "", "block"), ("a.com", "/x", "allow"), ("b.a.com", "", "allow"), ("a.com", "/x", "allow")]
    rows = list(enumerate(["http://a.com", "http://b.a.com/x", "http://a.com/xy", "http://c.com", "http://c.b.a.com/"]))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert Counter((r.page_id, r.rule) for r in filter_urls(pages, rules, default="block").collect()) == Counter([(0, "a.com"), (1, "b.a.com"), (2, "a.com/x"), (3, None), (4, "b.a.com")])
    assert {r.verdict for r in filter_urls(pages, [], default="block").collect()} == {"block"}
    assert filter_urls(pages.limit(0), rules).count() == 0
