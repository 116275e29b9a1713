import random

import pytest

from tessera.llm import urls
from tessera.llm.queries import URL_RULES


def brute(url, rules):
    """Host, path, rule and verdict by trying every rule."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://a.example.net/de/81", "ftp://xnet/de/", "http://net/de/", "http://net?x", "http://org#/es/",
    "http://a://b.org/es/", "http://example.com:80/en/", "http://.com/en/", "http://com./en/", "http://Ünï.org/es/ü", "x://org/es", "http://\x00.com/en/",
]


def judged(spark, urls_in, rules, **options):
    rows = spark.createDataFrame([(i, u, "kept", 1) for i, u in enumerate(urls_in)], "page_id int, url string, RULE string, near int")
    out = urls.filter_urls(rows, rules, **options)
    assert sorted(c.lower() for c in out.columns) == ["host", "near", "page_id", "path", "rule", "url", "verdict"]
    return [tuple(r) for r in out.select("host", "path", "rule", "verdict").orderBy("page_id").collect()] if len(urls_in) < 2 else [tuple(r)[1:] for r in out.select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()]


@pytest.mark.parametrize("options", [{}, {"block": 1, "salts": 3}])
def test_edge_cases(spark, options):
    assert judged(spark, URLS, URL_RULES, **options) == [brute(u, URL_RULES) for u in URLS]


@pytest.mark.parametrize("block", [50_000, 3])
def test_random_rules(spark, block):
    r = random.Random(3)
    host = lambda: ".".join(r.choice(("a", "b", "aa", "c-d")) for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 4)))
    rules = list({(h, p): (h, p, r.choice(("block", "allow"))) for h, p in ((host(), path()) for _ in range(60))}.values())
    some = [f"http://{host()}{path()}" for _ in range(500)] + ["http://a.b/x"] * 200  # a hot host
    assert judged(spark, some, rules, block=block) == [brute(u, rules) for u in some]


def test_no_rules_and_no_rows(spark):
    assert judged(spark, ["http://a/b", "c"], []) == [("a", "/b", None, "allow"), ("", "", None, "allow")]
    assert judged(spark, [], URL_RULES) == []


def test_rules_as_a_table(spark):
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block")], "host string, path string, verdict string")
    assert judged(spark, URLS, rules) == [brute(u, URL_RULES) for u in URLS]


@pytest.mark.parametrize("block", [50_000, 1])
def test_columns_of_any_name_are_kept(spark, block):
    rules = [("com", "/", "block"), ("org", "/a", "block"), ("net", "/", "block")]
    pages = spark.createDataFrame([("http://x.com/a", 1, 2, 3)] * 3, "`the url` string, _judged int, _block int, _salt int")
    out = urls.filter_urls(pages, rules, url="the url", block=block)
    assert [(r._judged, r._block, r._salt, r.rule) for r in out.collect()] == [(1, 2, 3, "com/")] * 3
