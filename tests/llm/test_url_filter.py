"""URL rules against plain Python, and against SQL."""

import itertools
import random

from tabforge.llm import url_filter
from tests.oracle import connect, differences

SCHEMA = "page_id long, url string, rule int, verdict string, digest string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([k for k, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min([k for k, c in enumerate(tail) if c in "?#"], default=len(tail))
    return host.translate(UPPER), tail[:stop]


def judged(url, rules):
    host, path = parts(url)
    fits = []
    for h, p, v in rules:
        if None in (h, p, v) or v not in ("allow", "block"):
            continue
        h = h.translate(UPPER)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v, h + p))
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


ODD = [
    None, "", "no scheme", "://", "http://", "http:///x", "HTTP://WWW.Example.COM/en/1", "http://example.com", "http://example.com/en",
    "http://example.com/en/", "http://example.com/en/?q=/fr/", "http://example.com?x=/en/", "http://example.com#/en/", "x://a.net/es/b",
    "x://net/es/b", "x://xnet/es/b", "x://a.net/ES/b", "x://notexample.com/en/", "x://www.example.com/en/a", "x://a.www.example.com/en/a",
    "x://wwww.example.com/en/a", "x://example.com./en/", "x://example.com:80/en/", "x://u@example.com/en/", "x://a..com/", "x://com/", "x://.com/",
    "x://ÉÀ.com/é\n/b", "x://a\nb.com/c", "x://a.net/fr//", "first://second://example.com/en/", "x://" + "a." * 30_000 + "example.com/en/" + "b/" * 30_000,
]


def check(spark, urls, rules):
    pages = spark.createDataFrame([(k, u, 1, "x", "y") for k, u in enumerate(urls)], SCHEMA)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = url_filter.judge_urls(pages, table, ["page_id"])
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    expected = [(k, *judged(u, rules)) for k, u in enumerate(urls)]
    assert sorted(map(tuple, found.collect())) == expected
    kept = url_filter.keep_allowed(pages, table)
    assert kept.columns == pages.columns
    assert sorted(r.page_id for r in kept.collect()) == [e[0] for e in expected if e[4] == "allow"]


def test_odd_urls(spark):
    check(spark, ODD + ODD[6:12], url_filter.RULES)


def test_other_rules(spark):
    rules = [
        ("", "", "block"), ("Example.com", "", "block"), ("www.example.com", "/en/a", "block"), ("example.com", "/en/a", "allow"),
        ("a.www.example.com", "/", "allow"), (None, "/", "block"), ("com", None, "block"), ("com", "/e", None), ("com", "/en", "maybe"),
        ("net", "es/", "block"), ("a/b", "", "block"), ("net", "/es/?", "block"), ("com", "/", "allow"), ("com", "/", "block"), ("net", "/es/b", "block"),
    ]
    check(spark, ODD, rules)
    check(spark, ODD[:12], [])


def test_many_rules(spark):
    rng = random.Random(3)
    hosts = [".".join(p) for n in (1, 2, 3) for p in itertools.product("abc", repeat=n)]
    paths = ["", *("/" + "/".join(p) for n in (1, 2, 3) for p in itertools.product(["", "x", "yy"], repeat=n))]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(60)]
    rules = list({r[:2]: r for r in rules}.values())
    check(spark, [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x', '?y', '#/x'])}" for _ in range(400)], rules)


def test_empty_table(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(spark.createDataFrame([], SCHEMA), rules, ["page_id"]).collect() == []


def test_query_agrees_with_sql(spark, sf_dir):
    assert differences(url_filter.op13_url_filters(spark, sf_dir), connect(sf_dir), url_filter.SQL) == []
    plans = url_filter.op13_url_filters(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plans and "Arrow" not in plans
