import random

import pytest

from shellsieve.llm import urls
from shellsieve.llm.common import LOWER, UPPER
from shellsieve.llm.queries import URL_RULES
from shellsieve.llm.urls import url_verdicts


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return host.translate(str.maketrans(UPPER, LOWER)), path


def judge(url, rules):
    host, path = split_url(url)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1]) and host]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


URLS = [
    None, "", "no scheme/com/", "http://com/", "http://a.COM/x", "http://example.com/en/1", "x://www.Example.com/en/",
    "http://www.example.com/fr/?q=http://a.net/es/", "http://xcom/", "http://a.net/es/#f", "http://a.net/es", "http://net?x=/es/",
    "http://a.net/ES/", "http://example.com", "http://example.com#/en/", "http://user@example.com:80/en/", "://com/",
    "http://É.com/é", "http://a.com/new\nline", "http:///en/", "http://.com/", "http://com./", "http://a.com//en/",
]


@pytest.mark.parametrize("rules", [URL_RULES, URL_RULES[:1], (), (("com", "", "block"), ("a.com", "/x", "block"), ("É.com", "/", "block"))])
def test_verdicts(spark, rules):
    table = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    lowered = [(h.translate(str.maketrans(UPPER, LOWER)), p, v) for h, p, v in rules]
    pages = [(i, u, "x", "y") for i, u in enumerate([*URLS, *URLS[4:6], *["http://a.com/x"] * 50])] + [(None, "http://net/fr/", "", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, host string, block string")
    expected = sorted(((i, *judge(u, lowered)) for i, u, *_ in pages), key=repr)
    assert sorted(map(tuple, url_verdicts(df, table).collect()), key=repr) == expected
    assert url_verdicts(df.limit(0), table).collect() == []


def test_many_rules(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS_PER_RULE", 4)
    rng = random.Random(0)
    rules = list({(f"h{rng.randint(0, 99)}.org", rng.choice(["/", "/a", "/ab/", "/b/c"])): rng.choice(["allow", "block"]) for _ in range(250)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    pages = [(i, f"https://{rng.choice(['', 'x.', 'y.x.'])}h{rng.randint(0, 150)}.org{rng.choice(['', '/', '/a', '/abc', '/ab/c', '/b/c/d'])}") for i in range(800)]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), table).collect()
    assert sorted(map(tuple, found)) == sorted((i, *judge(u, rules)) for i, u in pages)


def test_no_python_in_the_plan(spark):
    df = url_verdicts(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), spark.sql("SELECT 'a' host, '/' path, 'block' verdict"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_long_hosts_and_paths(spark):
    """A million characters of labels or of path take a moment."""
    long = [f"http://{'a.' * 500_000}example.com/en/x", f"http://net/es/{'y/' * 500_000}", f"x://{'.' * 500_000}com/"]
    pages = [(i, u) for i, u in enumerate(long * 3)]
    table = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    found = url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), table).collect()
    rules = {0: ("example.com/en/", "block"), 1: ("net/es/", "block"), 2: ("com/", "allow")}
    assert {(r.page_id, r.rule, r.verdict) for r in found} == {(i, *rules[i % 3]) for i, _ in pages}
