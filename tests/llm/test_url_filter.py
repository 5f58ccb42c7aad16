"""URL rules against a plain loop."""

from __future__ import annotations

import random

import pytest

from clauseloom.llm import queries, url_filter
from tests.llm.conftest import SF

ODD_URLS = [
    None, "", "no scheme/net/", "http://", "http://net", "http://net/", "HTTP://A.NET/en/x", "x://example.net/en/", "x://notexample.net/en/", "x://example.net/en",
    "x://a.b.example.com/de/?q#f", "x://example.com?/de/", "x://example.com#/de/", "x://org/fr/y://z", "x://a..org/fr/", "x://.net/", "x://é.NET/É/",
]


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(rule), len(h)) > best[0]):
            best = ((len(rule), len(h)), rule, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


def run(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    out = url_filter.judge(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}


def test_odd_urls(spark):
    got = run(spark, ODD_URLS, queries.URL_RULES)
    assert got == {i: brute(u, queries.URL_RULES) for i, u in enumerate(ODD_URLS)}


def test_many_rules(spark):
    rng = random.Random(5)
    part = lambda: rng.choice(["a", "b", "cc"])
    rules = {".".join(part() for _ in range(rng.randrange(1, 4))) + "/" + "/".join(part() for _ in range(rng.randrange(3))): rng.choice(["allow", "block"]) for _ in range(60)}
    rules |= {"a.b": "block"}
    urls = [f"http://{'.'.join(part() for _ in range(rng.randrange(1, 6)))}/{'/'.join(part() for _ in range(rng.randrange(4)))}" for _ in range(500)]
    assert run(spark, urls, list(rules.items())) == {i: brute(u, list(rules.items())) for i, u in enumerate(urls)}


def test_no_rules_and_bad_verdict(spark):
    assert run(spark, ["http://a/b"], [(None, "block")]) == {0: ("a", "/b", None, "allow")}
    with pytest.raises(ValueError):
        run(spark, ["http://a/b"], [("a/", "maybe")])
    assert run(spark, ["http://a/b"], [("a/", "allow"), ("a/", "block")])[0][3] == "block"


def test_collision(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda data: 7)
    url_filter.RuleIndex.write(str(tmp_path / "x"), {"a/": "block", "b/": "allow", "c/": "block"})
    index = url_filter.RuleIndex(str(tmp_path / "x"))
    assert [r[2:] for r in index.judge(["x://b/", "x://c/", "x://d/"])] == [("b/", "allow"), ("c/", "block"), (None, None)]


def test_query(spark):
    rows = queries.op7_url_filter(spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: brute(u, queries.URL_RULES) for i, u in urls.items()}
