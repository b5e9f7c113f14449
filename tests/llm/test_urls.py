"""Operator 12 against brute force."""

import random
from collections import Counter

import pytest

from corpuskit.llm import url_filter

SCHEMA = "page_id bigint, url string, html string, host string, place string, rule string"


def brute(rows, rules, default="allow"):
    out = []
    for i, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
        fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        out.append((i, host, path, best and best[3], best[4] if best else default))
    return Counter(out)


def judged(spark, rows, rules, **kw):
    pages = spark.createDataFrame([(i, u, "x", "clash", "clash", "clash") for i, u in rows], SCHEMA)
    got = url_filter.judge(pages, spark.createDataFrame(rules, url_filter.RULE_SCHEMA), **kw)
    return Counter(tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect())


ODD = [(1, None), (2, ""), (3, "example.com/en/"), (4, "http://"), (5, "http://Example.COM/en/x?q#f"), (5, "http://Example.COM/en/x?q#f"),
       (6, "http://www.example.com/en/"), (7, "x://notexample.com/en/"), (8, "x://a.b.example.com/en/y"), (9, "x://www.example.com?/en/"),
       (10, "x://net/fr/"), (11, "x://net/fr"), (12, "x://a..net/es/1"), (13, "x://.net/es/"), (14, "x://net./es/"), (None, "http://q.net/es/?a://b.com/"),
       (15, "x://" + "a." * 20_000 + "com/" + "p" * 50_000), (16, "x://com"), (17, "x://user@www.example.com:80/en/"), (18, "x://com/\nen/"), (19, "a://b://c.com/")]


@pytest.mark.parametrize("rule_bytes", [url_filter.RULE_BYTES, 0])
def test_verdicts_match_brute_force(spark, rule_bytes, monkeypatch):
    from corpuskit.functions import joins
    if not rule_bytes:  # neither table may be broadcast
        monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    assert judged(spark, ODD, url_filter.RULES, rule_bytes=rule_bytes) == brute(ODD, url_filter.RULES)


def test_random_rules_match_brute_force(spark):
    rng = random.Random(3)
    host = lambda: ".".join(rng.choice(["a", "b", "aa", ""]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "x", "y"]) for _ in range(rng.randint(0, 4)))
    rows = [(i, f"s://{host()}/{path()}") for i in range(400)]
    rules = [(host(), "/" + path(), rng.choice(["allow", "block"])) for _ in range(60)]
    rules = [r for r in rules if r[0]] + [("a", "/", "allow"), ("a", "/", "block"), ("b.a", "", "allow")]
    assert judged(spark, rows, rules, default="block") == brute(rows, rules, default="block")


def test_empty_tables(spark):
    assert judged(spark, [], url_filter.RULES) == Counter()
    pages = spark.createDataFrame([(1, "http://a.com/", "x", "", "", "")], SCHEMA)
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    assert [tuple(r) for r in url_filter.judge(pages, none, default="block").collect()] == [(1, "a.com", "/", None, "block")]


def test_short_digests_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHORT", 1)  # most expressions share a short form
    assert judged(spark, ODD, url_filter.RULES) == brute(ODD, url_filter.RULES)
