import random

import pytest
from pyspark.sql import functions as F

from cinderwell.llm import urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end].translate({c: c + 32 for c in range(65, 91)}), rest[end:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("spread", [50_000, 3])
def test_matches_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(urls, "SPREAD", spread)
    rng = random.Random(8)
    rules = RULES + [("allow", "net", "/a/b"), ("block", "net", "/a/b/c/"), ("block", "net", "/a/"), ("allow", "x.example.net", ""), ("block", "com", "/d"), ("block", "net", "/a~")]
    pages = [(i, rng.choice(["http://", "https://", "a://b://"]) + rng.choice(["", "www.", "x.", "X.y."]) + rng.choice(["Example.net", "example.com", "org", "ample.net", "a.org", "net"])
              + rng.choice(["", "/", "/en/", "/de/1", "/fr/", "/a/b/c/d", "/a/b", "/a", "/a/é", "/d", "?q=/en/", "#/fr/", "/en/?x#y", "/a~b", "/a/\U0010ffff"])) for i in range(400)]
    pages += [(900, None), (901, "no scheme/en/"), (902, ""), (None, "http://net/"), (5, pages[5][1]), (903, "://"), (904, "http://a..net/x"), (905, "http://net:80/"), (906, "x\nhttp://org/fr/")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("mine"))
    for own in (rules, RULES):
        out = urls.filtered(df, rules=urls.rule_table(spark, own)).collect()
        assert all(r.row.host == "mine" for r in out)
        assert sorted(str((r.row.page_id, r.host, r.path, r.rule, r.verdict)) for r in out) == sorted(str((i, *brute(u, own))) for i, u in pages)


def test_no_rules_no_pages(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert [r.verdict for r in urls.filtered(pages, rules=none, default="block").collect()] == ["block"]
    assert urls.filtered(pages.limit(0)).count() == 0
