import random

from pyspark.sql import functions as F

from ballast.llm.url_filter import cascade, filter_urls, is_listed


def judge(url, rules, default="allow"):
    """Brute force over all rules."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    rule = sorted(fits, key=lambda f: (-len(f[0]), f[0]))[0][0]
    return host, path, rule, "block" if any(v == "block" for r, v in fits if r == rule) else "allow"


URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?q#f", "http://example.org", "http://example.org/en/12", "https://b.com/de/",
        "https://b.com?/de/", "https://com/fr/x", "ftp://x..com/de/a://b", "http://notexample.org/es/", "http://é.com/de/É#", "http://org/", "http://.org/"]


def test_against_brute_force_with_odd_urls(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
             ("block", "com", "/de/"), ("allow", "com", "/de/"), ("block", "b.com", "")]
    urls = URLS + ["http://" + "a." * 3000 + "com/de/" + "x" * 5000]
    pages = spark.createDataFrame([(i, u, "other") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, rules).collect()}
    assert got == {(i, *judge(u, rules)) for i, u in enumerate(urls)}
    assert filter_urls(pages, rules).count() == 2 * len(urls)


def test_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(pages, [("block", "com", "/")]).collect() == []
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert filter_urls(one, []).collect()[0].verdict == "allow"


def test_cascade_of_many_levels_is_exact_over_its_universe(spark):
    rng = random.Random(1)
    keys = [(f"k{i}", rng.random() < 0.2) for i in range(4000)]
    frame = spark.createDataFrame(keys, "key string, listed boolean")
    levels = cascade(frame)
    assert len(levels) > 2
    got = frame.withColumn("found", is_listed(F.col("key"), levels))
    assert got.where("found <> listed").count() == 0
