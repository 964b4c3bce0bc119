"""Url parts, rules and shrinkage."""

import re

from pyspark.sql import functions as F

from scorelens.llm.url_reputation import host_reputation, judge_urls
from scorelens.llm.url_reputation_query import RULES, bad_page


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host):], maxsplit=1)[0]


def test_parts_and_rules_equal_a_plain_parser(spark):
    urls = [None, "", "nothing", "http://", "http://x.net", "http://NET/", "https://a.b.net/x?q=://z", "http://Example.NET/en/1#t", "ftp://w.example.net/EN/",
            "http://notexample.net/en/", "http://example.com/de/a", "http://www.example.com/de", "http://k.org/fr/", "http://ÄB.org/fr/é?x", "a://b://c/d",
            "http://h?a/b", "http://h#a/b", "http://host\n.org/fr/\nx", "http://x.net//y", "http://org/fr/x" + "y" * 20000]
    pages = spark.createDataFrame([(i, u, "<p>", "z", 1) for i, u in enumerate(urls)] * 2, "page_id long, url string, html string, host string, rate int")
    got = judge_urls(pages, RULES, bad_page()).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        host, path = parts(urls[r.page_id])
        fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((max(fits)[1], max(fits)[2]) if fits else (None, "allow")), r


def test_shrinkage_follows_the_chain(spark):
    rows = [("bad.site.com", 1)] * 60 + [("bad.site.com", 0)] * 2 + [("new.site.com", 1)] + [("good.org", 0)] * 400 + [("one.org", 1)] + [("x", None)]
    got = {r.host: r for r in host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert "x" not in got
    assert got["bad.site.com"].lower > 0.7
    assert got["new.site.com"].rate > got["one.org"].rate  # its domain is bad
    assert got["good.org"].rate < 0.05 and got["one.org"].lower < 0.2


def test_nulls_and_no_rows(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "http://a.com/", None)], "page_id long, url string, html string")
    assert {(r.page_id, r.verdict, r.bad_rate) for r in judge_urls(pages, RULES, bad_page()).collect()} == {(None, "allow", None), (1, "allow", None)}
    assert judge_urls(pages.limit(0), RULES, bad_page()).collect() == []
    assert pages.select(bad_page().alias("b")).filter(F.col("b").isNotNull()).count() == 0
