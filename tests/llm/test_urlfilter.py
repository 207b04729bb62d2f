from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import urlfilter as U

URLS = [None, "", "no scheme", "http://A.Example.NET/en/1", "http://example.net/en/", "http://example.net", "http://example.net/", "http://notexample.net/en/x", "https://x.org/fr/1?a=/de/", "https://x.org/FR/1", "http://b.example.com/de/2#top", "http://example.com?x=/de/", "a://b://c/d", "http://x.net:80/y", "x\ny://h.org/fr/z\nw"]


def brute(url):
    """Host, path and rule by the contract's words."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for _, r in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
    return host, path, max(fits, key=len, default=None)


def test_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = U.judge(pages.selectExpr("*", "1 AS host", "2 AS rule", "3 AS n"), U.page_outcomes(pages, labels)).collect()
    verdicts = {r: v for v, r in U.RULES}
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, rule = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == verdicts.get(rule, "allow")


def test_reputation(spark):
    """Bad hosts go, good and unknown ones stay; a host without labels takes after its domain."""
    rows = [(f"http://bad.spam.com/{i}", 0) for i in range(60)] + [(f"http://w{i % 20}.spam.com/{i}", 0) for i in range(200)] + [(f"http://h{i % 30}.fine.com/{i}", 1) for i in range(900)] + [("http://new.spam.com/1", None), ("http://new.fine.com/1", None), ("http://other.org/", None)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, bool(g)) for i, (_, g) in enumerate(rows) if g is not None], "page_id long, good boolean")
    got = {rows[r.page_id][0]: (r.verdict, r.bound) for r in U.judge(pages, outcomes, rules=()).collect()}
    assert got["http://bad.spam.com/0"][0] == "block" and got["http://new.spam.com/1"][0] == "block"
    assert got["http://h1.fine.com/1"][0] == "allow" and got["http://new.fine.com/1"][0] == "allow"
    assert got["http://bad.spam.com/0"][1] < got["http://new.fine.com/1"][1]


def test_names_and_domains(spark):
    cases = [("a.b.example.com", "example.com", "com"), ("www.shop.co.uk", "shop.co.uk", "co.uk"), ("shop.co.uk", "shop.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("1.2.3.4", "1.2.3.4", "[]"), ("1.2.3.4:80", "1.2.3.4", "[]"),
             ("[::1]:8080", "[::1]", "[]"), ("me@x.org:443", "x.org", "org"), ("x.org.", "x.org", "org"), ("local", "local", "local"), ("", "", "")]
    df = spark.createDataFrame([(h,) for h, _, _ in cases], "host string")
    assert [(r.host, r.d, r.s) for r in df.select("host", U.domain_of(F.col("host")).alias("d"), U.suffix_of(F.col("host")).alias("s")).collect()] == cases


def test_the_bound_is_the_quantile(spark):
    """Against a fine sum over the density itself."""
    cases = [(0.6, 0.4), (1.0, 1.0), (2.5, 7.0), (30.0, 4.0), (0.8, 200.0), (5000.0, 1500.0), (1e6, 2e5), (900.0, 1.0)]
    df = spark.createDataFrame(cases, "a double, b double")
    for r in df.select("a", "b", U.upper_bound(F.col("a"), F.col("b")).alias("x")).collect():
        mean, sd = r.a / (r.a + r.b), math.sqrt(r.a * r.b) / (r.a + r.b) / math.sqrt(r.a + r.b + 1)
        t = np.linspace(max(0.0, mean - 14 * sd), min(1.0, mean + 14 * sd), 2_000_001)
        t = (t[1:] + t[:-1]) / 2
        w = np.exp((r.a - 1) * np.log(t / mean) + (r.b - 1) * np.log((1 - t) / (1 - mean)))
        want = t[np.searchsorted(np.cumsum(w), 0.95 * w.sum())]
        assert abs(r.x - want) < 0.02 * sd + 1e-3 * (min(r.a, r.b) < 1), (r.a, r.b, r.x, want)


def test_documents_that_urls_name(spark):
    urls = ["http://a.com/en/12", "http://a.com/en/12.html?x=3", "http://a.com/7/8", "http://a.com/en/x12", "http://12.com/", None, "http://a.com/fr/9#4"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r.d for r in df.orderBy("page_id").select(U.document_of(F.col("url")).alias("d")).collect()]
    assert got == [12, 12, 7, None, None, None, 9]
    labels = spark.createDataFrame([(12, 1, 0), (12, 1, 1), (7, 1, None), (9, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.page_id: r.good for r in U.page_outcomes(df, labels).collect()} == {0: False, 1: False, 2: True, 6: False}


def test_labels_move_verdicts_on_the_whole_table(spark, sf_dir):
    """On the actual pages: where the labels of two hosts' documents are bad, their pages without a rule are blocked, and no others."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = U.judge(pages, pages.selectExpr("page_id", "true good").limit(0), rules=()).collect()
    count = Counter(r.host for r in rows)
    bad = {h for h, _ in count.most_common(2)}
    outcomes = spark.createDataFrame([(r.page_id, r.host not in bad) for r in rows], "page_id long, good boolean")
    assert {r.host for r in U.judge(pages, outcomes, rules=()).collect() if r.verdict == "block"} == bad


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    out = U.judge(pages, spark.createDataFrame([], "page_id long, good boolean"))
    assert out.count() == 0
    twice = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id long, url string")
    got = U.judge(twice, spark.createDataFrame([(1, True), (None, False)], "page_id long, good boolean"))
    assert got.count() == 3 and got.filter(F.col("verdict") == "allow").count() == 3


def test_clashing_columns_and_long_urls(spark):
    long = "http://" + "a." * 3_000 + "example.net/en/" + "x" * 300_000
    rows = [(1, long, "h", "p", True, 0.5, 3), (2, "http://b.com/" + "%41" * 50_000, None, None, None, None, None), (3, None, "h", "p", False, 0.1, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, good boolean, bound double, pages long")
    got = {r.page_id: r for r in U.judge(pages, spark.createDataFrame([(1, False), (2, True)], "page_id long, good boolean")).collect()}
    assert (got[1].rule, got[1].verdict, len(got[1].path)) == ("example.net/en/", "allow", 300_004)
    assert (got[2].host, got[2].rule, got[2].verdict, got[3].host, got[3].path) == ("b.com", None, "allow", "", "")
    assert set(got[1].asDict()) == {"page_id", "host", "path", "rule", "verdict", "bound"}
