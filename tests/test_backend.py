"""Searches over stored results: rows as a loop finds them, and bounds that reach the scan."""

from __future__ import annotations

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from lodestone.sources.backend import StoredResults

NOW = dt.datetime(2024, 3, 10)


def made(seed=1):
    r = random.Random(seed)
    date = lambda: r.choice((None, "not a date", "2024-03-09T12:00:00", "2024-02-20", "2023-06-01", "2020-01-01"))
    out = [(q, c, json.dumps([{"url": f"https://{q}.example/{c}/{i}", "title": f"t{i}", "publishedDate": date()} for i in range(r.randrange(40))])) for q in [f"query {n}" for n in range(30)] for c in ("general", "news")]
    return [*out, (None, "general", "[]"), ("lost", None, '[{"url": "x"}]'), ("empty", "general", "[]"), ("broken", "general", "{"), ("none", "general", None)]


def looped(payloads, queries, categories, since, limit):
    for q, c, p in payloads:
        if q in queries and c in categories and p and p != "{":
            for i, x in enumerate(json.loads(p)[:limit]):
                day = x["publishedDate"] if x["publishedDate"] and x["publishedDate"][0] == "2" else None
                if since is None or (day and dt.datetime.fromisoformat(day) >= since):
                    yield q, c, i, x["url"]


def test_search_is_the_loop_and_its_bounds_reach_the_scan(spark, tmp_path):
    payloads, table = made(), StoredResults(spark, str(tmp_path / "t"), 8)
    table.write(spark.createDataFrame(payloads, "query string, category string, payload string").withColumns({"url": F.lit("clashes"), "bucket": F.lit(7)}), files=2)
    for queries, categories, recency, limit in ((["query 3", "query 4"], ["general"], None, 20), (["query 3", "broken", "none", "never"], ["general", "news"], "month", 5), (["query 9"], ["news"], "day", 100), ([], ["news"], None, 5)):
        got = table.search(queries, categories, recency, NOW, limit)
        since = NOW - dt.timedelta(days={"day": 1, "month": 31}[recency]) if recency else None
        assert sorted((r["query"], r.category, r.place, r.url) for r in got.collect()) == sorted(looped(payloads, queries, categories, since, limit))
    plan = spark._jvm.PythonSQLUtils.explainString(table.search(["query 3"], ["news"], "month", NOW, 5)._jdf.queryExecution(), "formatted")
    filters = {k: next(x for x in plan.splitlines() if x.startswith(k)) for k in ("PartitionFilters", "PushedFilters")}
    assert "category" in filters["PartitionFilters"] and "bucket" in filters["PartitionFilters"]
    assert all(x in filters["PushedFilters"] for x in ("EqualTo(query,query 3)", "LessThan(place,5)", "GreaterThanOrEqual(published_at"))


def test_tables_of_searches(spark, tmp_path):
    payloads, table = made(2), StoredResults(spark, str(tmp_path / "t"), 8)
    table.write(spark.createDataFrame(payloads, "query string, category string, payload string"))
    asked = [(n, f"query {n % 35}" if n % 11 else None, "news" if n % 2 else "general", dt.datetime(2024, 1, 1) if n % 3 else None) for n in range(80)]
    got = table.search_all(spark.createDataFrame(asked, "search_id int, query string, category string, since timestamp"), 7).collect()
    want = [(n, *row) for n, q, c, since in asked for row in looped(payloads, [q] if q else [], [c], since, 7)]
    assert sorted((r.search_id, r["query"], r.category, r.place, r.url) for r in got) == sorted(want) and len(want) > 100
