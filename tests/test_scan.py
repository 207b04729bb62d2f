"""Scans of pages as bytes against plain loops."""

from __future__ import annotations

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from lodestone.sources import scan as C
from lodestone.sources.pages import CONTENT_TYPES

RESPONSE = "url string, status int, location string, content_type string, headers map<string,string>, body binary"
TEXT = "Café – naïve 中文 😀 " * 3


def test_decode():
    assert C.decode(TEXT.encode(), "utf-8") == TEXT and C.decode(TEXT.encode("utf-16-le"), "UTF-16LE") == TEXT and C.decode(None, None) == ""
    assert C.decode("é".encode("latin-1"), None) == "�" and C.decode("é".encode("latin-1"), "latin-1") == "é"
    # What is no charset of text gives UTF-8.
    for name in ("none-such", "base64", "idna", "undefined", "x" * 5_000):
        assert C.decode("é".encode(), name) == "é"
    assert C.decode(b"\xd8\x00a", "utf-16-be").startswith("�") and "\ud800" not in C.decode(b"+2AA-", "utf-7")
    page = '<html><head><meta charset="windows-1252"></head>é'.encode("cp1252")
    assert C.decode(page, None, True).endswith("é") and C.decode(page, None).endswith("�")
    assert C.decode(page, "latin-1", True).endswith("é")  # the header wins
    assert C.decode("é".encode("utf-16"), None, True) == "é" and C.decode("é".encode("utf-8-sig"), None, True) == "é"
    assert C.decode(b" " * 1_024 + b'<meta charset="latin-1">\xe9', None, True).endswith("�")  # declared too late


def _looped(url, stored, most):
    """Final URL, hops and error or text of one request, step by step."""

    def unsafe(u):
        return not u.startswith("http") or "//10." in u or "localhost" in u

    hops = 0
    if url is None or unsafe(url):
        return url, 0, C.UNSAFE
    while True:
        r = stored.get(url.split("#")[0])
        if r is None:
            return url, hops, C.NOT_STORED
        _, status, location, kind, _, body = r
        if status in C.REDIRECTS:
            if not location:
                return url, hops, C.NO_TARGET
            if hops == C.MAX_REDIRECTS:
                return url, hops, C.TOO_MANY
            to = urljoin(url, location)
            if unsafe(to):
                return url, hops, C.UNSAFE
            url, hops = to, hops + 1
            continue
        if status is None or not 200 <= status < 300:
            return url, hops, C.STATUS
        if (kind or "").split(";")[0].strip().lower() not in CONTENT_TYPES:
            return url, hops, C.TYPE
        if len(body or b"") > most:
            return url, hops, C.SIZE
        return url, hops, (body or b"").decode("latin-1" if "latin" in kind else "utf-8", "replace")


def test_scan_is_the_loop(spark):
    rng, most = random.Random(7), 300
    urls = [f"https://a{i % 7}.example.org/p/{i}" for i in range(160)]
    targets = [*urls, "/p/3", "../p/10", "?x=1", "", None, "http://10.0.0.1/x", "http://localhost/", "ftp://a.example.org/", "https://gone.example.org/"]
    stored = {}
    for u in urls:
        status = rng.choice([200, 200, 204, 301, 302, 303, 307, 308, 308, 404, 500, None])
        kind = rng.choice(["text/html", "Text/HTML ; charset=latin-1", "text/plain; charset=utf-8", "image/png", None, "application/ld+json"])
        stored[u] = (u, status, rng.choice(targets), kind, {"ETag": u, "Server": "x"} if rng.random() < 0.7 else None, rng.choice([None, b"", TEXT.encode(), TEXT.encode("latin-1", "replace"), b"\xff" * 300, b"a" * 301]))
    # A loop of redirects, a chain that is just short enough and one that is too long; many that lead to one page.
    for k in range(6):
        stored[f"https://c.example.org/{k}"] = (f"https://c.example.org/{k}", 302 if k < 5 else 200, f"/{k + 1}", "text/html", None, b"end")
    stored["https://c.example.org/loop"] = ("https://c.example.org/loop", 301, "https://c.example.org/loop#again", "text/html", None, None)
    for k, location in enumerate(["", None]):
        stored[f"https://n.example.org/{k}"] = (f"https://n.example.org/{k}", 303, location, None, None, None)
    asked = ["https://n.example.org/0", "https://n.example.org/1", *urls, *urls[:20], *(f"https://c.example.org/{k}" for k in range(6)), "https://c.example.org/loop", "https://c.example.org/5#part", None, "", "http://10.1.2.3/", "https://other.example.org/", *["https://c.example.org/4"] * 50]
    rows = spark.createDataFrame(list(enumerate(asked)), "id long, url string").withColumn("status", F.lit("clashes")).withColumn("_to", F.lit(1))
    pages, failures = C.scan(rows, spark.createDataFrame(list(stored.values()), RESPONSE).withColumn("text", F.lit("clashes")), "id", most=most)
    got = {r["id"]: (r.final_url, r.hops, r["text"]) for r in pages.collect()} | {r["id"]: (r.final_url, r.hops, r["error"]) for r in failures.collect()}
    want = {i: _looped(u, stored, most) for i, u in enumerate(asked)}
    assert got == want
    assert {e for *_, e in want.values()} >= {C.UNSAFE, C.NO_TARGET, C.TOO_MANY, C.NOT_STORED, C.STATUS, C.TYPE, C.SIZE}
    held = {k for r in pages.select("headers").collect() for k in r.headers}
    assert held == {"etag"}


def test_scan_of_nothing(spark):
    none = spark.createDataFrame([], RESPONSE)
    pages, failures = C.scan(spark.createDataFrame([(1, "https://a.example.org/")], "id long, url string"), none, "id")
    assert pages.collect() == [] and [r.error for r in failures.collect()] == [C.NOT_STORED]
    pages, failures = C.scan(spark.createDataFrame([], "id long, url string"), none, "id")
    assert pages.collect() == failures.collect() == []


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.html").write_bytes(TEXT.encode())
    (tmp_path / "deep" / "b.html").write_bytes('<meta charset="latin-1">é'.encode("latin-1"))
    (tmp_path / "empty.html").write_bytes(b"")
    (tmp_path / "large.html").write_bytes(b"a" * 301)
    (tmp_path / "c.txt").write_bytes(b"other")
    read, large = C.files(spark, str(tmp_path), "*.html", most=300)
    assert {r.path.rsplit("/", 1)[1]: r["text"] for r in read.collect()} == {"a.html": TEXT, "b.html": '<meta charset="latin-1">é'}  # no row for the empty file
    assert [(r.path.rsplit("/", 1)[1], r["size"], r.error) for r in large.collect()] == [("large.html", 301, C.SIZE)]
    plan = spark._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    assert "LessThanOrEqual(length,300)" in plan
    assert "content" not in large._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
