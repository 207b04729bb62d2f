"""Scans of pages as bytes: each page of the table is answered with a status, a type, a charset and redirects by its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.registry import register
from lodestone.sources import scan as C
from lodestone.sources.tables import table

#: Types that servers name, by page_id % 7; the first two bodies are UTF-16, the third is decoded as ASCII.
TYPES = ["text/html; charset=UTF-16LE", 'TEXT/HTML;Charset="utf-16le"', "text/html; charset=us-ascii", "image/png", None, "text/plain; charset=none-such", "application/xhtml+xml"]


def _responses(spark, sf_dir):
    """Every tenth page answers after 0 to 6 redirects, every 13th with 404."""
    p = table(spark, sf_dir, "pages").filter("url is not null").groupBy(F.regexp_replace("url", "(?s)#.*$", "").alias("_at")).agg(F.min(F.struct("page_id", "url", "html")).alias("_f")).select("_f.*")  # pages can share a URL
    last = F.when(F.col("page_id") % 10 == 0, F.floor(F.col("page_id") / 10) % 7).otherwise(0).cast("int")
    p = p.withColumn("last", last).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last"))))
    end, kind = F.col("k") == F.col("last"), F.get(F.lit(TYPES), (F.col("page_id") % 7).cast("int"))
    moved = lambda k: F.concat(F.lit("/moved/"), F.col("page_id"), F.lit("/"), k)
    return p.select(
        F.when(F.col("k") == 0, F.col("url")).otherwise(F.concat(U.scheme("url"), F.lit("://"), U.authority("url"), moved(F.col("k")))).alias("url"),
        F.when(~end, 302).when(F.col("page_id") % 13 == 5, 404).otherwise(200).alias("status"), F.when(~end, moved(F.col("k") + 1)).alias("location"), kind.alias("content_type"),
        F.create_map(F.lit("ETag"), F.col("page_id").cast("string"), F.lit("Server"), F.lit("any")).alias("headers"),
        F.when(end, F.when(F.col("page_id") % 7 < 2, F.encode("html", "UTF-16LE")).otherwise(F.encode("html", "UTF-8"))).alias("body"),
    )


def page_scan(spark, sf_dir):
    asked = table(spark, sf_dir, "pages").select("page_id", "url")
    pages, _ = C.scan(asked, _responses(spark, sf_dir), "page_id")
    return pages.select("page_id", "hops", "status", "content_type", F.col("headers")["etag"].alias("etag"), F.size("headers").alias("n_headers"), F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


_ANSWERS = """p AS (SELECT page_id, min(page_id) OVER (PARTITION BY regexp_replace(url, '#.*$', '', 's')) AS first FROM pages WHERE url IS NOT NULL),
a AS (SELECT p.page_id, first, html, first % 7 AS kind, CASE WHEN first % 10 = 0 THEN CAST(first // 10 % 7 AS INTEGER) ELSE 0 END AS last FROM p JOIN pages AS f ON f.page_id = first)"""

register("page_scan", ("S6",), page_scan, rf"""
WITH {_ANSWERS}, t AS (SELECT page_id, first, last AS hops, kind, CASE WHEN kind <> 2 THEN coalesce(html, '') ELSE
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '[\x{{0800}}-\x{{FFFF}}]', repeat(chr(65533), 3), 'g'), '[\x{{0080}}-\x{{07FF}}]', repeat(chr(65533), 2), 'g'), '[\x{{10000}}-\x{{10FFFF}}]', repeat(chr(65533), 4), 'g') END AS text
  FROM a WHERE last <= 4 AND first % 13 <> 5 AND kind NOT IN (3, 4))
SELECT page_id, hops, 200 AS status, CASE kind WHEN 5 THEN 'text/plain' WHEN 6 THEN 'application/xhtml+xml' ELSE 'text/html' END AS content_type, CAST(first AS VARCHAR) AS etag, 1 AS n_headers,
  CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS text_sha256 FROM t""")


def page_scan_failures(spark, sf_dir):
    asked = table(spark, sf_dir, "pages").select("page_id", "url")
    _, failures = C.scan(asked, _responses(spark, sf_dir), "page_id")
    return failures.select("page_id", "hops", "status", "error")


register("page_scan_failures", ("S6", "A5"), page_scan_failures, f"""
WITH {_ANSWERS} SELECT page_id, least(last, 4)::INTEGER AS hops, CASE WHEN last > 4 THEN 302 WHEN first % 13 = 5 THEN 404 ELSE 200 END AS status,
  CASE WHEN last > 4 THEN 'TooManyRedirects' WHEN first % 13 = 5 THEN 'HttpStatus' ELSE 'UnsupportedType' END AS error FROM a WHERE last > 4 OR first % 13 = 5 OR kind IN (3, 4)""")
