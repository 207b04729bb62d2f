"""Searches over stored results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.plans.lineage import cut, shared_folder
from lodestone.registry import register
from lodestone.sources.backend import StoredResults

from . import duck as D
from .results import RESULTS, page_results

CATEGORIES = ["general", "it", "science"]


def stored_search(spark, sf_dir):
    """Each host's pages, a hundred ids at a time, as what was found for a query; every query is searched in its own category and in the next one, every other one wants recent results only."""
    p = page_results(spark, sf_dir).withColumn("asked", F.concat_ws(" ", U.host("url"), F.floor(F.col("pos") / 100)))
    item = F.struct("url", "title", F.col("snippet").alias("content"), F.get("engines", F.lit(0)).alias("engine"), F.when(F.col("pos") % 3 == 0, "2024-03-05").when(F.col("pos") % 3 == 1, "2023-01-01").alias("publishedDate"))
    category = lambda n: F.get(F.lit(CATEGORIES), (n % len(CATEGORIES)).cast("int"))
    payloads = p.groupBy(F.col("asked").alias("query"), category(F.length("asked")).alias("category")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("i")))), lambda x: x["i"])).alias("payload"))  # at most a hundred results
    table = StoredResults(spark, f"{shared_folder(spark)}/results-{uuid.uuid4().hex}")
    table.write(payloads, 100)
    asked = payloads.select("query").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), "query")
    asked = asked.select(F.concat_ws("/", "query", "n").alias("search_id"), "query", category(F.length("query") + F.col("n")).alias("category"), F.when(F.length("query") % 2 == 0, F.to_timestamp(F.lit("2024-01-01"))).alias("since"))
    found = cut(table.search_all(asked, 10).select("search_id", "rank", "url", "title", F.date_format("published_at", "yyyy-MM-dd").alias("published"), F.round("search_score", 4).alias("search_score")))
    table.drop()  # what was found is checkpointed
    return found


register("stored_search", ("S1", "S4", "S5"), stored_search, f"""
WITH {RESULTS}, h AS (SELECT *, concat_ws(' ', {D.host('url')}, pos // 100) AS asked FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY pos) AS rank, CASE pos % 3 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '2023-01-01' END AS published FROM h)
SELECT asked || '/0' AS search_id, CAST(rank AS INTEGER) AS rank, url, title, published, round(greatest(0.0, 1 - (rank - 1) / 20), 4)::DOUBLE AS search_score
FROM k WHERE rank <= 10 AND (length(asked) % 2 = 1 OR published >= '2024-01-01')""")
