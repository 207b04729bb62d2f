"""Whole research runs over pages, and reading pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import api
from lodestone.functions import text as X
from lodestone.operators import selection as W
from lodestone.plans.lineage import cut
from lodestone.registry import register
from lodestone.sources.tables import table

from .evidence import scored_sql
from .results import page_results

QUESTION = "erinant thonor ering; the and attion thanedble"


def _run(spark, sf_dir):
    return api.research(spark, QUESTION, page_results(spark, sf_dir).drop("marked"), table(spark, sf_dir, "pages").select("url", "html"))


def research_evidence(spark, sf_dir):
    return _run(spark, sf_dir)["evidence"].select("evidence_id", "source_id", "citation", "relevance", "start_offset", "end_offset")


def research_coverage(spark, sf_dir):
    return _run(spark, sf_dir)["coverage"]


def read_pages(spark, sf_dir):
    return api.read_pages(table(spark, sf_dir, "pages"), "page_id", "the and attion thanedble").select("page_id", "rank", "start_offset", "end_offset", "score")


FACETS = ["erinant thonor ering", "the and attion", "the of thanedble"]
ASKED = ["eriner attion", "thanea anea thanedble", "der", "nicht aulich", "attion", "was"]


def _candidates(spark, sf_dir):
    return api.candidates(page_results(spark, sf_dir).drop("marked").withColumn("question", F.col("pos") % 5), FACETS, api.Options())


def preferred_candidates(spark, sf_dir):
    """Every eight results are one question's; its first six are the exact results of its six facets."""
    scored = page_results(spark, sf_dir).drop("marked").withColumn("question", F.floor(F.col("pos") / 8))
    rows = api.graded(scored, ASKED).withColumn("key", F.col("url"))
    return W.preferred(rows, ["question"], len(ASKED)).withColumn("preferred", F.col("preferred").cast("int"))


def fetch_selection(spark, sf_dir):
    found = cut(_candidates(spark, sf_dir).select("question", "pos", "key", "domain", "kind", "preliminary", "scores", "fits"))
    chosen = W.preferred(found, ["question"], len(FACETS))
    rows = cut(found.join(chosen, ["question", "key"], "left"))
    return W.fetch_order(rows, ["question"], 8, len(FACETS))


def research_rounds(spark, sf_dir):
    """Each query finds the pages that share two of its words."""
    results = page_results(spark, sf_dir).drop("marked").withColumn("_w", X.meaningful(F.concat_ws(" ", "title", "snippet")))

    def search(queries):
        hit = F.lit(False)
        for q in queries:
            terms = sorted(set(X.meaningful_py(q)))
            hit = hit | (F.size(F.array_intersect("_w", F.lit(terms) if terms else F.array().cast("array<string>"))) >= 2)
        return results.filter(hit).drop("_w")

    got = api.research_rounds(spark, QUESTION, search, table(spark, sf_dir, "pages").select("url", "html"))
    return got["rounds"].crossJoin(F.broadcast(got["coverage"].select("score", "status")))


register("research_rounds", ("Q10", "W10", "S1"), research_rounds)
register("research_evidence", ("S1", "W4", "W5", "R1", "R2", "A7", "Z6"), research_evidence)
register("research_coverage", ("A6",), research_coverage)
register("read_pages", ("P3", "H2", "W4"), read_pages)
register("fetch_selection", ("W6",), fetch_selection)
register("preferred_candidates", ("J8",), preferred_candidates, f"""
WITH RECURSIVE {scored_sql({str(i): f for i, f in enumerate(ASKED)})},
p AS (SELECT page_id AS pos, url AS key, page_id // 8 AS question, row_number() OVER (PARTITION BY page_id // 8 ORDER BY page_id) AS k FROM pages),
x AS (SELECT question, facet, list({{'key': key, 'k': k, 'score': score}} ORDER BY score DESC, k) AS ranked FROM p JOIN scored USING (pos)
    WHERE k <= {len(ASKED)} AND len(list_intersect(terms, content)) >= least(2, len(terms)) AND score >= {W.LEAST} GROUP BY ALL),
f AS (SELECT DISTINCT question, -1 AS facet, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS key FROM p
    UNION ALL SELECT question, turn, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best) END, best FROM
    (SELECT f.question, f.facet + 1 AS turn, taken, list_filter(ranked, lambda r: NOT list_contains(taken, r.key))[1].key AS best
        FROM f LEFT JOIN x ON x.question = f.question AND x.facet = f.facet + 1 WHERE f.facet < {len(ASKED) - 1}))
SELECT question, key, CAST(facet AS INTEGER) AS preferred FROM f WHERE key IS NOT NULL""")
