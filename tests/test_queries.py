"""Every query of the engine: against its SQL where it has one, else that it gives rows of a stable schema."""

from __future__ import annotations

import pytest

from lodestone import registry
from tests.compare import same

SLOW = {"research_evidence", "research_coverage", "research_rounds"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_gives_rows(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    assert len(df.columns) == len(set(df.columns)) > 0
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_research(spark, sf_dir):
    from lodestone import api
    from lodestone.queries.research import QUESTION
    from lodestone.queries.results import page_results

    got = api.research(spark, QUESTION, page_results(spark, sf_dir).drop("marked"), spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html"))
    evidence, sources = got["evidence"].collect(), {s.source_id for s in got["sources"].collect()}
    assert evidence and all(e.source_id in sources and e.citation == f"[{e.source_id}, {e.evidence_id}]" for e in evidence)
    assert all(sum(x.source_id == e.source_id for x in evidence) <= 2 for e in evidence)
    assert got["coverage"].count() == 1
    with pytest.raises(ValueError):
        api.Options(max_sources=99)
    with pytest.raises(ValueError):
        api.clear(got["evidence"], ["x"], confirm=False)


def test_research_in_rounds(spark, sf_dir):
    """Later rounds ask for what is missing, bring results that the first had not, and end when they bring none."""
    from lodestone import api
    from lodestone.queries.results import page_results

    every, pages, calls = page_results(spark, sf_dir).drop("marked").cache(), spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html"), []

    def search(queries):
        calls.append(list(queries))
        return every.filter(f"pos % 7 = {min(len(calls), 3)}")

    got = api.research_rounds(spark, "erinant thonor ering; what about zzyzx quux", search, pages, api.Options(mode="deep"))
    rounds = [(r["round"], r.query) for r in got["rounds"].collect()]
    assert [[q for k, q in rounds if k == i] for i in range(1, len(calls) + 1)] == calls
    assert 3 <= len(calls) <= 4  # the third and fourth search find the same
    topics = [r.topic for r in got["missing"].collect()]
    assert any("zzyzx" in t for t in topics) and all(any(t in q for q in calls[-1]) for t in topics)
    assert api.research_rounds(spark, "erinant thonor ering", search, pages, api.Options(mode="quick"))["rounds"].agg({"round": "max"}).first()[0] == 1


def test_pages_are_read_until_enough_are_useful(spark, sf_dir):
    """With one facet, batches of what is missing to the target; by a loop over how each page turned out."""
    from lodestone import api
    from lodestone.queries.results import page_results

    results, pages = page_results(spark, sf_dir).drop("marked"), spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html")
    options = api.Options(mode="deep", max_sources=20)
    got = api.research(spark, "erinant thonor ering thanedble", results, pages, options)
    sources = {r.position: r.relevance for r in got["sources"].collect()}
    lost = sum(r["count"] for r in got["failures"].collect())
    assert got["plan"].first().facets == ["erinant thonor ering thanedble"]
    limit = 20  # of the budget's 25 pages, the sources asked for
    target, useful, tried = min(limit, max(3, min(8, (limit * 3 + 4) // 5))), 0, 0
    while tried < len(sources) + lost and useful < target:
        batch = range(tried + 1, min(limit, tried + max(1, target - useful)) + 1)
        useful, tried = useful + sum(sources.get(i, 0) >= 0.18 for i in batch), tried + len(batch)
    assert len(sources) + lost == min(tried, limit) and set(sources) <= set(range(1, tried + 1))
    assert {r.source_id for r in got["evidence"].collect()} <= {r.source_id for r in got["sources"].collect()}
