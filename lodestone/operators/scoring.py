"""Scores of search results and sources, and what follows from them for fetching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.functions.text import bind, casefold, coverage, meaningful
from lodestone.plans import questions as P

# Words that a term also stands for, kinds that count as primary, words of intent that name no subject.
ALIASES = {"mcp": ["model", "context", "protocol"], "sdk": ["software", "development", "kit"], "wal": ["write", "ahead", "log"]}
PRIMARY = ("official_documentation", "primary_institution", "source_repository")
GENERIC = "documentation find github official page reference repository source website".split()
SPAM = ("best", "top 10", "ultimate guide")


def expanded(terms: Column) -> Column:
    extra = [F.when(F.array_contains(terms, k), F.lit(v)).otherwise(F.array().cast("array<string>")) for k, v in ALIASES.items()]
    return F.array_distinct(F.concat(terms, *extra))


def result_score(question: Column, title: Column, snippet: Column, url: Column, search_score: Column, engines: Column, subject: Column | None = None) -> Column:
    """0 to 1: overlap, backend score, anchors, engine agreement and kind of source, less penalties; four digits.

    subject: P.subject(question), where rows share a question and it has been made once for all of them.
    """

    def score(r: Column) -> Column:
        overlap = F.greatest(coverage(r["terms"], r["hay"]), coverage(expanded(r["terms"]), r["hay"]))
        anchored = F.when(F.size(r["anchors"]) > 0, F.lit(0.20) * r["found"] - F.lit(0.18) * (1 - r["found"])).otherwise(F.lit(0.0))
        agreement = F.least(F.lit(0.15), F.lit(0.04) * F.greatest(F.lit(0), F.size(engines) - 1))
        kind = F.when(r["authority"], F.lit(0.22)).when(r["kind"].isin(*PRIMARY) & (overlap >= 0.25), F.lit(0.06)).otherwise(F.lit(0.0))
        spam = sum((F.contains(casefold(title), F.lit(w)).cast("int") for w in SPAM), F.lit(0))
        total = F.lit(0.42) * overlap + F.lit(0.20) * search_score + anchored + agreement + kind - F.when(spam >= 2, F.lit(0.18)).otherwise(F.lit(0.0))
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)

    words = meaningful(F.concat_ws(" ", title, snippet, U.host(url), F.translate(U.path(url), "/", " ")))
    view = lambda s: F.struct(
        s["terms"].alias("terms"), F.array_distinct(words).alias("hay"), s["anchors"].alias("anchors"), P.anchor_coverage(s["anchors"], F.concat_ws(" ", title, snippet, url)).alias("found"),
        F.coalesce(P.within_authority(s, url), F.lit(False)).alias("authority"), U.source_type(url).alias("kind"),
    )
    if subject is not None:
        return bind(view(subject), score)
    return bind(P.subject(question), lambda s: bind(view(s), score))


def freshness(published: Column, now: Column, time_sensitive: Column) -> Column:
    """Conservative without a date; a stable 0.75 for dated stable facts; else halved after 180 days. now is a parameter."""
    days = F.greatest(F.lit(0), F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(published.cast("timestamp"))) / 86400))
    return F.when(published.isNull(), F.when(time_sensitive, F.lit(0.35)).otherwise(F.lit(0.5))).when(~time_sensitive, F.lit(0.75)).otherwise(F.round(1 / (1 + days / 180), 4))


def source_quality(preliminary: Column, fresh: Column) -> Column:
    return F.round(F.lit(0.65) * preliminary + F.lit(0.35) * fresh, 4)


def base_score(passage: Column, source: Column, quality: Column) -> Column:
    return F.lit(0.45) * passage + F.lit(0.30) * source + F.lit(0.25) * quality


def passage_relevance(question: Column, text: Column, preliminary: Column) -> Column:
    """A passage's absolute relevance for one facet: coverage, prior and anchors; 0 below the required coverage or without any anchor."""

    def score(r: Column) -> Column:
        cov = coverage(r["terms"], r["words"])
        required = F.when(F.size(r["terms"]) <= 2, F.lit(1.0)).otherwise(F.lit(0.34))
        anchored = F.when(F.size(r["anchors"]) > 0, P.anchor_coverage(r["anchors"], text)).otherwise(F.lit(0.0))
        fits = (F.size(r["terms"]) > 0) & (cov >= required) & ((F.size(r["anchors"]) == 0) | (anchored > 0))
        return F.when(fits, F.lit(0.70) * cov + F.lit(0.20) * preliminary * F.least(F.lit(1.0), cov / F.lit(0.60)) + F.lit(0.10) * anchored).otherwise(F.lit(0.0))

    return bind(F.struct(F.array_distinct(meaningful(question)).alias("terms"), meaningful(text).alias("words"), P.anchors(question).alias("anchors")), score)


def source_relevance(passages: DataFrame, by: Sequence[str], question: str, text: str, preliminary: str) -> DataFrame:
    """(by, relevance): the best over facets and passages of each source, at most 1, four digits."""
    scored = passages.withColumn("_s", passage_relevance(F.col(question), F.col(text), F.col(preliminary)))
    return scored.groupBy(*by).agg(F.round(F.least(F.lit(1.0), F.max("_s")), 4).alias("relevance"))


def quality_notes(kind: Column, score: Column, authority: Column, engines: Column, dated: Column) -> Column:
    return F.array(
        F.concat(F.lit("URL/content classification: "), kind), F.concat(F.lit("Pre-fetch query/source score: "), F.format_string("%.4f", score)),
        F.concat(F.lit("Query-aligned authority: "), F.when(authority, "yes").otherwise("no")), F.format_string("Search-engine agreement: %d engine(s)", F.greatest(F.lit(1), F.size(engines))),
        F.when(dated, "Publication or update date available for freshness scoring").otherwise("No reliable publication/update date; conservative freshness score applied"),
    )


def aligned_primary(question: Column, title: Column, snippet: Column, url: Column, score: Column) -> Column:
    """A primary source that speaks to the subject of the question."""

    def judge(r: Column) -> Column:
        subject = F.filter(r["terms"], lambda t: ~t.isin(*GENERIC))
        named = (F.size(subject) == 0) | (F.size(F.array_intersect(subject, r["hit"])) > 0)
        anchored = (F.size(r["anchors"]) == 0) | (P.anchor_coverage(r["anchors"], F.concat_ws(" ", title, snippet)) > 0)
        strong = F.when(r["authority"], score >= 0.30).otherwise((r["kind"] == "primary_institution") & (score >= 0.55))
        return r["kind"].isin(*PRIMARY) & (F.size(r["hit"]) >= F.least(F.lit(2), F.size(r["terms"]))) & named & anchored & strong

    terms = F.array_distinct(meaningful(question))
    hit = F.array_intersect(terms, meaningful(F.concat_ws(" ", title, snippet)))
    return bind(F.struct(terms.alias("terms"), hit.alias("hit"), P.anchors(question).alias("anchors"), U.source_type(url).alias("kind"), F.coalesce(P.matches_authority(question, url), F.lit(False)).alias("authority")), judge)


def best_facet(scored: DataFrame, candidate: Sequence[str], facet_pos: str, score: str) -> DataFrame:
    """The facet with the highest score of each candidate, the first of equals."""
    k = F.row_number().over(Window.partitionBy(*candidate).orderBy(F.desc(score), facet_pos))
    return scored.withColumn("_k", k).filter("_k = 1").drop("_k")


def next_candidate(scored: DataFrame, facet: Sequence[str], overlap: str, terms: str, score: str, preliminary: str, pos: str) -> DataFrame:
    """For each facet the best of its candidates: those with two terms (or all) first, else those with one."""
    tier = F.when(F.col(overlap) >= F.least(F.lit(2), F.col(terms)), 0).when(F.col(overlap) >= 1, 1)
    rows = scored.withColumn("_tier", tier).filter("_tier is not null")
    k = F.row_number().over(Window.partitionBy(*facet).orderBy("_tier", F.desc(score), F.desc(preliminary), pos))
    return rows.withColumn("_k", k).filter("_k = 1").drop("_k", "_tier")


def fetchable_first(rows: DataFrame, failures: DataFrame, key: str, minimum: int, by: Sequence[str], order: str) -> DataFrame:
    """Candidates without a recent failure; failed ones follow only where fewer than `minimum` are left."""
    marked = rows.join(failures.select(key, F.lit(1).alias("_failed")).distinct(), key, "left").withColumn("_failed", F.coalesce("_failed", F.lit(0)))
    marked = marked.withColumn("_healthy", F.sum(1 - F.col("_failed")).over(Window.partitionBy(*by)))
    kept = marked.filter((F.col("_failed") == 0) | (F.col("_healthy") < minimum))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("_failed", order))).drop("_failed", "_healthy")


def retrieval_attempts(outcomes: DataFrame, by: Sequence[str], order: str, useful: str, limit: int) -> DataFrame:
    """Which candidates the adaptive loop attempts, given how each would turn out.

    Batches are as large as what is missing to the target of useful sources, so a batch may overshoot; folded per group over at most `limit` outcomes.
    """
    target = min(limit, max(3, min(8, (limit * 3 + 4) // 5)))
    first = outcomes.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("_p") <= limit)
    rows = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_p", order, useful))).alias("r"))
    # State: useful ones so far, and how many of the running batch are left; a batch is opened when none are.
    start = F.struct(F.lit(0).alias("got"), F.lit(0).alias("left"), F.lit(0).alias("tried"))

    def step(s: Column, x: Column) -> Column:
        opened = F.when(s["left"] > 0, s["left"]).otherwise(F.when(s["got"] < target, F.greatest(F.lit(1), F.lit(target) - s["got"])).otherwise(F.lit(0)))
        go = opened > 0
        # What a batch finds counts when the batch is over.
        return F.when(go, F.struct((s["got"] + F.when(x[useful], 1).otherwise(0)).alias("got"), (opened - 1).alias("left"), (s["tried"] + 1).alias("tried"))).otherwise(F.struct(s["got"].alias("got"), F.lit(0).alias("left"), s["tried"].alias("tried")))

    return rows.withColumn("s", F.aggregate("r", start, step)).select(*by, F.col("s.tried").alias("attempts"), F.col("s.got").alias("useful"), F.size("r").alias("candidates"))
