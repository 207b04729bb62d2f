"""The calls that a user makes: research over stored results and pages, reading pages, exact results, clearing, reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import urls as U
from lodestone.operators import evidence as V
from lodestone.operators import metrics as M
from lodestone.operators import near as N
from lodestone.operators import rank as R
from lodestone.operators import response as Q
from lodestone.operators import results as S
from lodestone.operators import scoring as C
from lodestone.operators import selection as W
from lodestone.plans import questions as P
from lodestone.plans.batches import dealt
from lodestone.plans.lineage import cut
from lodestone.sources import pages as G
from lodestone.sources.tables import delete


@dataclass(frozen=True)
class Options:
    """Bounds are checked when an object is made."""

    mode: str = "auto"
    max_sources: int = 8
    max_context_chars: int = 9_000
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    year: int = 2026
    now: str = "2026-01-01 00:00:00"

    def __post_init__(self) -> None:
        if self.mode not in ("auto", "quick", "standard", "deep"):
            raise ValueError("mode is auto, quick, standard or deep")
        if not 1 <= self.max_sources <= 25 or not 4_000 <= self.max_context_chars <= 50_000:
            raise ValueError("max_sources is 1 to 25, max_context_chars 4,000 to 50,000")


def _plan(spark: SparkSession, question: str, options: Options) -> dict:
    if not 1 <= len(question) <= 4_000:
        raise ValueError("a question has 1 to 4,000 characters")
    row = spark.createDataFrame([(question,)], "q string").select(P.mode(F.col("q")).alias("mode"), P.split_compound(F.col("q"), 6).alias("parts"), P.plan(F.col("q"), options.year, 6).alias("plan"), P.ranking_facets(F.col("q"), P.topics(F.col("q"))).alias("facets")).first()
    mode = row.mode if options.mode == "auto" else options.mode
    compound = len(row.parts) > 1
    budget = dict(zip(P.BUDGET_FIELDS, next(b for b in P.BUDGETS if b[0] == mode), strict=True))
    return {"mode": mode, "budget": budget, "parts": row.parts, "topics": row.parts if compound else row.plan.topics, "facets": row.parts[:4] if compound else row.facets, "late": row.plan.time_sensitive, "queries": row.plan.queries}


def graded(rows: DataFrame, facets: Sequence[str]) -> DataFrame:
    """rows (title, snippet, url, search_score, engines) with, for each facet, scores and fits: whether the row has two of the facet's terms, or all if fewer."""
    subjects = rows.sparkSession.createDataFrame([(list(facets),)], "_f array<string>").select(F.transform("_f", P.subject).alias("_subjects"))
    score = lambda i, f: C.result_score(F.lit(f), F.col("title"), F.col("snippet"), F.col("url"), F.col("search_score"), F.col("engines"), F.get("_subjects", F.lit(i)))
    rows = rows.crossJoin(F.broadcast(subjects)).withColumn("scores", F.array(*(score(i, f) for i, f in enumerate(facets)))).drop("_subjects")  # one row, of a question's facets
    hay = X.meaningful(F.concat_ws(" ", "title", "snippet"))
    fits = F.array(*(F.size(F.array_intersect(F.lit(t), hay)) >= min(2, len(t)) if (t := list(dict.fromkeys(X.meaningful_py(f)))) else F.lit(True) for f in facets))
    return rows.withColumns({"fits": fits, "preliminary": F.array_max("scores")})


def candidates(results: DataFrame, facets: Sequence[str], options: Options) -> DataFrame:
    """Results in normal form that may be fetched, scored by their best facet, near duplicates merged, best first by `preliminary`, then `pos`.

    results: pos, url, title, snippet, engines, search_score, and perhaps question; groups of any size are merged by near_results(), one
    question's results, which its caller has bounded by its budget, by merge_few().
    """
    rows = S.domain_filter(S.normalize(results).filter(U.unsafe_reason("url").isNull()), "domain", options.include, options.exclude)
    rows = dealt(N.near_results(cut(rows), ["question"])) if "question" in rows.columns else V.merge_few(cut(rows.withColumn("question", F.lit(0))), ["question"]).drop("question")
    return graded(rows, facets).withColumns({"kind": U.source_type("url"), "key": F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), F.col("url"))})


def research(spark: SparkSession, question: str, results: DataFrame, pages: DataFrame, options: Options | None = None) -> dict[str, DataFrame]:
    """Everything that is found for one question: snippets, sources, evidence, coverage, contradictions, failures.

    results: pos, url, title, snippet, engines, search_score. pages: url, html. Pages meet candidates by normal URL; a candidate without a page, or
    whose page has no text, or the text of an earlier one, is a failure. All tables are DataFrames; only the plan of the question is made on the driver.
    """
    options = options or Options()
    plan = _plan(spark, question, options)
    facets = plan["facets"]
    # The question's budget of raw results bounds what is merged and chosen from in one task.
    found = cut(candidates(results.orderBy("pos").limit(plan["budget"]["raw_results"]), facets, options))
    snippets = S.snippets(found, 10, order=[F.desc("preliminary"), "pos"]).drop("scores", "fits")
    limit = min(plan["budget"]["pages"], max(options.max_sources, 1))
    rows = found.select(F.lit(0).alias("q"), "pos", "key", "domain", "kind", "preliminary", "scores", "fits")
    rows = rows.join(F.broadcast(W.preferred(rows, ["q"], len(facets)).drop("q")), "key", "left")  # a facet each
    order = W.fetch_order(rows, ["q"], limit, len(facets)).drop("q")
    chosen = found.join(F.broadcast(order), "key")  # at most a budget's pages
    texts = G.extract_text(pages.withColumn("_u", U.normalize("url")).join(F.broadcast(chosen.select(F.col("url").alias("_u"))), "_u", "left_semi").dropDuplicates(["_u"]).select("_u", "html"), "_u")
    fetched = chosen.join(texts, chosen["url"] == F.col("_u"), "left").withColumn("failed", F.coalesce("failed", F.lit(True)))
    fetched = cut(V.content_dedup(fetched.withColumn("q", F.lit(0)), ["q", "failed"], "text", "position").drop("q"))
    failures = fetched.filter("failed or duplicate").select("url", F.when(F.col("_u").isNull(), "fetch").when(F.col("failed"), "extraction").otherwise("deduplication").alias("stage"), "position")
    sources = fetched.filter("not failed and not duplicate").withColumn("source_id", F.format_string("src_%03d", "position"))
    chunks = cut(G.chunk(sources.select("source_id", "text"), "source_id").withColumn("passage", F.col("pos")))
    named = {f"f{i}": f for i, f in enumerate(facets)}
    per_page = R.rank(chunks, named, "passage", heading="heading", by=["source_id"])
    best = R.top(per_page.groupBy("source_id", "passage").agg(F.max(F.col("score") * F.col("coverage")).alias("score")), 8, "passage", by=["source_id"])
    kept = chunks.join(best.select("source_id", "passage"), ["source_id", "passage"])
    fresh = C.freshness(F.lit(None).cast("timestamp"), F.lit(options.now).cast("timestamp"), F.lit(plan["late"]))
    graded = kept.join(sources.select("source_id", "preliminary"), "source_id").withColumn("facet", F.explode(F.lit(facets)))
    relevance = C.source_relevance(graded.withColumn("_t", F.concat_ws(" ", "heading", "text")), ["source_id"], "facet", "_t", "preliminary")
    sources = cut(sources.join(relevance, "source_id", "left").select("source_id", "position", "url", "title", "domain", F.col("kind").alias("source_type"), "content_hash", F.coalesce("relevance", F.lit(0.0)).alias("relevance"), C.source_quality(F.col("preliminary"), fresh).alias("quality"), F.coalesce(P.matches_authority(F.lit(question), F.col("url")), F.lit(False)).alias("authority")))
    if len(facets) <= 1:
        # Pages are read in batches until enough are useful; what the reader would not have got to doesn't count. One row reaches the driver.
        outcomes = fetched.select(F.lit(0).alias("q"), "position").join(sources.select("position", (F.col("relevance") >= V.ADMIT).alias("useful")), "position", "left").na.fill(False, ["useful"])
        tried = C.retrieval_attempts(outcomes, ["q"], "position", "useful", limit).first()
        sources, failures = (df.filter(F.col("position") <= (tried.attempts if tried else 0)) for df in (sources, failures))
        kept = kept.join(sources.select("source_id"), "source_id", "left_semi")
    safe = kept.withColumn("injection_reasons", X.injection_reasons("text")).withColumn("risk", X.injection_risk(F.col("injection_reasons"))).filter("risk <> 'high'").withColumn("pid", F.concat_ws(":", "source_id", F.format_string("%06d", "passage")))
    ranked = safe.join(R.rank_facets(cut(safe), named, "pid", heading="heading"), "pid").join(sources.select("source_id", "relevance", "quality", "authority", "position"), "source_id")
    # By score, then position, then passage, as one number; a page has fewer than 10 million passages.
    place = (F.round((1 - F.col("score")) * 10_000).cast("long") * 1_000 + F.col("position")) * 10_000_000 + F.col("passage")
    rows = ranked.select(F.lit(0).alias("q"), place.alias("pos"), "source_id", "heading", "text", "start_offset", "end_offset", F.col("score").alias("passage_score"), F.col("relevance").alias("source_score"), "quality", "authority", "risk")
    picked = V.diverse(rows, ["q"], min(plan["budget"]["passages"], max(8, options.max_sources)), facets, question)
    label = F.format_string("ev_%03d", "position")
    evidence = cut(picked.select(label.alias("evidence_id"), "source_id", "heading", "text", "start_offset", "end_offset", F.col("passage_score").alias("relevance"), "risk", F.format_string("[%s, ev_%03d]", "source_id", "position").alias("citation"), F.col("position").alias("pos"), F.lit(0).alias("q")))
    topics = spark.createDataFrame([(0, i, t) for i, t in enumerate(plan["topics"])] or [], "q int, pos int, topic string")
    backed = sources.select(F.lit(0).alias("q"), "source_id", "domain", "relevance", "source_type")
    missing = V.missing_facets(V.topic_coverage(topics, evidence, ["q"])).drop("q")
    return {
        "missing": missing,
        "plan": spark.createDataFrame([(question, plan["mode"], plan["queries"], plan["topics"], facets)], "question string, mode string, queries array<string>, topics array<string>, facets array<string>"),
        "search_snippets": snippets, "sources": sources, "evidence": evidence.drop("q"), "failures": V.failure_histogram(failures.withColumn("q", F.lit(0)).withColumn("error", F.lit("page")), ["q"], "stage", "error", "position").drop("q"),
        "coverage": V.coverage_report(topics, evidence, backed, ["q"]).drop("q"), "contradictions": V.contradictions(evidence, ["q"]).drop("q") if plan["mode"] == "deep" else V.contradictions(evidence.limit(0), ["q"]).drop("q"),
    }


RELEVANT = 0.30


def _standing(question: str, every: DataFrame, new: DataFrame, options: Options) -> tuple[int, bool, bool]:
    """How many of all results so far are relevant, whether one of those is a primary source on the subject, and whether the new ones have a relevant one. One row reaches the driver."""

    def scored(rows: DataFrame) -> DataFrame:
        q = F.lit(question)
        rows = rows.withColumn("_s", C.result_score(q, F.col("title"), F.col("snippet"), F.col("url"), F.col("search_score"), F.col("engines"), P.subject(q)))
        return rows.withColumn("_p", C.aligned_primary(q, F.col("title"), F.col("snippet"), F.col("url"), F.col("_s"))).filter(F.col("_s") >= RELEVANT)

    merged = V.merge_few(S.domain_filter(S.normalize(every).filter(U.unsafe_reason("url").isNull()), "domain", options.include, options.exclude).withColumn("question", F.lit(0)), ["question"])
    r = scored(merged).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.coalesce("_p", F.lit(False))), F.lit(False)).alias("p")).crossJoin(scored(new).agg((F.count(F.lit(1)) > 0).alias("u"))).first()
    return r.n, r.p, r.u


def goes_on(mode: str, round_number: int, more: bool, weak_rounds: int, relevant: int, primary: bool, max_sources: int) -> bool:
    """Whether discovery takes another round. round_number counts from 0; more: whether rounds and queries are left; weak_rounds: rounds in a row without a relevant result.

    Two weak rounds end it. Deep questions take a second round in any case, then go on until max(6, max_sources) results are relevant and one is primary; others
    until max(2, min(4, max_sources / 2)) are and one is primary, quick ones never beyond what they have.
    """
    if weak_rounds >= 2 or not more:
        return False
    if mode == "deep" and (round_number == 0 or relevant < max(6, max_sources) or not primary):
        return True
    return mode != "quick" and (relevant < max(2, min(4, max_sources // 2)) or not primary)


def discover(spark: SparkSession, question: str, search: Callable[[str, int], DataFrame], options: Options | None = None) -> dict[str, DataFrame]:
    """The search phase: `results` for research(), and `rounds` (round, query, relevant, primary, useful; nulls for the exact round 1).

    search: a query and the most results it may give. First the question as it stands (a compound one's facets each), then expansions and
    gap queries, two a round (all at once for a compound question), as long as goes_on() says so. The mode's budget bounds queries, rounds and raw
    results: the exact searches may take 10 each (a share of 20 where there are several), the others share what is left, 3 to 15 each. A URL counts once, at its first place.
    """
    options = options or Options()
    plan = _plan(spark, question, options)
    mode, budget, compound = plan["mode"], plan["budget"], len(plan["parts"]) > 1
    exact = plan["parts"][:6] if compound else [question]
    limit = min(budget["queries"], max(3, options.max_sources * 2)) if mode == "deep" else budget["queries"]
    limit = min(limit, 2 * len(exact)) if compound else limit
    most = 1 if compound else min(budget["rounds"], max(1, (limit + 1) // 2))
    gaps = [r.query for r in P.gap_queries(spark.createDataFrame([(0, question, list(plan["topics"]))], "id int, original string, topics array<string>").crossJoin(spark.range(1, max(2, most)).select(F.col("id").alias("r"))), "id", F.col("r")).orderBy("round", "pos").collect()] if most > 1 else []
    known, expansions = {q.casefold() for q in exact}, []
    for q in [*plan["queries"], *gaps]:
        if q.casefold() not in known:
            known.add(q.casefold())
            expansions.append(q)
    expansions = expansions[: max(0, limit - len(exact))]
    each = 10 if not compound else max(3, min(10, min(20, budget["raw_results"]) // len(exact)))
    results, log, at = None, [], 0

    def put(queries: Sequence[str], size: int) -> DataFrame:
        nonlocal results, at
        new = None
        for q in queries:
            rows = search(q, size).orderBy("pos").limit(size)
            rows = rows.withColumn("pos", F.row_number().over(Window.orderBy("pos")) + at)  # at most `size` rows
            new, at = rows if new is None else new.unionByName(rows), at + size
        new = cut(new)
        every = new if results is None else results.unionByName(new)
        first = F.row_number().over(Window.partitionBy("url").orderBy("pos"))
        results = cut(every.withColumn("_k", first).filter("_k = 1").drop("_k"))
        return new

    taken = put(exact, each).count()
    log += [(1, q, None, None, None) for q in exact]
    per_round = len(expansions) if compound else min(2, len(expansions))
    planned = len(expansions) if compound else min(most * per_round, len(expansions))
    size, weak = max(3, min(15, max(0, budget["raw_results"] - taken) // max(1, planned))), 0
    for k in range(most):
        asked = expansions[k * per_round : (k + 1) * per_round]
        if not asked:
            break
        new = put(asked, size)
        relevant, primary, useful = _standing(question, results, new, options)
        weak = 0 if useful else weak + 1
        log += [(k + 2, q, relevant, primary, useful) for q in asked]
        used = len(exact) + sum(x[0] > 1 for x in log)
        if not goes_on(mode, k, k + 1 < most and used < limit, weak, relevant, primary, options.max_sources):
            break
    return {"results": results, "rounds": spark.createDataFrame(log, "round int, query string, relevant long, primary boolean, useful boolean")}


def research_rounds(spark: SparkSession, question: str, search: Callable[[Sequence[str]], DataFrame], pages: DataFrame, options: Options | None = None) -> dict[str, DataFrame]:
    """research() in as many rounds as the mode's budget allows: each further round searches for the topics that are still without evidence.

    search: from some queries to their results as research() takes them. Later results come after earlier ones. Ends early when nothing is
    missing or a round brings no new URL. Adds `rounds`: round, query. Per round a handful of topics and queries reach the driver.
    """
    options = options or Options()
    plan = _plan(spark, question, options)
    queries, asked, results, found = list(plan["queries"])[: plan["budget"]["queries"]], [], None, None
    for k in range(1, plan["budget"]["rounds"] + 1):
        more = cut(search(queries).dropDuplicates(["url"]))
        if results is not None:
            after = results.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("m")).first().m + 1
            more = more.withColumn("pos", F.col("pos") + F.lit(after)).join(results.select("url"), "url", "left_anti").select(results.columns)
        asked += [(k, q) for q in queries]
        if results is not None and more.isEmpty():
            break
        results = more if results is None else cut(results.unionByName(more))
        found = research(spark, question, results, pages, options)
        topics = [r.topic for r in found["missing"].orderBy("pos").collect()]
        if not topics or k == plan["budget"]["rounds"]:
            break
        gaps = P.gap_queries(spark.createDataFrame([(0, question, topics)], "id int, original string, topics array<string>"), "id", F.lit(k))
        queries = [r.query for r in gaps.orderBy("pos").collect()]
    return found | {"rounds": spark.createDataFrame(asked, "round int, query string")}


def read_pages(pages: DataFrame, key: str, question: str | None = None, html: str = "html", most: int = 20) -> DataFrame:
    """(key, rank, heading, text, offsets, score): the best safe passages of every page for a question, else for the page's own title."""
    chunks = G.read(pages, key, html).withColumn("passage", F.col("pos"))
    chunks = chunks.filter(X.injection_risk(X.injection_reasons("text")) != "high")
    if question is None:
        titles = pages.select(key, F.array_distinct(X.meaningful(G.metadata(F.col(html))["title"])).alias("_t"))
        scored = chunks.join(titles, key).select(key, "passage", F.round(X.coverage(F.col("_t"), X.meaningful("text")), 4).alias("score"))
    else:
        scored = R.rank(chunks, {"q": question}, "passage", heading="heading", by=[key]).select(key, "passage", "score")
    return R.top(scored, most, "passage", by=[key]).join(chunks, [key, "passage"]).select(key, "rank", "heading", "text", "start_offset", "end_offset", "score")


def exact_results(results: DataFrame, k: int, order: str = "pos") -> DataFrame:
    """The backend's first k results as they are."""
    return results.orderBy(order).limit(k)


def clear(entries: DataFrame, namespaces: Sequence[str], confirm: bool) -> tuple[DataFrame, DataFrame]:
    """What stays and how many entries go; nothing is cleared without a confirmation."""
    if not confirm:
        raise ValueError("clearing needs confirm=True")
    return delete(entries, F.col("namespace").isin(*namespaces))


def quality_report(runs: DataFrame, mode: str, measures: Sequence[str], repeat: str) -> DataFrame:
    return M.means(runs, [mode], measures, repeat)


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def compact(packages: DataFrame, key: str, package: str, options: Options | None = None) -> DataFrame:
    return Q.responses(packages, key, package, (options or Options()).max_context_chars)
