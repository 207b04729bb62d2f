"""Scores, evidence, coverage and contradictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import urls as U
from lodestone.operators import evidence as V
from lodestone.operators import near as N
from lodestone.operators import rank as R
from lodestone.operators import results as S
from lodestone.operators import scoring as C
from lodestone.plans import questions as P
from lodestone.registry import register
from lodestone.sources.tables import table

from . import duck as D
from .ranking import rank_sql
from .results import RESULTS, page_results

#: Questions without identifiers or authorities, so that SQL needs no rules for these.
PLAIN = {"p1": "the and attion to thanedble", "p2": "erinant thonor ering ththe", "p3": "best of the thing"}
NOW = "2026-01-01 00:00:00"


def _scored(spark, sf_dir):
    asked = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(PLAIN.items())], "facet int, question_id string, question string").withColumn("subject", P.subject(F.col("question")))
    rows = page_results(spark, sf_dir).crossJoin(F.broadcast(asked))  # the call's questions
    score = C.result_score(F.col("question"), F.col("title"), F.col("snippet"), F.col("url"), F.col("search_score"), F.col("engines"), F.col("subject"))
    return rows.select("pos", "question_id", "facet", "question", "url", "title", "snippet", "engines", score.alias("score"))


def scored_sql(questions: dict[str, str]) -> str:
    """CTEs up to scored(pos, facet, question_id, terms, content, score): pages as results, scored for each question."""
    return f"""{RESULTS},
q AS (SELECT * FROM {D.values([(i, k, v) for i, (k, v) in enumerate(questions.items())], 'v(facet, question_id, question)')}),
qt AS (SELECT facet, question_id, list_distinct({D.meaningful('question')}) AS terms FROM q),
h AS (SELECT pos, title, engines, search_score, {D.source_type('url')} AS kind, list_distinct({D.meaningful(f"(title || ' ' || snippet || ' ' || {D.host('url')} || ' ' || replace({D.part('url', 3)}, '/', ' '))")}) AS hay,
  list_distinct({D.meaningful("(title || ' ' || snippet)")}) AS content FROM r),
o AS (SELECT h.*, facet, question_id, terms, len(list_intersect(terms, hay)) / greatest(len(terms), 1)::DOUBLE AS overlap FROM h, qt),
scored AS (SELECT pos, facet, question_id, terms, content, round(greatest(0.0, least(1.0, 0.42 * overlap + 0.20 * search_score + least(0.15, 0.04 * (len(engines) - 1))
  + CASE WHEN kind IN ('official_documentation', 'primary_institution', 'source_repository') AND overlap >= 0.25 THEN 0.06 ELSE 0 END
  - CASE WHEN CAST(contains({D.casefold('title')}, 'best') AS INT) + CAST(contains({D.casefold('title')}, 'top 10') AS INT) + CAST(contains({D.casefold('title')}, 'ultimate guide') AS INT) >= 2 THEN 0.18 ELSE 0 END)), 4)::DOUBLE AS score FROM o)"""


_SCORED = scored_sql(PLAIN)


def search_result_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("pos", "question_id", "score")


register("search_result_score", ("R4", "F8"), search_result_score, f"WITH {_SCORED} SELECT pos, question_id, score FROM scored")


def facet_best_score(spark, sf_dir):
    return C.best_facet(_scored(spark, sf_dir), ["pos"], "facet", "score").select("pos", "question_id", "score")


register("facet_best_score", ("W7",), facet_best_score, f"WITH {_SCORED} SELECT pos, question_id, score FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, facet) AS k FROM scored) WHERE k = 1")


def next_candidates(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("terms", F.array_distinct(X.meaningful("question")))
    rows = rows.withColumn("overlap", F.size(F.array_intersect("terms", X.meaningful(F.concat_ws(" ", "title", "snippet"))))).withColumn("n_terms", F.size("terms"))
    return C.next_candidate(rows, ["question_id"], "overlap", "n_terms", "score", "score", "pos").select("question_id", "pos", "overlap", "score")


register("next_candidates", ("W8", "J8"), next_candidates, f"""
WITH {_SCORED}, t AS (SELECT *, len(list_intersect(terms, content)) AS overlap FROM scored),
u AS (SELECT *, CASE WHEN overlap >= least(2, len(terms)) THEN 0 WHEN overlap >= 1 THEN 1 END AS tier FROM t)
SELECT question_id, pos, CAST(overlap AS INTEGER) AS overlap, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY tier, score DESC, pos) AS k FROM u WHERE tier IS NOT NULL) WHERE k = 1""")


def freshness(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    dated = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    fresh = C.freshness(dated, F.lit(NOW).cast("timestamp"), F.col("o_orderkey") % 2 == 0)
    quality = C.source_quality((F.col("o_orderkey") % 10) / 10, fresh)
    return o.select("o_orderkey", fresh.alias("freshness"), quality.alias("quality"), F.round(C.base_score((F.col("o_orderkey") % 7) / 7, (F.col("o_orderkey") % 3) / 3, quality), 6).alias("base"))


register("freshness", ("R5", "R7", "R8", "Z9"), freshness, f"""
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS dt FROM orders),
f AS (SELECT o_orderkey, CASE WHEN dt IS NULL THEN CASE WHEN o_orderkey % 2 = 0 THEN 0.35 ELSE 0.5 END WHEN o_orderkey % 2 <> 0 THEN 0.75
  ELSE round(1 / (1 + greatest(0, floor((epoch(TIMESTAMP '{NOW}') - epoch(dt)) / 86400)) / 180::DOUBLE), 4) END::DOUBLE AS freshness FROM d),
q AS (SELECT *, round(0.65::DOUBLE * (o_orderkey % 10 / 10::DOUBLE) + 0.35::DOUBLE * freshness, 4) AS quality FROM f)
SELECT o_orderkey, freshness, quality, round(0.45::DOUBLE * ((o_orderkey % 7) / 7::DOUBLE) + 0.30::DOUBLE * ((o_orderkey % 3) / 3::DOUBLE) + 0.25::DOUBLE * quality, 6) AS base FROM q""")


def source_relevance(spark, sf_dir):
    p = page_results(spark, sf_dir).select("pos", U.host("url").alias("host"), F.concat_ws(" ", "title", "snippet").alias("text"), F.col("search_score").alias("prior"))
    rows = p.withColumn("question", F.explode(F.lit(list(PLAIN.values()))))
    return C.source_relevance(rows, ["host"], "question", "text", "prior")


register("source_relevance", ("R6", "F11"), source_relevance, f"""
WITH {RESULTS}, q AS (SELECT list_distinct({D.meaningful('question')}) AS terms FROM {D.values([(v,) for v in PLAIN.values()], 'v(question)')}),
c AS (SELECT {D.host('url')} AS host, search_score AS prior, terms, len(list_intersect(terms, {D.meaningful("(title || ' ' || snippet)")})) / greatest(len(terms), 1)::DOUBLE AS cov FROM r, q),
s AS (SELECT host, CASE WHEN len(terms) > 0 AND cov >= CASE WHEN len(terms) <= 2 THEN 1.0 ELSE 0.34 END THEN 0.70::DOUBLE * cov + 0.20::DOUBLE * prior * least(1.0, cov / 0.60::DOUBLE) ELSE 0 END AS s FROM c)
SELECT host, round(least(1.0, max(s)), 4)::DOUBLE AS relevance FROM s GROUP BY host""")


def quality_notes(spark, sf_dir):
    rows = _scored(spark, sf_dir).filter("facet = 0")
    return rows.select("pos", F.array_join(C.quality_notes(U.source_type("url"), F.col("score"), F.lit(False), F.col("engines"), F.col("pos") % 2 == 0), "; ").alias("notes"), C.aligned_primary(F.col("question"), F.col("title"), F.col("snippet"), F.col("url"), F.col("score")).alias("primary"))


register("quality_notes", ("R11", "F9"), quality_notes, f"""
WITH {_SCORED}, k AS (SELECT page_id AS pos, {D.source_type('url')} AS kind FROM pages)
SELECT s.pos, 'URL/content classification: ' || kind || '; Pre-fetch query/source score: ' || format('{{:.4f}}', score) || '; Query-aligned authority: no; Search-engine agreement: 2 engine(s); ' ||
 CASE WHEN s.pos % 2 = 0 THEN 'Publication or update date available for freshness scoring' ELSE 'No reliable publication/update date; conservative freshness score applied' END AS notes, FALSE AS "primary" FROM scored s JOIN k USING (pos) WHERE facet = 0""")


def near_results(spark, sf_dir):
    rows = S.normalize(page_results(spark, sf_dir).drop("marked")).withColumn("question", F.floor(F.col("pos") / 40))  # a question's raw results
    return N.near_results(rows, ["question"]).select("question", "pos", "url", "title", "snippet", F.array_join("engines", ",").alias("engines"), "search_score")


register("near_results", ("A3", "R12"), near_results)


def _talk(spark, sf_dir):
    """Conversations as evidence: the user's first turn asks, assistant turns answer; risks, sources and scores by number."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    ask = t.filter("turn = 0").select("conv_id", F.posexplode(F.filter(F.transform(F.split("text", r"\."), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "topic"))
    n = F.col("conv_id") + F.col("turn")
    ev = t.filter("turn > 0").select("conv_id", F.col("turn").alias("evidence_id"), n.alias("n"), "text", F.when(n % 7 == 0, "high").otherwise("low").alias("risk"), F.col("turn").alias("source_id"))
    src = ev.select("conv_id", "source_id", F.format_string("d%d", F.col("n") % 3).alias("domain"), ((F.col("n") % 5) / 5).alias("relevance"), F.get(F.lit(["web_page", "publication", "official_documentation"]), (F.col("n") % 3).cast("int")).alias("source_type"))
    return ask, ev, src


_TALK = """t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
a AS (SELECT conv_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, ' ')), lambda x: x <> '') AS topics FROM t WHERE turn = 0),
ask AS (SELECT conv_id, unnest(topics) AS topic, unnest(range(len(topics))) AS pos FROM a),
ev AS (SELECT conv_id, turn AS evidence_id, conv_id + turn AS n, text, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'high' ELSE 'low' END AS risk, turn AS source_id FROM t WHERE turn > 0),
src AS (SELECT conv_id, source_id, 'd' || (n % 3) AS domain, (n % 5) / 5::DOUBLE AS relevance, ['web_page', 'publication', 'official_documentation'][n % 3 + 1] AS source_type FROM ev)"""
_COVER = f"""{_TALK},
tt AS (SELECT conv_id, pos, topic, list_distinct({D.meaningful('topic')}) AS terms FROM ask),
ew AS (SELECT conv_id, {D.meaningful('text')} AS w FROM ev WHERE risk <> 'high'),
cov AS (SELECT tt.conv_id, pos, topic, terms, coalesce(max(CASE WHEN w IS NULL THEN 0 ELSE len(list_intersect(terms, w)) / greatest(len(terms), 1)::DOUBLE END), 0) AS best FROM tt LEFT JOIN ew USING (conv_id) GROUP BY ALL),
c AS (SELECT conv_id, pos, topic, round(best, 4)::DOUBLE AS best, best >= CASE WHEN len(terms) <= 2 THEN 1.0 ELSE 0.6 END AS covered FROM cov)"""


def missing_facets(spark, sf_dir):
    ask, ev, _ = _talk(spark, sf_dir)
    return V.missing_facets(V.topic_coverage(ask, ev, ["conv_id"])).select("conv_id", "pos", "topic", "best")


register("missing_facets", ("W9", "J3", "F11"), missing_facets, f"WITH {_COVER} SELECT conv_id, CAST(pos AS INTEGER) AS pos, topic, best FROM c WHERE NOT covered")


def coverage_report(spark, sf_dir):
    return V.coverage_report(*_talk(spark, sf_dir), ["conv_id"])


register("coverage_report", ("A6", "A15", "J3", "J4"), coverage_report, f"""
WITH {_COVER}, p AS (SELECT conv_id, count(*) FILTER (covered) AS covered, count(*) FILTER (NOT covered) AS missing FROM c GROUP BY conv_id),
n AS (SELECT conv_id, count(*) AS n FROM ev GROUP BY conv_id),
b AS (SELECT src.conv_id, count(DISTINCT domain) AS d, bool_or(relevance >= 0.25 AND source_type IN ('official_documentation', 'primary_institution', 'source_repository')) AS pr
  FROM src SEMI JOIN (SELECT DISTINCT conv_id, source_id FROM ev WHERE risk <> 'high') e ON e.conv_id = src.conv_id AND e.source_id = src.source_id WHERE relevance >= 0.18 GROUP BY src.conv_id),
s AS (SELECT p.*, coalesce(d, 0) AS independent_sources, coalesce(pr, FALSE) AS primary_source, round(0.55::DOUBLE * (covered / greatest(1, covered + missing)::DOUBLE) + 0.25::DOUBLE * least(1.0, coalesce(d, 0) / 3::DOUBLE) + 0.20::DOUBLE * least(1.0, coalesce(n, 0) / 8::DOUBLE), 3)::DOUBLE AS score FROM p LEFT JOIN n USING (conv_id) LEFT JOIN b USING (conv_id))
SELECT conv_id, score, CASE WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.6 THEN 'moderate' WHEN score >= 0.3 THEN 'weak' ELSE 'insufficient' END AS status, covered, missing, independent_sources, primary_source FROM s""")


def _candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("lang", F.col("doc_id").alias("pos"), F.concat("source", F.lit("-"), F.col("doc_id") % 3).alias("source_id"), F.coalesce("text", F.lit("")).alias("text"), ((F.col("doc_id") % 11) / 11).alias("passage_score"), ((F.col("doc_id") % 7) / 7).alias("source_score"), ((F.col("doc_id") % 5) / 5).alias("quality"), (F.col("doc_id") % 50 == 0).alias("authority"))


#: A question and its facets.
DIVERSE = ["the and of", "the and attion to thanedble", "thonor erin"]


def diverse_selection(spark, sf_dir):
    out = V.diverse(_candidates(spark, sf_dir), ["lang"], 12, facets=DIVERSE[1:], question=DIVERSE[0])
    return out.select("lang", "position", F.col("pos").alias("doc_id"), "source_id")


_TERMS = [sorted(set(X.meaningful_py(q))) for q in DIVERSE]
_SHARES = ", ".join((f"len(list_intersect(terms, {t})) / {len(t)}::DOUBLE" if t else "0.0::DOUBLE") + f" AS share{i}" for i, t in enumerate(_TERMS))
_NEEDS = [1.0 if len(t) <= 2 else 0.60 for t in _TERMS]
_OWN = "len(list_filter(srcs, lambda x: x = source_id))"
_NEAR = "coalesce(list_max(list_transform(seen, lambda w: len(list_intersect(w, words)) / greatest(1, len(w) + len(words) - len(list_intersect(w, words)))::DOUBLE)), 0)"
register("diverse_selection", ("A7", "R8", "R9", "R10", "F5", "F6", "W5"), diverse_selection, f"""
WITH RECURSIVE d AS (SELECT lang, doc_id, source || '-' || (doc_id % 3) AS source_id, coalesce(text, '') AS text, 0.45::DOUBLE * ((doc_id % 11) / 11::DOUBLE) + 0.30::DOUBLE * ((doc_id % 7) / 7::DOUBLE) + 0.25::DOUBLE * ((doc_id % 5) / 5::DOUBLE) AS base, doc_id % 50 = 0 AS authority
  FROM documents WHERE (doc_id % 7) / 7::DOUBLE >= {V.ADMIT}),
w AS (SELECT lang, doc_id, source_id, base, authority, list_distinct({D.tokens('text')}) AS words, list_distinct({D.meaningful('text')}) AS terms FROM d), c AS (SELECT *, {_SHARES} FROM w),
st AS (SELECT DISTINCT lang, 0 AS step, []::BIGINT[] AS taken, []::VARCHAR[] AS srcs, []::VARCHAR[][] AS seen, 0.0::DOUBLE AS least FROM c
 UNION ALL SELECT lang, step + 1, CASE WHEN fits THEN list_append(taken, doc_id) ELSE taken END, CASE WHEN fits THEN list_append(srcs, source_id) ELSE srcs END, CASE WHEN fits THEN list_append(seen, words) ELSE seen END, least FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY fits DESC, worth DESC, base DESC, doc_id) AS k FROM (
   SELECT lang, step, taken, srcs, seen, doc_id, source_id, words, base, CASE WHEN step = 3 THEN max(base) OVER (PARTITION BY lang) * {V.FLOOR} ELSE least END AS least,
    CASE step WHEN 0 THEN authority AND share0 >= {_NEEDS[0]} WHEN 1 THEN share1 >= {_NEEDS[1]} AND {_OWN} < {V.PER_SOURCE} WHEN 2 THEN share2 >= {_NEEDS[2]} AND {_OWN} < {V.PER_SOURCE}
     ELSE {_OWN} < {V.PER_SOURCE} AND base >= CASE WHEN step = 3 THEN max(base) OVER (PARTITION BY lang) * {V.FLOOR} ELSE least END END AS fits,
    CASE step WHEN 0 THEN share0 WHEN 1 THEN share1 WHEN 2 THEN share2 ELSE base + CASE WHEN {_OWN} = 0 THEN {V.NEW_SOURCE} ELSE 0 END - {V.SIMILAR} * {_NEAR} - {V.REPEATED} * {_OWN} END AS worth
   FROM st JOIN c USING (lang) WHERE NOT list_contains(taken, doc_id) AND len(taken) < 12 AND step < 15)) WHERE k = 1),
f AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY lang ORDER BY step DESC) = 1)
SELECT lang, CAST(position AS INTEGER) AS position, doc_id, source_id FROM (SELECT lang, unnest(taken) AS doc_id, unnest(srcs) AS source_id, unnest(range(1, len(taken) + 1)) AS position FROM f)""")


def capped_selection(spark, sf_dir):
    rows = _candidates(spark, sf_dir).filter("source_score >= 0.18").withColumn("base", F.round(C.base_score(F.col("passage_score"), F.col("source_score"), F.col("quality")), 6))
    return V.capped(rows, ["lang"], "source_id", "base", "pos", 20).select("lang", "position", F.col("pos").alias("doc_id"), "source_id", "base")


register("capped_selection", ("A7", "F5", "W5"), capped_selection, """
WITH c AS (SELECT lang, doc_id, source || '-' || (doc_id % 3) AS source_id, round(0.45::DOUBLE * ((doc_id % 11) / 11::DOUBLE) + 0.30::DOUBLE * ((doc_id % 7) / 7::DOUBLE) + 0.25::DOUBLE * ((doc_id % 5) / 5::DOUBLE), 6) AS base FROM documents WHERE (doc_id % 7) / 7::DOUBLE >= 0.18),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, source_id ORDER BY base DESC, doc_id) AS k FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY base DESC, doc_id) AS position FROM s WHERE k <= 2)
SELECT lang, CAST(position AS INTEGER) AS position, doc_id, source_id, base FROM p WHERE position <= 20""")


def contradiction_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("evidence_id"), F.col("doc_id").alias("pos"), F.concat(F.coalesce("text", F.lit("")), F.lit(" is "), F.col("doc_id") % 3, F.lit(" ms and version "), F.col("doc_id") % 2, F.lit(".5 x")).alias("text"))
    return V.contradictions(d, ["lang"], limit=None).select("lang", "topic", "unit", F.array_join("evidence_ids", ",").alias("evidence_ids"), "description")


register("contradiction_groups", ("A8",), contradiction_groups, rf"""
WITH d AS (SELECT lang, doc_id, coalesce(text, '') || ' is ' || (doc_id % 3) || ' ms and version ' || (doc_id % 2) || '.5 x' AS text FROM documents),
w AS (SELECT lang, doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{{2,}}')[1:4], ' ') AS topic, regexp_extract_all(text, '{V.VALUE}', 1) AS nums, regexp_extract_all(text, '{V.VALUE}', 2) AS units FROM d),
x AS (SELECT lang, doc_id, topic, unnest(nums) AS num, coalesce(lower(unnest(units)), '') AS unit FROM w)
SELECT lang, topic, unit, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS evidence_ids, 'Conflicting numeric or version values found: ' || array_to_string(list_sort(list(DISTINCT num)), ', ') AS description FROM x GROUP BY lang, topic, unit HAVING count(DISTINCT num) > 1 AND count(DISTINCT doc_id) > 1""")


def conflicting_values(spark, sf_dir):
    """Numbers that conflict in the texts as they stand: documents of a language whose first four words are the same."""
    d = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("evidence_id"), F.col("doc_id").alias("pos"), "text")
    return V.conflicting_values(d, ["lang"]).withColumnRenamed("first", "first_id")


register("conflicting_values", ("A8",), conflicting_values, rf"""
WITH w AS (SELECT lang, doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{{2,}}')[1:4], ' ') AS topic, regexp_extract_all(text, '{V.VALUE}', 1) AS nums, regexp_extract_all(text, '{V.VALUE}', 2) AS units FROM documents),
x AS (SELECT lang, doc_id, topic, unnest(nums) AS number, coalesce(lower(unnest(units)), '') AS unit FROM w),
g AS (SELECT lang, topic, unit FROM x GROUP BY ALL HAVING count(DISTINCT number) > 1 AND count(DISTINCT doc_id) > 1)
SELECT lang, topic, unit, number, count(DISTINCT doc_id) AS records, min(doc_id) AS first_id FROM x
WHERE EXISTS (SELECT 1 FROM g WHERE g.lang IS NOT DISTINCT FROM x.lang AND g.topic = x.topic AND g.unit = x.unit) GROUP BY ALL""")


def content_hash_dedup(spark, sf_dir):
    rows = V.content_dedup(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["lang"], "text", "doc_id")
    return rows.select("doc_id", "content_hash", "duplicate")


register("content_hash_dedup", ("A4", "T12"), content_hash_dedup, "SELECT doc_id, sha256(text) AS content_hash, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) > 1 AS duplicate FROM documents")


def failure_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("request"), F.col("event_type").alias("stage"), (F.floor(F.abs("value")) % 4).cast("string").alias("error"), "event_id")
    return V.failure_histogram(e, ["request"], "stage", "error", "event_id")


register("failure_histogram", ("A5",), failure_histogram, """
WITH e AS (SELECT user_id % 20 AS request, event_type AS stage, CAST(CAST(floor(abs(value)) AS BIGINT) % 4 AS VARCHAR) AS error, event_id FROM events),
n AS (SELECT request, stage, error, count(*) AS count, min(event_id) AS first FROM e GROUP BY ALL)
SELECT request, stage, error, count FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY count DESC, first) AS k FROM n) WHERE k <= 6""")


def snippet_covered(spark, sf_dir):
    ask, ev, _ = _talk(spark, sf_dir)
    return ask.join(ev, "conv_id").select("conv_id", "pos", "evidence_id", V.snippet_covered(F.col("topic"), F.col("text")).alias("covered"))


register("snippet_covered", ("P4", "J2"), snippet_covered, f"""
WITH {_TALK}, j AS (SELECT conv_id, pos, evidence_id, list_distinct({D.meaningful('topic')}) AS s, {D.meaningful('text')} AS e FROM ask JOIN ev USING (conv_id))
SELECT conv_id, CAST(pos AS INTEGER) AS pos, evidence_id, len(s) = 0 OR (len(list_intersect(s, e)) >= least(4, len(s)) AND len(list_intersect(s, e)) / len(s)::DOUBLE >= 0.65) AS covered FROM j""")


def passages_of_pages(spark, sf_dir):
    """The best passages of each conversation: the corpus of a rank is the group."""
    t = table(spark, sf_dir, "conversations")
    return R.top(R.rank(t, PLAIN, "turn", by=["conv_id"]), 8, "turn", by=("conv_id", "question_id")).select("conv_id", "question_id", "rank", "turn", "score")


register("grouped_rank", ("R1", "W4"), passages_of_pages, f"""
WITH {rank_sql("SELECT conv_id * 1000 + turn AS k, conv_id AS grp, text FROM conversations", "k", PLAIN)}
SELECT grp AS conv_id, question_id, CAST(rank AS INTEGER) AS rank, k - grp * 1000 AS turn, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id, grp ORDER BY score DESC, k) AS rank FROM scored) WHERE rank <= 8""")


def retrieval_attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 3 == 0).alias("useful"))
    return C.retrieval_attempts(e, ["user_id"], "event_id", "useful", 12)


register("retrieval_attempts", ("W10",), retrieval_attempts, """
WITH RECURSIVE e AS (SELECT * FROM (SELECT user_id, event_id % 3 = 0 AS useful, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p <= 12),
f AS (SELECT DISTINCT user_id, 0 AS p, 0 AS got, 0 AS rest, 0 AS tried FROM e UNION ALL
 SELECT f.user_id, f.p + 1, f.got + CASE WHEN opened > 0 AND useful THEN 1 ELSE 0 END, greatest(opened - 1, 0), f.tried + CASE WHEN opened > 0 THEN 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN rest > 0 THEN rest WHEN got < 8 THEN greatest(1, 8 - got) ELSE 0 END AS opened FROM f) f JOIN e ON e.user_id = f.user_id AND e.p = f.p + 1)
SELECT user_id, tried AS attempts, got AS useful, CAST(p AS INTEGER) AS candidates FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p DESC) = 1""")


def fetchable_first(spark, sf_dir):
    rows = page_results(spark, sf_dir).select("pos", "url", U.host("url").alias("host"))
    failed = rows.filter("pos % 3 = 0").select("url")
    return C.fetchable_first(rows, failed, "url", 5, ["host"], "pos").select("pos", "host", "position")


register("fetchable_first", ("F10", "J9"), fetchable_first, f"""
WITH h AS (SELECT page_id AS pos, url, {D.host('url')} AS host FROM pages), f AS (SELECT DISTINCT url FROM h WHERE pos % 3 = 0),
m AS (SELECT pos, host, CASE WHEN f.url IS NULL THEN 0 ELSE 1 END AS failed FROM h LEFT JOIN f USING (url)), n AS (SELECT *, sum(1 - failed) OVER (PARTITION BY host) AS ok FROM m)
SELECT pos, host, CAST(row_number() OVER (PARTITION BY host ORDER BY failed, pos) AS INTEGER) AS position FROM n WHERE failed = 0 OR ok < 5""")
