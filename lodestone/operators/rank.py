"""Lexical ranking of passages against questions.

A passage's tokens never leave its row: each question's terms, known when the plan is made, are counted in place. One narrow row per
passage is written; document frequencies are one row per group, and scores are made from both on the fly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import bigrams_py, bind, carrying, casefold, inflection, meaningful, meaningful_py, tokens
from lodestone.plans.lineage import cut

# Saturation, length share and the weights of the bonuses.
K1, B = 1.2, 0.75
PHRASE, HEADING, BIGRAM, COVERAGE, PROXIMITY = 1.5, 0.4, 1.1, 0.9, 0.8


def met(words: Column, terms: Sequence[str]) -> Column:
    """array<struct<t, p>>: the words (of carrying()) that are forms of the terms, as terms, with their positions.

    Inflection leaves the first three signs alone, so only words that begin like a term are looked at closer.
    """
    begins = sorted({t[:3] for t in terms})
    near = F.filter(F.transform(words, lambda t, i: F.when(F.left(t, F.lit(3)).isin(*begins), F.struct(t.alias("t"), i.alias("p")))), lambda x: x.isNotNull())
    return F.filter(F.transform(near, lambda x: F.struct(inflection(x["t"]).alias("t"), x["p"].alias("p"))), lambda x: x["t"].isin(*terms))


def _gap(found: Column) -> Column:
    after = F.slice(found, 2, F.greatest(F.size(found), F.lit(1)))
    return F.array_min(F.zip_with(found, after, lambda a, b: F.when(a["t"] != b["t"], b["p"] - a["p"])))


def min_gap(words: str | Column, terms: Sequence[str]) -> Column:
    """Least distance between two different terms among words (of meaningful()); the nearest such pair is always adjacent among the matches. Null without one."""
    own = F.col(words) if isinstance(words, str) else words
    return _gap(F.filter(F.transform(own, lambda t, i: F.struct(t.alias("t"), i.alias("p"))), lambda x: x["t"].isin(*terms)))


def _asked(questions: dict[str, str]) -> Column:
    """The questions as one literal: array<struct<folded, terms, pairs>>, so that a plan doesn't grow with their number."""
    rows = []
    for q in questions.values():
        sequence = meaningful_py(q)
        strings = lambda xs: F.lit(xs) if xs else F.array().cast("array<string>")
        rows.append(F.struct(F.lit(q.lower().replace("ß", "ss")).alias("folded"), strings(list(dict.fromkeys(sequence))).alias("terms"), strings(bigrams_py(sequence)).alias("pairs")))
    return F.array(*rows)


def _matches(q: Column, row: Column) -> Column:
    """A question's view of a row (n, found, title, folded): counts of its distinct terms, and the bonuses that don't depend on other passages."""

    def view(own: Column) -> Column:
        counts = F.transform(q["terms"], lambda t: F.size(F.filter(own, lambda x: x["t"] == t)))
        after = F.slice(row["found"], 2, F.greatest(F.size(row["found"]), F.lit(1)))
        near = F.zip_with(row["found"], after, lambda a, b: F.when(b["p"] == a["p"] + 1, F.concat(a["t"], F.lit(" "), b["t"])))
        share = F.size(F.array_distinct(F.transform(own, lambda x: x["t"]))) / F.greatest(F.lit(1), F.size(q["terms"]))
        # greatest() passes over nulls, so a missing gap is asked for first.
        close = bind(_gap(own), lambda g: F.when(g.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(PROXIMITY), F.lit(1.6) / F.greatest(F.lit(2), g))))
        bonus = (
            F.when(F.contains(row["folded"], q["folded"]), F.lit(PHRASE)).otherwise(F.lit(0.0)) + F.lit(HEADING) * F.size(F.array_intersect(q["terms"], row["title"])) + F.lit(COVERAGE) * F.pow(share, 2)
            + close + F.lit(BIGRAM) * F.size(F.array_intersect(q["pairs"], near)) / F.greatest(F.lit(1), F.size(q["pairs"]))
        )
        return F.struct(counts.alias("tf"), bonus.alias("bonus"))

    return bind(F.filter(row["found"], lambda x: F.array_contains(q["terms"], x["t"])), view)


def rarity(df: Column, docs: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def saturated(tf: Column, n: Column, avg_n: Column) -> Column:
    """What tf occurrences of a term count for in a passage of n words."""
    return tf * 2.2 / (tf + K1 * ((1 - B) + B * n / F.greatest(F.lit(1.0), avg_n)))


def raw_score(tf: Column, bonus: Column) -> Column:
    """The score of a row (docs, df per term, n, avg_n) before it is divided by the question's best."""
    term = lambda x, i: F.when(x > 0, rarity(F.get("df", i), F.col("docs")) * saturated(x, F.col("n"), F.col("avg_n"))).otherwise(F.lit(0.0))
    return F.aggregate(F.transform(tf, term), F.lit(0.0), lambda a, x: a + x) + bonus


def rank(passages: DataFrame, questions: dict[str, str], key: str, text: str = "text", heading: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, question_id, key, score, coverage) of every passage for every question; the corpus is the passages of one `by` group.

    BM25 over distinct terms plus bonuses for the phrase, heading, neighbours, coverage and proximity, divided by the best
    score of the question in the group and rounded to four digits. A null text or heading is empty; without a match the score is 0.
    """
    body, title = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(heading), F.lit("")) if heading else F.lit("")
    terms = sorted({t for q in questions.values() for t in meaningful_py(q)}) or [""]
    most = max([len(set(meaningful_py(q))) for q in questions.values()] + [1])
    # Each level is bound by a lambda, so that a passage is taken apart once, whatever number of questions read it.
    parts = F.transform(F.array(carrying(tokens(F.concat_ws(" ", title, body)))), lambda w: F.struct(F.size(w).alias("n"), met(w, terms).alias("found"), (meaningful(title) if heading else F.array().cast("array<string>")).alias("title"), casefold(body).alias("folded")))
    views = F.transform(parts, lambda r: F.struct(r["n"].alias("n"), F.transform(_asked(questions), lambda q: _matches(q, r)).alias("v")))
    rows = cut(passages.select(*by, key, F.get(views, F.lit(0)).alias("p")).select(*by, key, "p.*"))
    count = lambda q, t: F.sum((F.get(F.get("v", F.lit(q))["tf"], F.lit(t)) > 0).cast("int"))
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("avg_n"), F.array(*(F.array(*(count(q, t) for t in range(most))) for q in range(len(questions)))).alias("df"))
    # Without groups, stats is one row.
    rows = (rows.join(stats, list(by)) if by else rows.crossJoin(F.broadcast(stats))).select(*by, key, "n", "docs", "avg_n", "df", F.posexplode("v").alias("q", "m")).withColumn("df", F.get("df", F.col("q")))
    tf = F.col("m.tf")
    raw = raw_score(tf, F.col("m.bonus"))
    share = F.when(F.size(tf) > 0, F.size(F.filter(tf, lambda x: x > 0)) / F.size(tf)).otherwise(F.lit(0.0))
    group, some = [*by, "question_id"], F.exists(tf, lambda x: x > 0) | (F.col("m.bonus") != 0)
    # A passage without a match costs no arithmetic.
    rows = rows.select(*by, F.get(F.lit(list(questions)), F.col("q")).alias("question_id"), key, F.when(some, raw).otherwise(F.lit(0.0)).alias("raw"), F.when(some, share).otherwise(F.lit(0.0)).alias("coverage"))
    best = rows.groupBy(*group).agg(F.max("raw").alias("best"))
    rows = rows.join(best if by else F.broadcast(best), group)
    score = F.round(F.least(F.lit(1.0), F.col("raw") / F.when(F.col("best") == 0, F.lit(1.0)).otherwise(F.col("best"))), 4)
    return rows.select(*group, key, score.alias("score"), "coverage")


def top(scored: DataFrame, k: int, key: str, by: Sequence[str] = ("question_id",)) -> DataFrame:
    """The k best rows of each group with their rank; equal scores go by key."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_facets(passages: DataFrame, facets: dict[str, str], key: str, text: str = "text", heading: str | None = None) -> DataFrame:
    """(key, score): the best over facets of score times coverage, divided by the best passage's; one facet is plain ranking."""
    scored = rank(passages, facets, key, text, heading)
    if len(facets) <= 1:
        return scored.select(key, "score")
    best = scored.groupBy(key).agg(F.max(F.col("score") * F.col("coverage")).alias("score"))
    most = best.agg(F.max("score").alias("most"))
    return best.crossJoin(F.broadcast(most)).select(key, F.round(F.least(F.lit(1.0), F.col("score") / F.when(F.col("most") == 0, F.lit(1.0)).otherwise(F.col("most"))), 4).alias("score"))
