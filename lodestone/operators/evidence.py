"""Evidence: near-duplicate results, diverse selection, coverage of topics, numeric contradictions."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import bind, coverage, meaningful, meaningful_py, tokens_py
from lodestone.plans.lineage import cut

from .near import SNIPPET_RATIO, TITLE_RATIO, alike

ADMIT, FLOOR, PER_SOURCE = 0.18, 0.50, 2
NEW_SOURCE, SIMILAR, REPEATED = 0.08, 0.25, 0.06
#: A value with its unit (fixed value).
VALUE = r"(?i)\b(?:v(?:ersion)?\s*)?(\d+(?:\.\d+){0,3})(?:\s*(%|ms|gb|mb|usd|\$))?\b"
PRIMARY = ("official_documentation", "primary_institution", "source_repository")


# ---- near duplicates of one question's results ----


def merge_near(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one group in order; each joins the first kept row that it repeats."""
    kept: list[dict] = []
    for row in pdf.sort_values("pos", kind="stable").to_dict("records"):
        row["engines"] = sorted(set(row["engines"]))
        title, snippet = row["title"].casefold(), row["snippet"].casefold()
        for k in kept:
            same = row["canonical_url"] == k["canonical_url"]
            if same or (row["domain"] == k["domain"] and (alike(title, k["title"].casefold(), TITLE_RATIO) or (snippet and k["snippet"] and alike(snippet, k["snippet"].casefold(), SNIPPET_RATIO)))):
                k["engines"] = sorted({*k["engines"], *row["engines"]})
                k["search_score"] = max(k["search_score"], row["search_score"])
                if len(row["snippet"]) > len(k["snippet"]):
                    k["snippet"] = row["snippet"]
                break
        else:
            kept.append(row)
    return pd.DataFrame(kept, columns=pdf.columns)


def merge_few(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """near_results() for groups that a question's budget of raw results has bounded (at most 100): one task folds a group at once."""
    return rows.groupBy(*by).applyInPandas(merge_near, rows.schema)


# ---- selection ----


def select_diverse(pdf: pd.DataFrame, limit: int, facets: Sequence[str], question: str | None, rest: dict | None = None) -> pd.DataFrame | None:
    """One question's admitted passages, best and most different first; adds `position` from 1.

    rest: by source, the best base score of rows that are not in pdf and that no reservation would take. None if one of them might be selected.
    """
    rest = rest or {}
    rows = pdf.sort_values("pos", kind="stable").to_dict("records")
    for r in rows:
        r["base"] = 0.45 * r["passage_score"] + 0.30 * r["source_score"] + 0.25 * r["quality"]
        r["words"], r["terms"] = set(tokens_py(r["text"])), set(meaningful_py(r["text"]))
    left, taken, count = [r for r in rows if r["source_score"] >= ADMIT], [], {}

    def take(r: dict) -> None:
        left.remove(r)
        taken.append(r)
        count[r["source_id"]] = count.get(r["source_id"], 0) + 1

    def reserve(asked: str, fits) -> None:
        terms = set(meaningful_py(asked))
        need = 1.0 if len(terms) <= 2 else 0.60
        share = lambda r: len(terms & r["terms"]) / max(1, len(terms))
        found = [r for r in left if fits(r) and share(r) >= need]
        if found:
            take(max(found, key=lambda r: (share(r), r["base"])))  # max keeps the first of equals

    if question and limit > 0:
        reserve(question, lambda r: r["authority"])
    for facet in facets:
        if len(taken) < limit:
            reserve(facet, lambda r: count.get(r["source_id"], 0) < PER_SOURCE)
    if left:
        best = max([r["base"] for r in left] + list(rest.values()))
        left[:] = [r for r in left if r["base"] >= best * FLOOR]
        rest = {s: b for s, b in rest.items() if b >= best * FLOOR}
    while len(taken) < limit:
        open_to = [r for r in left if count.get(r["source_id"], 0) < PER_SOURCE]
        # What a row outside could gain at most: without any likeness to what is taken.
        outside = max((b + (NEW_SOURCE if s not in count else 0.0) - REPEATED * count.get(s, 0) for s, b in rest.items() if count.get(s, 0) < PER_SOURCE), default=None)
        if not open_to:
            if outside is not None:
                return None
            break

        def gain(r: dict) -> float:
            near = max((len(r["words"] & t["words"]) / max(1, len(r["words"] | t["words"])) for t in taken), default=0.0)
            return r["base"] + (NEW_SOURCE if r["source_id"] not in count else 0.0) - SIMILAR * near - REPEATED * count.get(r["source_id"], 0)

        chosen = max(open_to, key=gain)
        if outside is not None and gain(chosen) <= outside + 1e-9:
            return None
        take(chosen)
    out = pd.DataFrame(taken, columns=[*pdf.columns, "base", "words", "terms"])[list(pdf.columns)]
    return out.assign(position=range(1, len(out) + 1))


def diverse(rows: DataFrame, by: Sequence[str], limit: int, facets: Sequence[str] = (), question: str | None = None, candidates: int = 50) -> DataFrame:
    """Evidence of each question. rows: by, pos, source_id, text, passage_score, source_score, quality, authority.

    Groups can have any size. What Python folds is every row that a reservation can take, and the `candidates` best of each source, eight times as many
    at most; of the others it gets each source's best base score. A group whose choice these scores leave open is folded again with four times as many.
    """
    keys, base = list(by), 0.45 * F.col("passage_score") + 0.30 * F.col("source_score") + 0.25 * F.col("quality")
    asks = [*([question] if question and limit > 0 else []), *facets]
    left = rows.filter(F.col("source_score") >= ADMIT).withColumn("_base", base).withColumn("_terms", F.array_distinct(meaningful("text")))
    # Before the last reservation len(asks) - 1 rows are taken and half as many sources are full, so a free row is among these.
    own = len(asks)
    most = (own // 2 + 1) * own + own
    for at, asked in enumerate(asks):
        terms = sorted(set(meaningful_py(asked)))
        share = F.size(F.array_intersect("_terms", F.lit(terms) if terms else F.array().cast("array<string>"))) / F.lit(max(1, len(terms)))
        can = (share >= F.lit(1.0 if len(terms) <= 2 else 0.60)) & (F.col("authority") if question and limit > 0 and at == 0 else F.lit(True))
        left = left.withColumn(f"_share{at}", share).withColumn(f"_can{at}", F.coalesce(can, F.lit(False)))
    # Texts stay where they are; only scores are sorted.
    left = cut(left.drop("_terms")).withColumn("_row", F.monotonically_increasing_id())
    texts, left = left.select(*rows.columns, "_row"), left.select(*dict.fromkeys([*keys, "source_id", "pos"]), "_row", "_base", *(f"_{x}{at}" for at in range(own) for x in ("share", "can")))
    fits = F.lit(False)
    for at in range(own):
        order = [F.desc(f"_can{at}"), F.desc(f"_share{at}"), F.desc("_base"), F.asc("pos")]
        left = left.withColumn(f"_s{at}", F.row_number().over(Window.partitionBy(*keys, "source_id").orderBy(*order)))
    for at in range(own):
        order = [F.desc(f"_can{at}"), F.desc(f"_share{at}"), F.desc("_base"), F.asc("pos")]
        left = left.withColumn(f"_can{at}", F.col(f"_can{at}") & (F.col(f"_s{at}") <= own))
        left = left.withColumn(f"_k{at}", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        fits = fits | (F.col(f"_can{at}") & (F.col(f"_k{at}") <= most))
    left = left.withColumn("_fits", fits).withColumn("_s", F.row_number().over(Window.partitionBy(*keys, "source_id").orderBy(F.desc("_base"), "pos")))
    left = cut(left.select(*dict.fromkeys([*keys, "source_id", "pos"]), "_row", "_base", "_fits", "_s"))
    schema, done = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes), []

    def fold(pdf: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pdf.assign(position=pd.Series(dtype="int32"))
        out = select_diverse(pdf, limit, facets, question, dict(zip(rest["_source"], rest["_best"], strict=True)))
        return pdf.head(1).assign(position=-1) if out is None else out

    while True:
        ranked = left.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_s") > candidates, F.desc("_base"), "pos")))
        ranked = ranked.withColumn("_in", F.col("_fits") | ((F.col("_s") <= candidates) & (F.col("_k") <= 8 * candidates)))
        rest = ranked.filter(~F.col("_in")).groupBy(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(keys)), F.col("source_id").alias("_source")).agg(F.max("_base").alias("_best"))
        out = cut(texts.join(ranked.filter("_in").select("_row"), "_row").select(*rows.columns).groupBy(*keys).cogroup(rest.groupBy(*(f"_by{i}" for i in range(len(keys))))).applyInPandas(fold, f"{schema}, position int"))
        done.append(out.filter("position > 0"))
        again = out.filter("position < 0").select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(keys)))
        if again.isEmpty():
            break
        left = left.join(again, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(keys)], "left_semi")
        candidates *= 4
    return functools.reduce(DataFrame.unionByName, done)


def capped(rows: DataFrame, by: Sequence[str], source: str, score: str, order: str, limit: int, per_source: int = PER_SOURCE) -> DataFrame:
    """The selection without its similarity term: the best rows with at most two of a source, by windows alone."""
    rows = rows.withColumn("_s", F.row_number().over(Window.partitionBy(*by, source).orderBy(F.desc(score), order))).filter(F.col("_s") <= per_source)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), order))).filter(F.col("position") <= limit).drop("_s")


# ---- coverage ----


def required(terms: Column, share: float = 0.60) -> Column:
    return F.when(F.size(terms) <= 2, F.lit(1.0)).otherwise(F.lit(share))


def topic_coverage(topics: DataFrame, evidence: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, pos, topic, best, covered): the best evidence for each topic. topics: by, pos, topic; evidence: by, evidence_id, text, risk.

    A question's topics, eight at most, meet each of its records in one row; texts are neither repeated nor gathered. High-risk evidence
    doesn't count. A topic without words is missing.
    """
    keys = list(by)
    asked = topics.withColumn("_terms", F.array_distinct(meaningful("topic")))
    sets = asked.groupBy(*keys).agg(F.collect_list(F.struct("pos", "_terms")).alias("_asked"))
    words = evidence.filter("risk <> 'high'").select(*keys, F.array_distinct(meaningful("text")).alias("_doc"))
    met = words.join(sets, keys).select(*keys, F.explode(F.transform("_asked", lambda a: F.struct(a["pos"].alias("pos"), coverage(a["_terms"], F.col("_doc")).alias("share")))).alias("_m"))
    best = met.groupBy(*keys, F.col("_m.pos").alias("pos")).agg(F.max("_m.share").alias("best"))
    rows = asked.join(best, [*keys, "pos"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    rows = rows.withColumn("covered", F.col("best") >= required(F.col("_terms")))
    return rows.select(*keys, "pos", "topic", F.round("best", 4).alias("best"), "covered")


def coverage_report(topics: DataFrame, evidence: DataFrame, sources: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, score, status, covered, missing, independent_sources, primary_source), a row per question with topics.

    sources: by, source_id, domain, relevance, source_type. Only admitted sources with evidence that isn't high-risk count; all evidence adds strength.
    """
    keys = list(by)
    per_topic = topic_coverage(topics, evidence, by).groupBy(*keys).agg(F.count_if("covered").alias("covered"), F.count_if(~F.col("covered")).alias("missing"))
    strength = evidence.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_evidence"))
    backed = sources.join(evidence.filter("risk <> 'high'").select(*keys, "source_id").distinct(), [*keys, "source_id"], "left_semi").filter(F.col("relevance") >= ADMIT)
    primary = (F.col("relevance") >= 0.25) & F.col("source_type").isin(*PRIMARY)
    backed = backed.groupBy(*keys).agg(F.countDistinct("domain").alias("independent_sources"), F.bool_or(primary).alias("primary_source"))
    rows = per_topic.join(strength, keys, "left").join(backed, keys, "left").na.fill(0, ["n_evidence", "independent_sources"])
    share = F.col("covered") / F.greatest(F.lit(1), F.col("covered") + F.col("missing"))
    score = F.round(0.55 * share + 0.25 * F.least(F.lit(1.0), F.col("independent_sources") / 3) + 0.20 * F.least(F.lit(1.0), F.col("n_evidence") / 8), 3)
    status = F.when(F.col("score") >= 0.8, "strong").when(F.col("score") >= 0.6, "moderate").when(F.col("score") >= 0.3, "weak").otherwise("insufficient")
    return rows.withColumn("score", score).select(*keys, "score", status.alias("status"), "covered", "missing", "independent_sources", F.coalesce("primary_source", F.lit(False)).alias("primary_source"))


def missing_facets(coverages: DataFrame) -> DataFrame:
    return coverages.filter(~F.col("covered"))


def snippet_covered(snippet: Column, evidence: Column) -> Column:
    """The evidence states at least four (or all) and 65 % of the snippet's words; an empty snippet is covered."""
    shared = lambda r: F.size(F.array_intersect(r["s"], r["e"]))
    return bind(
        F.struct(F.array_distinct(meaningful(snippet)).alias("s"), meaningful(evidence).alias("e")),
        lambda r: (F.size(r["s"]) == 0) | ((shared(r) >= F.least(F.lit(4), F.size(r["s"]))) & (shared(r) / F.size(r["s"]) >= 0.65)),
    )


# ---- contradictions ----


def stated_numbers(evidence: DataFrame, by: Sequence[str], key: str = "evidence_id", order: str = "pos", text: str = "text") -> DataFrame:
    """(by, key, order, topic, unit, number, _i): every number with its unit, and the words that its record opens with."""
    t = F.col(text)
    words = F.slice(F.regexp_extract_all(F.lower(t), F.lit("([a-z][a-z0-9_-]{2,})"), F.lit(1)), 1, 4)
    found = F.arrays_zip(F.regexp_extract_all(t, F.lit(VALUE), F.lit(1)).alias("number"), F.regexp_extract_all(t, F.lit(VALUE), F.lit(2)).alias("unit"))
    rows = evidence.select(*by, key, order, F.array_join(words, " ").alias("topic"), F.posexplode(found).alias("_i", "v"))
    return rows.select(*by, key, order, "topic", "_i", F.col("v.number").alias("number"), F.lower("v.unit").alias("unit"))


def conflicts(stated: DataFrame, by: Sequence[str], key: str = "evidence_id", order: str = "pos") -> DataFrame:
    """(by, topic, unit, _first): the topics and units with more than one number and more than one record.

    Two values differ exactly if the least and the greatest do, so a group is five values in the map-side combine, whatever its size.
    """
    ends = [f(c).alias(f"_{f.__name__}_{c}") for c in ("number", key) for f in (F.min, F.max)]
    got = stated.groupBy(*by, "topic", "unit").agg(*ends, F.min(F.struct(order, "_i")).alias("_first"))
    return got.filter((F.col("_min_number") != F.col("_max_number")) & (F.col(f"_min_{key}") != F.col(f"_max_{key}"))).select(*by, "topic", "unit", "_first")


def conflicting_values(evidence: DataFrame, by: Sequence[str], key: str = "evidence_id", order: str = "pos", text: str = "text") -> DataFrame:
    """(by, topic, unit, number, records, first): a row per number that a conflicting topic and unit has, with how many records state it and which first.

    For corpora: a topic that many records share stays rows, where contradictions() gathers a list of ids.
    """
    stated = stated_numbers(evidence, by, key, order, text)
    # A record that states a number twice counts once; then each number is one row.
    once = stated.groupBy(*by, "topic", "unit", "number", key).agg(F.min(F.struct(order, "_i")).alias("_at"))
    per = once.groupBy(*by, "topic", "unit", "number").agg(F.count(F.lit(1)).alias("records"), F.min(F.struct("_at", key)).alias("_f"), F.max(key).alias("_most"), F.min(key).alias("_least"))
    group = Window.partitionBy(*by, "topic", "unit")
    ends = {"_a": F.min("number").over(group), "_b": F.max("number").over(group), "_c": F.min("_least").over(group), "_d": F.max("_most").over(group)}
    return per.withColumns(ends).filter("_a <> _b and _c <> _d").select(*by, "topic", "unit", "number", "records", F.col(f"_f.{key}").alias("first"))


def contradictions(evidence: DataFrame, by: Sequence[str], key: str = "evidence_id", order: str = "pos", text: str = "text", limit: int | None = 10) -> DataFrame:
    """(by, topic, unit, evidence_ids, description): numbers that differ between records that open alike; the first `limit` of each group.

    With a limit, ids and numbers are gathered for the chosen topics and units only. Lists are as long as a topic's records are many: over whole
    corpora take conflicting_values().
    """
    rows = stated_numbers(evidence, by, key, order, text)
    if limit is not None:
        first = Window.partitionBy(*by).orderBy("_first")
        chosen = conflicts(rows, by, key, order).withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= limit).select(*(F.col(c).alias(f"_{c}") for c in (*by, "topic", "unit")))
        same = F.lit(True)
        for c in (*by, "topic", "unit"):
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        rows = rows.join(chosen, same, "left_semi")
    got = rows.groupBy(*by, "topic", "unit").agg(F.array_sort(F.collect_set("number")).alias("numbers"), F.array_sort(F.collect_set(F.struct(order, key))).alias("ids"))
    got = got.withColumn("evidence_ids", F.array_distinct(F.transform("ids", lambda x: x[key]))).filter((F.size("numbers") > 1) & (F.size("evidence_ids") > 1))
    return got.select(*by, "topic", "unit", "evidence_ids", F.concat(F.lit("Conflicting numeric or version values found: "), F.array_join("numbers", ", ")).alias("description"))


def content_dedup(pages: DataFrame, by: Sequence[str], text: str, order: str) -> DataFrame:
    """pages with content_hash and duplicate: true for all but the first page of a hash, which are failures of the stage `deduplication`."""
    rows = pages.withColumn("content_hash", F.sha2(F.col(text), 256))
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(*by, "content_hash").orderBy(order)) > 1)


def failure_histogram(failures: DataFrame, by: Sequence[str], stage: str, error: str, order: str, most: int = 6) -> DataFrame:
    """(by, stage, error, count): the most frequent failures of each group, ties by the first seen."""
    n = failures.groupBy(*by, stage, error).agg(F.count(F.lit(1)).alias("count"), F.min(order).alias("_first"))
    return n.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "_first"))).filter(F.col("_k") <= most).drop("_k", "_first")


