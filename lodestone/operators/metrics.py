"""Scores of runs and answers against gold facts, and the aggregates that reports show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.functions.text import citations

#: The baseline and the three modes that an evaluation runs.
EVALUATED = ("raw", "quick", "standard", "deep")
ABSTAIN = r"(?i)\b(?:insufficient|not enough|cannot determine|does not (?:provide|specify|state|identify)|not provided)\b"
MONTHS = r"(?i)\b(Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\."


def matches_any(text: Column, patterns: Column) -> Column:
    """One of the patterns is found, whatever the case; a dot meets line ends."""
    return F.exists(patterns, lambda p: F.regexp_like(text, F.concat(F.lit("(?is)"), p)))


def claim_units(answer: Column) -> Column:
    """Sentences of an answer that claim something: without bullets, headings and lead-ins; months' dots end no sentence."""
    lines = F.transform(F.split(answer, r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-*• ]+", "")))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    parts = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, MONTHS, "$1\x01"), r"(?<=[.!?])\s+(?=[A-Z0-9])")))
    words = lambda p: F.size(F.regexp_extract_all(p, F.lit("([A-Za-z]+)"), F.lit(1)))
    cited = lambda p: (F.size(citations(p)) > 0) & p.rlike(r"\d|[A-Za-z]{2}")
    return F.filter(F.transform(parts, lambda p: F.replace(p, F.lit("\x01"), F.lit("."))), lambda p: ~F.rtrim(p).endswith(":") & ((words(p) >= 3) | cited(p)))


def readiness(runs: DataFrame, contexts: DataFrame, gold: DataFrame, run: Sequence[str], question: str) -> DataFrame:
    """A row per run: fact recall, precision, preferred-source hit, integrity, traceability, cited recall and the composite.

    runs: run, question; contexts: run, text, domain, kind (evidence or snippet), valid, traceable; gold: question, assertions
    array<struct<label, patterns>>, preferred_domains. Assertions meet a run's contexts within its question only. Runs without contexts score 0.
    """
    keys = list(run)
    rows = runs.join(gold, question).join(contexts, keys, "left").withColumn("hits", F.when(F.col("text").isNotNull(), F.transform("assertions", lambda a: matches_any(F.col("text"), a["patterns"]))))
    bearing = F.coalesce(F.exists("hits", lambda h: h), F.lit(False))
    preferred = F.coalesce(F.exists("preferred_domains", lambda d: U.under(F.col("domain"), d)), F.lit(False))
    there, cited = F.col("text").isNotNull(), F.coalesce("valid", F.lit(False))
    union = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(c, F.filter(F.transform("hits", lambda h, i: F.when(h, i)), lambda i: i.isNotNull()))))))
    ratio = lambda a, b: F.coalesce(F.count_if(a) / F.greatest(F.lit(1), F.count_if(b)), F.lit(0.0))
    got = rows.groupBy(*keys, question).agg(
        F.first(F.greatest(F.lit(1), F.size("assertions"))).alias("n"), union(there).alias("found"), union(there & cited).alias("cited"), ratio(there & bearing, there).alias("precision"),
        F.coalesce(F.bool_or(bearing & preferred), F.lit(False)).cast("double").alias("preferred"), ratio((F.col("kind") == "evidence") & cited, F.col("kind") == "evidence").alias("integrity"), ratio(F.coalesce("traceable", F.lit(False)), there).alias("traceability"),
    )
    recall = F.col("found") / F.col("n")
    composite = 100 * (0.55 * recall + 0.15 * F.col("precision") + 0.15 * F.col("preferred") + 0.15 * F.col("traceability"))
    four = lambda c: F.round(c, 4)
    return got.select(*keys, question, four(recall).alias("fact_recall"), four("precision").alias("fact_precision"), F.col("preferred").alias("preferred_source_hit"), four("integrity").alias("citation_integrity"), four("traceability").alias("context_traceability"), four(F.col("cited") / F.col("n")).alias("cited_fact_recall"), F.round(composite, 2).alias("readiness"))


def answer_scores(answers: DataFrame, key: str, answer: str = "answer", assertions: str = "assertions", cited: str = "contexts") -> DataFrame:
    """A row per answer. contexts: map from valid citation labels to their texts; an abstention recalls nothing."""
    rows = answers.withColumn("units", F.transform(claim_units(F.col(answer)), lambda u: F.struct(u.alias("text"), citations(u).alias("labels"))))
    valid = lambda c: F.map_contains_key(F.col(cited), c)
    hit = lambda a: matches_any(F.col(answer), a["patterns"])
    grounded = lambda a: F.exists("units", lambda u: matches_any(u["text"], a["patterns"]) & F.exists(u["labels"], lambda c: valid(c) & matches_any(F.coalesce(F.element_at(F.col(cited), c), F.lit("")), a["patterns"])))
    n = F.greatest(F.lit(1), F.size(assertions))
    labels = F.flatten(F.transform("units", lambda u: u["labels"]))
    share = lambda part, whole: F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(F.lit(0.0))
    abstained = F.col(answer).rlike(ABSTAIN)
    rows = rows.withColumns({
        "recall": F.when(abstained, F.lit(0.0)).otherwise(F.size(F.filter(assertions, hit)) / n), "grounded": F.when(abstained, F.lit(0.0)).otherwise(F.size(F.filter(assertions, grounded)) / n),
        "precision": share(F.filter(labels, valid), labels), "coverage": share(F.filter("units", lambda u: F.exists(u["labels"], valid)), F.col("units")),
    })
    score = 100 * (0.55 * F.col("recall") + 0.20 * F.col("grounded") + 0.15 * F.col("precision") * F.col("recall") + 0.10 * F.col("coverage") * F.col("recall"))
    four = lambda c: F.round(c, 4)
    return rows.select(key, four("recall").alias("fact_recall"), four("grounded").alias("grounded_recall"), four("precision").alias("citation_precision"), four("coverage").alias("claim_coverage"), F.coalesce(abstained, F.lit(False)).alias("abstained"), F.size("units").alias("claims"), F.round(score, 2).alias("quality"))


def means(runs: DataFrame, by: Sequence[str], measures: Sequence[str], repeat: str) -> DataFrame:
    """Means by mode: over all runs, over first and over later repeats; null where there are none."""
    first = F.col(repeat) == 1
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *(F.round(F.avg(c), 4).alias(c) for m in measures for c in [m]), *(F.round(F.avg(F.when(first, F.col(m))), 4).alias(f"{m}_first") for m in measures), *(F.round(F.avg(F.when(~first, F.col(m))), 4).alias(f"{m}_later") for m in measures))


def evaluation(questions: DataFrame, runs: DataFrame, question: str, timeout: float, modes: Sequence[str] = EVALUATED) -> DataFrame:
    """A row for every question and mode: elapsed, sources, evidence, coverage and error. A run over the timeout counts as an error and gives nothing; so does one that is missing.

    questions meet the few modes in their rows; runs: question, mode, elapsed, sources, evidence, coverage.
    """
    rows = questions.select(question, F.explode(F.lit(list(modes))).alias("mode")).join(runs, [question, "mode"], "left")
    fine = F.coalesce(F.col("elapsed") <= timeout, F.lit(False))
    given = {c: F.when(fine, F.col(c)).otherwise(F.lit(0)) for c in ("sources", "evidence")}
    error = F.when(F.col("elapsed").isNull(), "NotRun").when(~fine, "TimeoutError").otherwise("")
    return rows.withColumns({**given, "coverage": F.when(fine, F.col("coverage")), "error": error}).withColumn("elapsed", F.least("elapsed", F.when(F.col("elapsed").isNotNull(), F.lit(timeout))))


def size_audit(rows: DataFrame, by: Sequence[str], size: str, budget: int) -> DataFrame:
    return rows.groupBy(*by).agg(F.median(size).alias("median"), F.max(size).alias("largest"), F.min(size).alias("smallest"), F.count_if(F.col(size) > budget).alias("over"))


def hit_rate(lookups: DataFrame, by: Sequence[str], hit: Column) -> DataFrame:
    """Hits, misses and their rate, three digits."""
    return lookups.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses")).withColumn("rate", F.round(F.col("hits") / F.greatest(F.lit(1), F.col("hits") + F.col("misses")), 3))


def duplicate_rate(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(1 - F.countDistinct(value) / F.greatest(F.lit(1), F.count(F.lit(1))), 4).alias("duplicate_rate"))
