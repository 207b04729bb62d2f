"""Search results: records from backend rows, merging, filters, order, snippets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as X
from lodestone.functions import urls as U

#: A backend's row; unknown fields are passed over.
ROW = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("url", "title", "content", "engine", "publishedDate", "published_date")] + [T.StructField("engines", T.ArrayType(T.StringType()))]))
QUARANTINED = "[quarantined high-risk search snippet]"
#: Vertical routing: categories and the words that ask for them (fixed values).
VERTICALS = {
    "it": r"\b(?:bug|build|cargo|code|compile|compiler|debug|dependency|docker|error|exception|failed|failure|git|install|installation|issue|npm|package|pip|runtime|stack\s+trace|syntax|traceback|troubleshoot)\b",
    "science": r"\b(?:arxiv|clinical|doi|experiment|journal|paper|peer-reviewed|science|scientific|study)\b",
    "news": r"\b(?:breaking|election|headline|news|today|this week)\b",
}


def from_payload(payloads: DataFrame, key: str, payload: str, limit: int) -> DataFrame:
    """(key, pos, url, title, snippet, engine, engines, published_at, rank, search_score): the first `limit` rows of each JSON array.

    Rows that are not objects are dropped; a bad date is null; rank counts from 1 and the score falls by a twentieth per row.
    """
    rows = payloads.select(key, F.posexplode(F.slice(F.from_json(payload, ROW), 1, limit)).alias("pos", "r")).filter("r is not null")
    date = F.coalesce("r.publishedDate", "r.published_date")
    engine = F.coalesce("r.engine", F.get("r.engines", F.lit(0)), F.lit("unknown"))
    engines = F.when(F.size("r.engines") > 0, F.col("r.engines")).otherwise(F.array(engine))
    return rows.select(
        key, "pos", F.coalesce("r.url", F.lit("")).alias("url"), F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.content", F.lit("")).alias("snippet"), engine.alias("engine"), engines.alias("engines"),
        F.try_to_timestamp(date).alias("published_at"), (F.col("pos") + 1).alias("rank"), F.greatest(F.lit(0.0), 1 - F.col("pos") / 20).alias("search_score"),
    )


def recency_bucket(days: Column) -> Column:
    return F.when(days <= 1, "day").when(days <= 31, "month").when(days.isNotNull(), "year")


def categories(question: Column) -> Column:
    return F.concat_ws(",", F.lit("general"), *(F.when(question.rlike("(?i)" + p), F.lit(k)) for k, p in VERTICALS.items()))


def normalize(rows: DataFrame) -> DataFrame:
    """url, canonical_url, domain, title, snippet and engines in normal form."""
    rows = rows.withColumn("url", U.normalize("url"))
    canonical = F.coalesce(U.normalize(F.nullif(F.col("canonical_url"), F.lit(""))), F.col("url")) if "canonical_url" in rows.columns else F.col("url")
    return rows.withColumns({"canonical_url": canonical, "domain": U.host("url"), "title": X.compact("title"), "snippet": X.compact("snippet"), "engines": F.array_sort(F.array_distinct("engines"))})


def merge_exact(rows: DataFrame, by: Sequence[str] = (), order: str = "pos") -> DataFrame:
    """One row per canonical URL (else URL): the first, with all engines, the best score and the longest snippet, the earlier of equal ones."""
    key = F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), F.col("url")).alias("result_key")
    rest = [c for c in rows.columns if c not in (*by, "engines", "search_score", "snippet")]
    longest = F.min(F.struct((-F.length("snippet")).alias("n"), F.col(order).alias("o"), F.col("snippet").alias("s")))
    merged = rows.groupBy(*by, key).agg(F.min(F.struct(F.col(order).alias("_o"), *rest)).alias("_first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("engines")))).alias("engines"), F.max("search_score").alias("search_score"), longest.alias("_long"))
    return merged.select(*by, *(F.col(f"_first.{c}").alias(c) for c in rest), "engines", "search_score", F.col("_long.s").alias("snippet"))


def domain_filter(rows: DataFrame, domain: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Keep rows under an included domain (all, if none is given) and under no excluded one."""
    fits = lambda ds: F.exists(F.lit([d.lower().lstrip(".") for d in ds]), lambda d: U.under(F.col(domain), d))
    rows = rows.filter(fits(include)) if include else rows
    return rows.filter(~fits(exclude)) if exclude else rows


def snippets(rows: DataFrame, limit: int = 20, by: Sequence[str] = (), order: str | Sequence[str | Column] = "pos") -> DataFrame:
    """Numbered, cited and screened snippets, the first `limit` with any text; high-risk ones keep their rank and lose title and text."""
    text, named = X.compact("snippet"), rows.filter((F.trim("snippet") != "") | (F.trim("title") != ""))
    reasons = X.injection_reasons(F.concat(F.col("title"), F.lit("\n"), text))
    named = named.withColumns({"injection_reasons": reasons, "text": text}).withColumn("injection_risk", X.injection_risk(F.col("injection_reasons")))
    high = F.col("injection_risk") == "high"
    named = named.withColumns({"title": F.when(high, QUARANTINED).otherwise(F.col("title")), "text": F.when(high, "").otherwise(F.col("text")), "url": U.redact("url")})
    named = named.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*([order] if isinstance(order, str) else order)))).filter(F.col("_n") <= min(limit, 20))
    label = F.format_string("search_%03d", "_n")
    return named.withColumns({"snippet_id": label, "citation": F.concat(F.lit("["), label, F.lit("]"))}).drop("_n", "snippet")


def interleave(rows: DataFrame, group: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Round robin over the groups in their order, numbered anew from 1."""
    dealt = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, group).orderBy(order)))
    return dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_r", group))).drop("_r")
