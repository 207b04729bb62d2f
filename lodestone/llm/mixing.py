"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Sources share a budget of words by weight, none beyond a multiple of its size. A source first gives complete epochs;
the rest of its target is drawn in the order of exponential keys, each divided by its document's quality weight, until the words drawn fill it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, lookup_join, table, unused

WEIGHTS, SHARE, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, "mix-1"
#: Documents to a bucket of keys, about; a task sorts one bucket.
BUCKET = 5_000
#: Classes of quality weights from which the distribution of keys is drawn up.
CLASSES = 16


def quality(text: Column, size: Column) -> Column:
    """A weight from 1/16 to 1: lower for texts of few words and for those with many signs of markup or tables."""
    signs = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.0625), F.least(F.lit(1.0), size / F.lit(50.0)) * (F.lit(1.0) - F.least(F.lit(1.0), signs / F.greatest(size, F.lit(1)))))


def exponential(doc_id: Column, source: Column, weight: Column, seed: str = SEED, body: Column | None = None, copy: Column | None = None) -> Column:
    """-ln(u) / weight, with u from the hash of seed, id (`body` where there is none), source and, beyond the first, the number of the copy: the same on every run."""
    name = F.when(doc_id.isNull(), body if body is not None else F.lit("")).otherwise(doc_id.cast("string"))
    more = F.when(copy > 0, copy.cast("string")) if copy is not None else F.lit(None).cast("string")  # concat_ws passes over nulls
    digest = F.md5(F.concat_ws(":", F.lit(seed), name, F.coalesce(source, F.lit("")), more).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def allot(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with the target of each: weight times one level, but at most `most` sizes.

    A row per source goes through one task; documents don't. Sources without words get nothing.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cap, w = F.col("source_size") * F.lit(most), F.col("w")
    by = Window.orderBy(cap / w, F.col("source").asc_nulls_last())
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    left_words = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = left_words / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("_level", level).withColumn("_level", F.first(F.when(F.col("_level") * w <= cap, F.col("_level")), ignorenulls=True).over(everything))
    return s.withColumn("target", F.round(F.least(cap, F.coalesce(F.col("_level") * w, cap)), 6)).drop("_level", "w")


def bucketed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight=quality, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, bucket: int | None = None) -> DataFrame:
    """Every document with its key, its source's sums and target, and its bucket: about `bucket` documents of a source that follow one another by key."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(body).alias("body"), body.alias("text"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"))
    rows = rows.withColumn("weight", weight(F.col("text"), F.col("size"))).withColumn("named", F.when(F.col("doc_id").isNull(), F.md5(F.col("text").cast("binary")))).drop("text")
    # Repeated rows are counted first and numbered, so that each has a key of its own and they spread over the buckets.
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = rows.withColumn("key", exponential(F.col("doc_id"), F.col("source"), F.col("weight"), seed, F.col("named"), F.col("copy"))).drop("named", "copies", "copy").withColumn("group", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    rows = cut(rows)
    total = rows.count()
    classes = rows.groupBy("group", "source", F.least(F.lit(CLASSES), F.greatest(F.lit(1), F.ceil(F.col("weight") * CLASSES))).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    sources = classes.groupBy("group", "source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("c", F.col("n").alias("of")))).alias("classes"))
    sources = allot(sources, weights, share, most)
    # The share of its source's keys below a key, by the source's own weights. Any increasing function keeps the order; this one evens the buckets.
    below = F.lit(1.0) - F.aggregate("classes", F.lit(0.0), lambda s, x: s + x["of"] * F.exp(-F.col("key") * x["c"] / F.lit(float(CLASSES)))) / F.col("all_n")
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = cut(sources.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")).withColumn("buckets", F.ceil(F.col("n") / F.lit(bucket or BUCKET))).drop("source"))
    rows = lookup_join(rows, sources.withColumn("_n", F.col("n")).withColumnRenamed("n", "all_n"), "group", "_n", ["doc_id", "key"], total)
    rows = rows.withColumn("bucket", F.greatest(F.lit(0), F.least(F.floor(below * F.col("buckets")), F.col("buckets") - 1)))
    return rows


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight=quality, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, bucket: int | None = None) -> DataFrame:
    """(doc_id, source, body, size, source_size, target, taken) for every row of docs; body is the hash of the text.

    size counts words; a null text has none. A null source is a source of its own and comes last. taken is
    the words that the mix takes: whole epochs, then all of the documents drawn, of the last one drawn as many words as
    are left. Equal keys go by doc_id; repeated rows are drawn one by one. A task sorts about `bucket` (BUCKET) documents of a source,
    however large it is; only its buckets' sums, a row each, meet in one task. Other columns are ignored.
    """
    rows = bucketed(docs, doc_id, text, source, weight, weights, share, most, seed, bucket)
    filled = rows.groupBy("group", "bucket").agg(F.sum("size").alias("held"))
    filled = filled.withColumn("first", F.sum("held").over(Window.partitionBy("group").orderBy("bucket")) - F.col("held")).drop("held")
    inside = Window.partitionBy("group", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = rows.join(filled, ["group", "bucket"]).withColumn("before", F.col("first") + F.sum("size").over(inside) - F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return drawn.select("doc_id", "source", "body", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def take(docs: DataFrame, taken: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document as often as taken, the last draw of a source cut to its first words (single blanks).

    Repeated rows, which mix() draws one by one, share a text, so what they take in all is given from one of them. Documents without words are not in a mix.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key, all_words, own_words, copy = unused(docs, "_ident", "_taken", "_size", "_words")
    ident = lambda d, s, b: F.struct(d.isNull().alias("a"), F.coalesce(d.cast("long"), F.lit(0)).alias("b"), s.isNull().alias("c"), F.coalesce(s, F.lit("")).alias("d"), b.alias("e"))
    sums = taken.groupBy(ident(F.col("doc_id"), F.col("source"), F.col("body")).alias(key)).agg(F.sum("taken").alias(all_words), F.max("size").alias(own_words)).filter(F.col(all_words) > 0)
    rows = docs.withColumn(key, ident(F.col(doc_id), F.col(source).cast("string"), F.xxhash64(body)))
    rows = rows.dropDuplicates([key]).join(sums, key)  # combined before the shuffle: one text of each document in a task travels
    whole, over = F.floor(F.col(all_words) / F.col(own_words)).cast("int"), (F.col(all_words) % F.col(own_words)).cast("int")
    rows = rows.withColumn(copy, F.explode(F.concat(F.array_repeat(F.lit(-1), whole), F.when(over > 0, F.array(over)).otherwise(F.array().cast("array<int>")))))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return rows.withColumn(text, F.when(F.col(copy) < 0, F.col(text)).otherwise(F.array_join(F.slice(words, 1, F.greatest(F.col(copy), F.lit(0))), " "))).select(*docs.columns)


def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), md5(text)) || ':' || coalesce(source, '')), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE)
    / greatest(0.0625::DOUBLE, least(1.0::DOUBLE, size / 50.0::DOUBLE) * (1.0::DOUBLE - least(1.0::DOUBLE, (length(text) - length(translate(text, '#*$%&|<>', ''))) / CAST(greatest(size, 1) AS DOUBLE)))) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS w FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level, cap / w AS ratio
    FROM w WINDOW b AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE level * w <= cap ORDER BY ratio, source ASC NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, round(least(cap, coalesce((SELECT level FROM f) * w, cap)), 6) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, CAST(floor(e.target - e.epochs * e.source_size) AS BIGINT) AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size AS before
    FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r
""",
}
