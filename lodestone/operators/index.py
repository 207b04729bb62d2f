"""A persisted inverted index: the best passages of a question from postings alone, exactly.

Passages are dealt over blocks by the hash of their keys, so that a common term is in every block and no block is larger than others.
A block's postings lie in one partition folder in order of their terms: a question reads the row groups of its terms. For every term
and block the index also holds the most that the term can add to a score there. The blocks that can hold most are scored first;
their k-th score rules out all blocks that cannot reach it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import bind, carrying, casefold, inflection, meaningful_py, tokens
from lodestone.plans.lineage import cut

from . import rank as R


#: Text that a block holds, about, so that a task sorts a block's postings in memory; and the fewest blocks.
BLOCK_BYTES, LEAST_BLOCKS = 32 << 20, 8


def blocks_for(passages: DataFrame, text: str = "text") -> int:
    """Blocks for a corpus: their number grows with its bytes, a block does not."""
    size = passages.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(LEAST_BLOCKS, math.ceil(size / BLOCK_BYTES))


def _places(terms: Column) -> Column:
    """array<struct<term, places>>: each term of one passage once, with its places in order."""
    at = lambda i, e: F.struct(F.get(e, i)["term"].alias("term"), i.alias("i"))
    inside = lambda e, i, end: F.transform(F.slice(e, i + 1, end - i), lambda x: x["p"])

    def runs(e: Column) -> Column:
        first = F.filter(F.transform(F.sequence(F.lit(0), F.size(e) - 1), lambda i: at(i, e)), lambda x: (x["i"] == 0) | (F.get(e, x["i"] - 1)["term"] != x["term"]))
        return bind(first, lambda s: F.transform(s, lambda x, k: F.struct(x["term"].alias("term"), inside(e, x["i"], F.coalesce(F.get(s, k + 1)["i"], F.size(e))).alias("places"))))

    return bind(F.array_sort(F.transform(terms, lambda t, p: F.struct(t.alias("term"), p.alias("p")))), runs)


def build(passages: DataFrame, key: str, folder: str, text: str = "text", blocks: int | None = None) -> None:
    """Write the index of passages (key, text) below folder: postings, passages with their folded text, bounds and totals.

    Keys are distinct and not null; null texts are empty. Only whole texts are shuffled, by block, once for the passages and once for the postings: a
    passage's words meet in its own row and are sorted in its block's task. An index is written once; to renew it, write another.
    """
    spark, n = passages.sparkSession, blocks or blocks_for(passages, text)
    block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block")
    parts = passages.select(block, F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body")).repartitionById(n, F.col("block"))
    parts.sortWithinPartitions("block", "key").select("block", "key", casefold(F.col("body")).alias("folded")).write.partitionBy("block").parquet(f"{folder}/passages")
    found = bind(carrying(tokens(F.col("body"))), lambda w: F.struct(F.size(w).alias("n"), F.when(F.size(w) > 0, _places(F.transform(w, inflection))).alias("terms")))
    postings = parts.select("block", "key", found.alias("w")).select("block", "key", "w.n", F.explode("w.terms").alias("t")).select("block", "key", "n", "t.term", "t.places")
    postings.sortWithinPartitions("block", "term", "key").write.partitionBy("block").parquet(f"{folder}/postings")
    words = spark.read.parquet(f"{folder}/postings").agg(F.sum(F.size("places")).alias("words"))
    docs = spark.read.parquet(f"{folder}/passages").agg(F.count(F.lit(1)).alias("docs"))
    docs.crossJoin(words).select("docs", F.try_divide(F.coalesce("words", F.lit(0)), "docs").alias("avg_n")).write.parquet(f"{folder}/totals")  # a row each
    totals = spark.read.parquet(f"{folder}/totals")
    rows = spark.read.parquet(f"{folder}/postings").crossJoin(F.broadcast(totals))  # one row
    most = F.max(R.saturated(F.size("places"), F.col("n"), F.col("avg_n"))).alias("most")
    rows.groupBy("term", "block").agg(F.count(F.lit(1)).alias("df"), most).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/bounds")


class Index:
    """Searches in what build() has written."""

    def __init__(self, spark: SparkSession, folder: str):
        read = lambda name: spark.read.parquet(f"{folder}/{name}")
        self.spark, self.postings, self.passages, self.bounds = spark, read("postings"), read("passages"), read("bounds")
        self.docs, self.avg_n = read("totals").first()

    def _scored(self, question: str, terms: list[str], df: list[int], blocks: list[int]) -> DataFrame:
        """(key, raw) of the passages of the blocks that hold a term. Only for those does the phrase look into the text, which lies in the same block."""
        near = self.postings.filter(F.col("block").isin(blocks) & F.col("term").isin(terms))
        found = near.groupBy("block", "key").agg(F.any_value("n").alias("n"), F.array_sort(F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.alias("p"), F.col("term").alias("t")))))).alias("at"))
        # Words within the question are whole in every text that holds it, so only passages with all of them are looked at.
        inner = sorted({t for w in question.split()[1:-1] for t in meaningful_py(w)} & set(terms))
        may = found.filter(F.forall(F.lit(inner), lambda t: F.exists("at", lambda x: x["t"] == t))) if inner else found
        folded = self.passages.filter(F.col("block").isin(blocks)).join(may.select("block", "key"), ["block", "key"], "left_semi")
        folded = folded.filter(F.contains("folded", F.lit(question.lower().replace("ß", "ss")))).select("block", "key", "folded")
        rows = found.join(folded, ["block", "key"], "left").withColumns({"docs": F.lit(self.docs), "avg_n": F.lit(self.avg_n), "df": F.lit(df)})
        row = F.struct("n", F.transform("at", lambda x: F.struct(x["t"].alias("t"), x["p"].alias("p"))).alias("found"), F.array().cast("array<string>").alias("title"), F.coalesce("folded", F.lit("")).alias("folded"))
        view = bind(row, lambda r: R._matches(F.get(R._asked({"q": question}), F.lit(0)), r))
        return rows.withColumn("m", view).select("key", R.raw_score(F.col("m.tf"), F.col("m.bonus")).alias("raw"))

    def top(self, question: str, k: int = 10, first: int = 4) -> DataFrame:
        """(rank, key, score): what ranking all passages and taking the k best gives, equal scores by key.

        first: how many of the most promising blocks are scored before the others are ruled out. Per question the driver reads a row per term and block.
        """
        terms = list(dict.fromkeys(meaningful_py(question)))
        inner = [t for w in question.split()[1:-1] for t in meaningful_py(w)]
        bounds = self.bounds.filter(F.col("term").isin(terms)).collect() if terms else []
        by: dict[int, dict[str, float]] = {}
        df = dict.fromkeys(terms, 0)
        for b in bounds:
            by.setdefault(b.block, {})[b.term] = b.most
            df[b.term] += b.df
        # A text can hold the question's letters without any of its words only where no whole word stands inside; then all blocks are asked.
        lone = not inner
        rare = {t: math.log(1 + (self.docs - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        most = {b: self._most(own, rare, terms) for b, own in by.items()}
        order = sorted(most, key=lambda b: -most[b])
        count = [df[t] for t in terms]
        none = self.spark.createDataFrame([], "key {}, raw double".format(dict(self.passages.dtypes)["key"]))
        got = cut(self._scored(question, terms, count, order[:first])) if order else none
        best = [r.raw for r in got.orderBy(F.desc("raw")).limit(k).collect()]
        # Scores are rounded to four digits of the best: whatever could still tie counts.
        least = best[-1] - 1e-4 * most[order[0]] if len(best) == k else 0.0
        rest = [b for b in order[first:] if most[b] >= least]
        if rest:
            got = got.unionByName(self._scored(question, terms, count, rest))
        if lone:
            whole = self.passages.filter(F.contains("folded", F.lit(question.lower().replace("ß", "ss")))).select("key").join(got, "key", "left_anti")
            got = got.unionByName(whole.withColumn("raw", F.lit(R.PHRASE)))
        got = cut(got)
        top = got.agg(F.max("raw").alias("best")).first().best
        scored = got.select("key", F.round(F.least(F.lit(1.0), F.col("raw") / F.lit(top if top else 1.0)), 4).alias("score"))
        if scored.limit(k).count() < k:  # passages without a match fill up, by key
            scored = scored.unionByName(self.passages.select("key").join(scored, "key", "left_anti").orderBy("key").limit(k).withColumn("score", F.lit(0.0)))
        kept = scored.orderBy(F.desc("score"), "key").limit(k)
        return R.top(kept.withColumn("question_id", F.lit("q")), k, "key").select("rank", "key", "score")

    @staticmethod
    def _most(own: dict[str, float], rare: dict[str, float], terms: list[str]) -> float:
        """The most that a passage of a block can score, by the terms that the block has."""
        share = len(own) / max(1, len(terms))
        near = R.PROXIMITY + R.BIGRAM if len(own) > 1 else 0.0
        return sum(rare[t] * x for t, x in own.items()) + R.COVERAGE * share * share + near + R.PHRASE
