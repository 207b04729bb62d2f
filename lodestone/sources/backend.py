"""A search backend over stored results: what a metasearch answered, as a table whose scan takes the search's bounds."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.results import from_payload

#: Days that a recency bucket reaches back (fixed values).
REACH = {"day": 1, "month": 31, "year": 366}


class StoredResults:
    """Result rows by query, in folders by category and by the hash of the query, within a folder in order of query and place.

    A search names its folders, so others are not listed; query, date and place are compared with the files' statistics, so that row groups of
    other queries are passed over. `buckets` is fixed when the table is written: choose it so that a bucket is a few hundred megabytes.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, query: Column) -> Column:
        return F.pmod(F.xxhash64(query), F.lit(self.buckets)).cast("int")

    def write(self, payloads: DataFrame, limit: int = 100, mode: str = "append", files: int = 1) -> None:
        """payloads: query, category, payload (a JSON array of rows), one line each. Null queries or categories are not searchable and not kept.

        files: how many files a folder gets, each its own task, so that a category that most queries share is no single task. Equal queries share a file.
        """
        rows = payloads.filter("query is not null and category is not null").select("query", "category", F.struct("query", "category").alias("_key"), "payload")
        rows = from_payload(rows, "_key", "payload", limit).select("_key.*", F.col("pos").alias("place"), "url", "title", "snippet", "engine", "engines", "published_at", "rank", "search_score")
        rows = rows.withColumns({"bucket": self._bucket(F.col("query")), "_file": F.pmod(F.hash("query"), F.lit(files))})
        rows.repartition("category", "bucket", "_file").sortWithinPartitions("category", "bucket", "query", "place").drop("_file").write.mode(mode).partitionBy("category", "bucket").parquet(self.path)

    def search(self, queries: Sequence[str], categories: Sequence[str] = ("general",), recency: str | None = None, now: datetime | None = None, limit: int = 20) -> DataFrame:
        """The first `limit` stored places of each query in each of the categories; with a recency (day, month, year) those dated since. Undated rows are not recent."""
        got = self.spark.read.parquet(self.path).filter(F.col("category").isin(*categories) & F.col("query").isin(*queries) & (F.col("place") < limit))
        # The hashes are values by the time the scan is planned, so they choose folders.
        wanted = [r.b for r in self.spark.createDataFrame([(q,) for q in queries], "query string").select(self._bucket(F.col("query")).alias("b")).distinct().collect()] if queries else []
        got = got.filter(F.col("bucket").isin(*wanted))
        if recency:
            got = got.filter(F.col("published_at") >= F.lit((now or datetime.now()) - timedelta(days=REACH[recency])))
        return got.drop("bucket")

    def search_all(self, asked: DataFrame, limit: int = 20) -> DataFrame:
        """The same for a table of searches: search_id, query, category, since (null: any date); a row per search and result.

        A join by bucket and query, so a scan reads each row group once for all searches; with few searches their folders prune the scan at run time.
        """
        a = asked.select("search_id", F.col("query").alias("_q"), F.col("category").alias("_c"), "since", self._bucket(F.col("query")).alias("_b"))
        rows = self.spark.read.parquet(self.path).filter(F.col("place") < limit)
        met = rows.join(a, (F.col("category") == F.col("_c")) & (F.col("bucket") == F.col("_b")) & (F.col("query") == F.col("_q")))
        return met.filter(F.col("since").isNull() | (F.col("published_at") >= F.col("since"))).drop("_q", "_c", "_b", "bucket", "since")

    def drop(self) -> None:
        """Remove the table's folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
