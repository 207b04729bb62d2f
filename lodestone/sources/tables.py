"""Stored tables: reading, last-writer-wins writing, namespaced deletes and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a table of few files is dealt out before costly text work, a large one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, folder: str, name: str = "documents", *columns: str) -> DataFrame:
    """A table for work on whole texts: only the columns that are named, spread over the cores."""
    df = table(spark, folder, name)
    return spread(df.select(*columns) if columns else df)


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """The latest row of each key over both tables; of equal versions the new row holds."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(*(v.desc_nulls_last() for v in version), F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k", "_new")


def delete(stored: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and a one-row count of what goes; a null condition keeps the row."""
    gone = F.coalesce(condition, F.lit(False))
    return stored.filter(~gone), stored.agg(F.count_if(gone).alias("deleted"))


def recent(requests: DataFrame, limit: int, order: str = "created_at", tie: str = "request_id") -> DataFrame:
    """The newest requests, 1 to 100 of them."""
    return requests.orderBy(F.desc(order), tie).limit(max(1, min(100, limit)))


def orphans_removed(rows: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a parent, and rows without; null keys have none."""
    return rows.join(parents.select(key).distinct(), key, "left_semi"), rows.join(parents.select(key).distinct(), key, "left_anti")
