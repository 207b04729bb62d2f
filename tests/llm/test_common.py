"""What the operators share: folders, bounds of batches, the lookup join."""

from __future__ import annotations

from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common as C


def test_only_one_machine_gets_a_folder_of_its_own(spark):
    def session(master, folder=None):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": folder}))

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            C.shared_folder(session(master))
        assert C.shared_folder(session(master, "hdfs://x/y")) == "hdfs://x/y"
    assert C.shared_folder(session("local[8]"))
    assert C.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_bounds_of_the_caller_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "7")
        sizes = C.map_batches(spark.range(0, 50, 1, 1), lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["id"]) for b in batches if b.num_rows), "id long").collect()
        assert spark.conf.get(name) == "7" and max(r.id for r in sizes) <= 7
        spark.conf.set(name, C.BATCH[name][0])
        C.map_batches(spark.range(3), lambda batches: batches, "id long").collect()
        assert spark.conf.get(name) == C.BATCH[name][1]
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_under_skew(spark, how):
    rows = spark.range(600).select(F.when(F.col("id") < 400, 1).when(F.col("id") < 590, F.col("id") % 7 + 2).otherwise(F.lit(None)).cast("long").alias("key"), F.col("id").alias("n"))
    lookup = rows.filter("key is not null and key <> 5").groupBy("key").agg(F.count(F.lit(1)).alias("w")).withColumn("name", F.concat(F.lit("k"), "key"))
    plain = rows.join(lookup.drop("w"), "key", how).orderBy("n").collect()
    hot = C.lookup_join(rows, lookup, "key", "w", ["n"], 600, how, least=20).select("key", "n", "name").orderBy("n").collect()
    assert [(r.key, r.n, r.name) for r in hot] == [(r.key, r.n, r.name) for r in plain]
