"""Cutting a plan where several later steps start from the same rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only on one machine (master local), where none is set, it is a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (folder or tempfile.mkdtemp(prefix="lodestone-")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the session's shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
