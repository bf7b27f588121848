"""Cutting a plan's lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session that names none gets one of its own, as in tests; on a cluster that is a ValueError."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="doseloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: it survives the loss of executors and is not computed again."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
