"""Where jobs put what outlives a task: the folder of spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where a local session names none, as in tests, a temporary one. Elsewhere there must be one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context._jsc.sc().getCheckpointDir().isDefined() and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="twinseek-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The same rows, from files that survive the loss of executors."""
    folder(spark)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
