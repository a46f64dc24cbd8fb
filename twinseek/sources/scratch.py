"""A place for what a query writes and reads again: the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where a local session names none, a temporary one. Elsewhere there must be one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    return f"{named or 'file://' + tempfile.mkdtemp(prefix='twinseek-')}/{name}-{uuid.uuid4().hex}"
