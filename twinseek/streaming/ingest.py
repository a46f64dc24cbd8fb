"""Functions as they arrive: a file stream of {path, function} with its hash, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinseek.functions.hashing import body_hash


def stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    rows = spark.readStream.schema("path string, `function` string").option("multiLine", True).option("maxFilesPerTrigger", files_at_once).json(path)
    return rows.filter(F.trim("function") != "").withColumn("hash", body_hash(F.col("function")))


def matches(targets: DataFrame, known: DataFrame) -> DataFrame:
    """Stream-static join by hash with known (hash, ...)."""
    return targets.join(known, "hash")


def start(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there, then stop; the checkpoint keeps what was done."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
