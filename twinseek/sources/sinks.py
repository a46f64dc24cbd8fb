"""Where results go: long tables, and nested JSON for those who read it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nested(results: DataFrame) -> DataFrame:
    """One JSON document for each repo of long results (repo, vuln_text, clone_text, similarity, path, commit_url)."""
    leaf = F.struct("similarity", "path", "commit_url")
    # A document is one row, as its readers expect; write_results() keeps the long form, which has no such limit.
    inner = results.groupBy("repo", "vuln_text").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("clone_text", leaf)))).alias("m"))
    outer = inner.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("vuln_text", "m"))).alias("results"))
    return outer.select("repo", F.to_json(F.struct("results")).alias("json"))


def write_results(results: DataFrame, path: str) -> None:
    """The long form, a folder for each repository. Those of other repositories stay."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """K2, K3: (repo) of repositories that have an output folder; none if there is no output at all."""
    try:
        return spark.read.parquet(path).select(F.col("repo").cast("string").alias("repo")).distinct()
    except AnalysisException:
        return None


def write_lines(rows: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    """JSON lines; K8 drops the code."""
    rows.drop(*drop).write.mode("overwrite").json(path)


def write_new(rows: DataFrame, path: str) -> None:
    """K3: rows of repositories that have no output yet, a folder for each."""
    done = written(rows.sparkSession, path)
    if done is not None:
        rows = rows.join(done, "repo", "left_anti")
    rows.write.mode("append").partitionBy("repo").parquet(path)


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the columns that changes has for their key."""
    names = [c for c in changes.columns if c != key]
    both = table.join(changes.select(key, *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_hit")), key, "left")
    return both.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns))


def report(metrics: DataFrame) -> DataFrame:
    """Ratios with four decimals."""
    return metrics.select(*(F.format_number(c, 4).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes))
