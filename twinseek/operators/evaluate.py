"""Confusion matrices, ratios and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_ratios(counts: DataFrame) -> DataFrame:
    """A4, M7: precision (1 if nothing was detected), recall and F1 (0) of tp, fp, fn, tn."""
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.try_divide("tp", F.col("tp") + F.col("fp"))).otherwise(1.0)
    recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    counts = counts.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return counts.withColumn("f1", f1)


def pair_counts(entries: DataFrame) -> DataFrame:
    """Tp, fp, fn, tn over pairs of an original and another entry of its group, detected if hashes are equal.

    entries: (group, hash, original, clone): whether it is an original, and whether it should be found. Pairs are counted
    from the counts of groups and hashes; none is made.
    """
    by_hash = entries.groupBy("group", "hash").agg(F.count_if("original").alias("o"), F.count_if("clone").alias("c"), F.count_if(F.expr("original and clone")).alias("oc"), F.count_if(F.expr("not clone")).alias("f"), F.count_if(F.expr("original and not clone")).alias("of"))
    cell = by_hash.select("group", "o", "c", "oc", "f", "of", (F.col("o") * F.col("c") - F.col("oc")).alias("tp"), (F.col("o") * F.col("f") - F.col("of")).alias("fp"))
    total = cell.groupBy("group").agg(*(F.sum(x).alias(x) for x in ("o", "c", "oc", "f", "of", "tp", "fp")))
    total = total.select("tp", "fp", (F.col("o") * F.col("c") - F.col("oc") - F.col("tp")).alias("fn"), (F.col("o") * F.col("f") - F.col("of") - F.col("fp")).alias("tn"))
    return total.agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x) for x in ("tp", "fp", "fn", "tn")))


def detected(entries: DataFrame) -> DataFrame:
    """A5: entries that a pair with equal hashes has, each once."""
    hits = entries.groupBy("group", "hash").agg(F.count("*").alias("_n"), F.count_if("original").alias("_o")).filter("_n > 1 and _o > 0")
    return entries.join(hits.select("group", "hash"), ["group", "hash"], "left_semi")


def verdicts(rows: DataFrame) -> DataFrame:
    """(total, errors, vulnerable, sure) of parsed verdicts (error, is_vulnerable, confidence_level); null-safe."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.coalesce("is_vulnerable", F.lit(False))).alias("vulnerable"), F.count_if(F.coalesce("is_vulnerable", F.lit(False)) & F.coalesce(F.col("confidence_level") >= 4, F.lit(False))).alias("sure"))


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, n), the most frequent first."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def clone_rate(matched: int, total: int, seconds: float) -> dict[str, float]:
    """A12."""
    return {"rate": matched / total if total else 0.0, "per_second": total / seconds if seconds else 0.0}
