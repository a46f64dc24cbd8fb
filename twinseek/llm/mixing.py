"""Temperature mixing of sources, by DataFrame operations.

A source's share of all tokens is raised to an exponent between 0 and 1 and normalised. The exponent is found by bisection:
the largest that reaches the target entropy, or a larger one if a source would be repeated more often than the limit. The
largest source is used once, so no document is lost; others are repeated. Whole epochs take every document; the rest of a
source's budget takes blocks of its documents in a permuted order, and of the block at the edge documents in a permuted
order, while they fit. Which ones is told by two thresholds for each source, so rows are judged where they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinseek.llm.shared import cut, table

#: The entropy to reach, as a share of the largest one; repetitions at most; blocks of a source.
ENTROPY, REPEATS, BLOCKS = 0.9, 2.0, 4096
#: Sources whose shares the driver holds and whose budgets are sent to all tasks, at most. Of more, sums and joins are made by jobs.
SOURCES = 100_000

OUT = ("n_tokens", "block", "weight", "epochs", "copies")


def entropy(shares: list[float], exponent: float) -> float:
    raised = [p**exponent for p in shares]
    total = sum(raised)
    return -sum(q / total * math.log(q / total) for q in raised)


def entropy_of(totals: DataFrame, exponent: float) -> float:
    """entropy() of the shares p of a table."""
    q = F.pow("p", F.lit(exponent))
    total, weighted = totals.agg(F.sum(q), F.sum(q * F.log(q))).first()
    return math.log(total) - weighted / total


def find_exponent(shares: list[float], target: float = ENTROPY, repeats: float = REPEATS, rounds: int = 60) -> float:
    """The exponent by bisection; shares are above 0. With one source, or shares that are even enough, it is 1."""
    if not shares:
        return 1.0
    return bisect(lambda x: entropy(shares, x), len(shares), max(shares) / min(shares), target, repeats, rounds)


def bisect(entropy_at: Callable[[float], float], n: int, spread: float, target: float, repeats: float, rounds: int = 60) -> float:
    """find_exponent() for n shares of which the largest is `spread` times the smallest."""
    if n < 2:
        return 1.0

    def largest(good: Callable[[float], bool]) -> float:
        if good(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(rounds):
            middle = (low + high) / 2
            low, high = (middle, high) if good(middle) else (low, middle)
        return low

    exponent = largest(lambda x: entropy_at(x) >= target * math.log(n))
    if spread ** (1 - exponent) > repeats:
        low, high = exponent, 1.0
        for _ in range(rounds):
            middle = (low + high) / 2
            low, high = (low, middle) if spread ** (1 - middle) <= repeats else (middle, high)
        exponent = high
    return exponent


def decide(docs: DataFrame, **settings) -> tuple[DataFrame, DataFrame]:
    """(docs with n_tokens, block, epochs, weight, copies; a row for each source). Columns of docs by these names are replaced.

    Tokens are runs of other bytes than white space. Null texts have none. A null source is a source of its own. A source
    without tokens has weight 0 and is used once. Documents of one source and id are taken together or not at all.
    """
    rows, plan = judged(docs, **settings)
    return rows.select(*(F.col("_d")[c].alias(c) for c in docs.columns if c not in OUT), *OUT), plan


def judged(docs: DataFrame, target: float = ENTROPY, repeats: float = REPEATS, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """decide() with the columns of docs in the struct _d."""
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*docs.columns).alias("_d"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_key"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(blocks)).alias("block"),
        F.xxhash64("doc_id", F.lit("order")).alias("_v"),
    ).withColumn("_u", F.xxhash64("_key", "block", F.lit("order")))
    narrow = cut(rows.select("_key", "_u", "_v", "n_tokens"), spark)
    sums = cut(narrow.groupBy("_key", "_u").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")), spark)
    totals = cut(sums.groupBy("_key").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")), spark)
    known = totals.agg(F.count("*").alias("all"), F.count_if(F.col("n") > 0).alias("live"), F.sum("n").alias("n"), F.max("n").alias("most"), F.min(F.when(F.col("n") > 0, F.col("n"))).alias("least")).first()
    live = totals.filter("n > 0").withColumn("p", F.col("n") / F.lit(known["n"] or 1))
    few, spread = known["all"] <= SOURCES, known["most"] / known["least"] if known["live"] else 1.0
    if few:
        shares = sorted(r["p"] for r in live.select("p").collect())
        exponent = bisect(lambda x: entropy(shares, x), len(shares), spread, target, repeats)
        norm = sum(p**exponent for p in shares)
    else:
        exponent = bisect(lambda x: entropy_of(live, x), known["live"], spread, target, repeats)
        norm = live.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0]
    has = F.col("n") > 0
    p = F.col("n") / F.lit(known["n"] or 1)
    epochs = F.when(has, F.pow(F.lit(known["most"] or 1) / F.col("n"), F.lit(1 - exponent))).otherwise(1.0)
    plan_ = totals.select("_key", "rows", F.col("n").alias("tokens"), F.when(has, F.pow(p, F.lit(exponent)) / F.lit(norm or 1.0)).otherwise(0.0).alias("weight"), epochs.alias("epochs"), F.floor(epochs + 1e-9).cast("int").alias("whole"))
    plan_ = plan_.withColumn("rest", F.floor(F.greatest(F.lit(0.0), F.col("epochs") - F.col("whole")) * F.col("tokens")).cast("long")).withColumn("epochs", F.greatest("epochs", F.col("whole").cast("double")))
    sent = F.broadcast if few else lambda x: x  # a row for each source
    plan_ = sent(plan_)

    upto = F.sum("n").over(Window.partitionBy("_key").orderBy("_u"))
    edges = sums.withColumn("upto", upto).join(plan_.select("_key", "rest"), "_key").filter(F.col("upto") > F.col("rest")).groupBy("_key").agg(F.min("_u").alias("u"), F.max(F.col("rest") - F.col("upto") + F.col("n")).alias("left"))
    edges = cut(edges, spark)
    inner = narrow.join(sent(edges), "_key").filter(F.col("_u") == F.col("u")).groupBy("_key", "left", "_v").agg(F.sum("n_tokens").alias("n"))
    inner = inner.withColumn("upto", F.sum("n").over(Window.partitionBy("_key").orderBy("_v"))).filter(F.col("upto") <= F.col("left")).groupBy("_key").agg(F.max("_v").alias("v"))
    plan_ = cut(plan_.join(edges, "_key", "left").join(inner, "_key", "left"), spark)
    taken = (F.col("rest") > 0) & (F.col("u").isNull() | (F.col("_u") < F.col("u")) | ((F.col("_u") == F.col("u")) & (F.col("_v") <= F.col("v"))))
    rows = rows.join(sent(plan_.select("_key", "weight", "epochs", "whole", "rest", "u", "v")), "_key")
    rows = rows.withColumn("copies", F.col("whole") + F.coalesce(taken, F.lit(False)).cast("int"))
    return rows.select("_d", *OUT), plan_.select(F.when(F.col("_key") != "", F.expr("substring(_key, 2)")).alias("source"), "rows", "tokens", "weight", "epochs")


def realised(docs: DataFrame, **settings) -> DataFrame:
    """The documents, each as often as its source's budget takes it, with `epoch` from 1; columns of docs."""
    rows, _ = judged(docs, **settings)
    return rows.select("_d", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch")).select(*(F.col("_d")[c].alias(c) for c in docs.columns if c != "epoch"), "epoch")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return decide(docs)[0].select("doc_id", "source", "n_tokens", "block", "weight", "epochs", "copies")
