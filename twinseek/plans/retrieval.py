"""Whole jobs over files: clones by vectors, clones by exact hash, evaluation of labelled entries, verdicts on clones."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.functions import abstraction, hashing, lines, text
from twinseek.operators import evaluate, match, validate, vectors
from twinseek.sources import readers

Model = Callable[[list[str]], np.ndarray]
DIMS = 256


def hashed_model() -> Model:
    """A model without weights: counts of hashed runs of one to three tokens, damped. Others can be given in its place."""
    import re

    token, mix = re.compile(r"\w+|[^\w\s]"), np.uint64(0x9E3779B97F4A7C15)

    def run(texts: list[str]) -> np.ndarray:
        out, known = np.zeros((len(texts), DIMS)), {}
        for row, body in zip(out, texts):
            words = token.findall(body)
            for w in words:
                if w not in known:
                    known[w] = zlib.crc32(w.encode())
            hashes = total = np.array([known[w] for w in words], np.uint64)
            with np.errstate(over="ignore"):
                for size in (1, 2, 3):
                    row += np.bincount((total * mix >> np.uint64(40)).astype(np.int64) % DIMS, minlength=DIMS)
                    total = total[:-1] * mix + hashes[size:]
        return np.log1p(out)

    return run


def embed(texts: DataFrame, make: Callable[[], Model] = hashed_model, batch: int = 4) -> DataFrame:
    """(key, vector) of texts (key, text). A task makes its model once, and gives it `batch` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                some = rows.slice(lo, batch)
                made = model([t or "" for t in some.column("text").to_pylist()])
                yield pa.record_batch({"key": some.column("key"), "vector": pa.array([v.tolist() for v in made], pa.list_(pa.float32()))})

    return texts.select("key", "text").mapInArrow(run, "key string, vector array<float>")


def with_vectors(rows: DataFrame, work: str, make: Callable[[], Model] = hashed_model, batch: int = 4) -> DataFrame:
    """Rows (text, ...) with their vector. Each distinct text is embedded once; `work`/vectors keeps
    vectors by the content's hash, so a later run embeds only texts that it does not know. One job writes there at a time."""
    spark = rows.sparkSession
    path = f"{work}/vectors"
    spark.createDataFrame([], "key string, vector array<float>").write.mode("append").parquet(path)
    read = lambda: spark.read.schema("key string, vector array<float>").parquet(path)
    unknown = readers.cached_vectors(rows, read()).filter("vector is null")
    embed(unknown, make, batch).write.mode("append").parquet(path)
    known = read().groupBy("key").agg(F.first("vector").alias("vector"))
    return rows.withColumn("key", F.sha2("text", 256)).join(known, "key").drop("key")


def abstracted(body, language: str = "c"):
    """Parameters, types and locals as placeholders, by the patterns of symbols_of()."""
    return abstraction.relabel(body, abstraction.symbols_of(body, language), ("types", "locals", "parameters"))


def retrieve(
    corpus: DataFrame, functions: DataFrame, work: str, make: Callable[[], Model] = hashed_model, k: int = 1, threshold: float = 0.5,
    filtering: bool = True, abstract: bool = True, batch: int = 4,
) -> DataFrame:
    """(repo, vuln_text, clone_text, similarity, fix_match, path, commit_url) of functions (repo, path, function).

    Each distinct function meets the k most alike flaws of the corpus (body, fix_func, commit_url). With filtering, a clone
    goes that is as near to the flaw's fix as to the flaw; flaws without a fix of their own take that of the same body, else
    the first of the same first line. Of equal bodies the last record's URL and fix count, of equal functions of a repository
    the last one's path; without a path a clone goes. Records follow each other by `ord`, where the tables have it.
    """
    spark = corpus.sparkSession
    corpus, functions = (t if "ord" in t.columns else t.withColumn("ord", F.monotonically_increasing_id()) for t in (corpus, functions))
    ready = lambda c: text.preprocess(F.col(c), abstracted(F.col(c)) if abstract else None, batch=True)
    known = corpus.filter("body is not null").withColumn("text", ready("body")).filter("text <> ''")
    flaws = known.groupBy("text").agg(F.min_by("body", "ord").alias("body"))
    urls = known.select(F.col("text").alias("vuln_text"), "commit_url", "ord")
    found = functions.withColumn("text", ready("function")).filter("text <> ''")
    # Ids of distinct texts, from written tables, so that they stay when an executor is lost.
    for name, texts in (("flaws", flaws), ("asked", found.select("text").distinct())):
        with_vectors(texts, work, make, batch).withColumn("id", F.monotonically_increasing_id() * 2 + int(name == "asked")).write.mode("overwrite").parquet(f"{work}/{name}")
    flaws, asked = (spark.read.parquet(f"{work}/{name}") for name in ("flaws", "asked"))
    near = vectors.similar(asked.select("id", F.col("vector").alias("v")), flaws.select("id", F.col("vector").alias("v")), threshold, k)
    near = near.join(asked.select(F.col("id").alias("query_id"), F.col("text").alias("clone_text"), F.col("vector").alias("clone")), "query_id").join(flaws.withColumnRenamed("text", "vuln_text"), "id")
    fixes = known.filter("fix_func <> ''").groupBy("body").agg(F.max_by("fix_func", "ord").alias("fix"), F.min("ord").alias("fix_id"))
    linked = match.with_fix(flaws.select(F.col("id").alias("vuln_id"), "body"), fixes.select("fix_id", "body")).join(fixes.select("fix_id", "fix"), "fix_id", "left")
    linked = linked.select(F.col("vuln_id").alias("id"), "fix_id", F.col("how").alias("fix_match"), text.preprocess(F.col("fix"), abstracted(F.col("fix")) if abstract else None).alias("text"))
    near = near.join(linked.drop("text"), "id")
    if filtering:
        fixed = with_vectors(linked.filter("text <> ''").select("id", "text"), work, make, batch).select("id", F.col("vector").alias("fixed"))
        near = near.join(fixed, "id", "left").withColumn("s_vuln", F.col("similarity")).withColumn("s_fix", vectors.cosine(F.col("fixed"), F.col("clone")))
        near = match.fix_filter(near)
    paths = found.select("repo", F.struct("repo", F.col("text")).alias("clone"), "path", "ord")
    repos = found.select("repo", F.col("text").alias("clone_text")).distinct()
    results = near.drop("clone").join(repos, "clone_text").withColumn("_text", F.col("clone_text")).withColumn("clone_text", F.struct("repo", F.col("_text").alias("text")))
    results = match.enrich(results, urls, paths.select(F.col("clone").alias("clone_text"), "path", "ord")).withColumn("clone_text", F.col("_text"))
    return results.select("repo", "vuln_text", "clone_text", "similarity", "fix_match", "path", "commit_url")


def exact(known: DataFrame, targets: DataFrame, order: str, hashed: Callable = hashing.body_hash) -> DataFrame:
    """Targets (function, ...) whose hash is known (func, ...), once for each known copy; short ones go."""
    a = known.filter(lines.long_enough(F.col("func"))).withColumn("hash", hashed(F.col("func")))
    b = targets.filter(lines.long_enough(F.col("function"))).withColumn("hash", hashed(F.col("function")))
    return match.hash_join(a, b, order)


def evaluated(spark: SparkSession, path: str) -> DataFrame:
    """Counts and ratios of labelled entries (label, code, type) of JSON lines.

    An entry of type `original` meets the others of its label; those of a number type should be found, those of type `fix`
    should not. Other types take no part, as entries that meet or are met.
    """
    rows = readers.numbered_lines(spark, path, "label int, `index` int, code string, type string")
    kind = F.when(F.col("type") == "original", "original").when(F.col("type") == "fix", "fix").when(text.numeric_type(F.col("type")), "clone")
    rows = rows.select(F.col("label").alias("group"), hashing.renamed_hash(F.col("code")).alias("hash"), kind.alias("kind")).filter("kind is not null")
    return evaluate.with_ratios(evaluate.pair_counts(rows.select("group", "hash", (F.col("kind") == "original").alias("original"), (F.col("kind") != "fix").alias("clone"))))


def judged(results: DataFrame, sources: DataFrame, client: Callable[[str], str], limit: int | None = None, delay: float = 0.0) -> DataFrame:
    """Verdicts on results (vuln_text, clone_text, ...) whose flaw has a source (body, fix_func), in the order
    of their texts; `limit` is how many are asked about. A delay holds between all calls, so they go through one task then."""
    sources = sources if "ord" in sources.columns else sources.withColumn("ord", F.monotonically_increasing_id())
    known = sources.groupBy(F.col("body").alias("vuln_text")).agg(F.max_by(F.coalesce("fix_func", F.lit("")), "ord").alias("fix"))
    rows = results.join(known, "vuln_text").withColumn("vuln", F.col("vuln_text")).withColumn("clone", F.col("clone_text"))
    if limit is not None:
        rows = rows.orderBy("vuln_text", "clone_text").limit(limit)
    return validate.parse(validate.ask(rows.coalesce(1) if delay else rows, client, delay))
