"""Scans of corpora, functions, signatures and source trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinseek.functions.abstraction import by_text
from twinseek.functions.lines import long_enough
from twinseek.functions.text import basename, language_of, strip

CORPUS = "`function` string, vuln_func string, func string, fix_func string, commit_url string, commit_message string, cve string, cve_desc string, cwe array<string>"
BODY = ("function", "vuln_func", "func")
PAIRS = "commit_id string, target int, func string, idx long, project string, cve string, cve_desc string, cwe array<string>"
TARGET = "path string, `function` string"
SPLITS = 100_000


def corpus(spark: SparkSession, path: str, body: tuple[str, ...] = BODY, tolerant: bool = False) -> DataFrame:
    """JSON lines with `body`, the first of its names that is there, and `ord`, by which records follow each
    other; a bad line ends the job, or is skipped."""
    rows = spark.read.schema(CORPUS).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")
    return rows.withColumn("body", F.coalesce(*body)).withColumn("ord", file_order())


def file_order() -> Column:
    """A row's place: its file, its split, and its place within it."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))


def numbered_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: JSON lines with their number in their file from 1, which bad and blank lines advance too.

    Files are read in splits. A line's number is its place in its split and the lines of the splits before. Of these there
    is a row for each split, which are broadcast where there are SPLITS at most: so many as files, and as the least size of
    a split goes into all bytes.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    conf = spark._jsparkSession.sessionState().conf()
    least = max(1, min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes()))
    few = len(text.inputFiles()) + int(text._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // least <= SPLITS
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line")
    )
    splits = lines.groupBy("file", "split").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n") - F.col("first")
    rows = lines.join((F.broadcast if few else lambda x: x)(splits.select("file", "split", before.alias("before"))), ["file", "split"]).withColumn("line_number", F.col("place") + F.col("before") + 1)
    rows = rows.withColumn("_v", F.from_json("line", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return rows.filter(F.col("_v").isNotNull() & F.col("_v._bad").isNull() & (F.trim("line") != "")).select("file", "line_number", "_v.*").drop("_bad")


def functions(spark: SparkSession, path: str, suffix: str = "*.json", drop_short: bool = False) -> DataFrame:
    """Arrays of {path, function} in JSON files of a directory, with repo, basename and language.

    Items without a function, or with a blank one, are skipped. `ord` tells how items follow each other.
    """
    rows = spark.read.schema(TARGET).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", suffix).json(path)
    rows = rows.withColumn("json_file", F.col("_metadata.file_name")).withColumn("ord", file_order()).filter(F.trim("function") != "")
    rows = rows.withColumn("repo", F.regexp_replace("json_file", r"(_functions)?\.json$", "")).withColumn("filename", basename(F.col("path"))).withColumn("language", language_of(F.col("path")))
    return rows.filter(long_enough(F.col("function"))) if drop_short else rows


def signatures(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Those that were made without an error."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").filter("processing_status = 'success'")


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of the known languages in a tree."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{c,cc,cpp,cxx,h,java,js,py,cs}").load(path)


def by_body(rows: DataFrame, order: str = "_ord") -> DataFrame:
    """The last record of each body."""
    return rows.groupBy("body").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "body"]), order).alias("_")).select("body", "_.*")


def nested_results(spark: SparkSession, path: str) -> DataFrame:
    """The long form of a document {results: {flaw: {clone: {similarity, path, commit_url}}}}."""
    leaf = "struct<similarity: double, path: string, commit_url: string>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"results map<string, map<string, {leaf}>>").alias("d"))
    rows = rows.select(F.explode("d.results").alias("vuln_text", "m")).select("vuln_text", F.explode("m").alias("clone_text", "v"))
    return rows.select("vuln_text", "clone_text", "v.*")


def with_clone_code(results: DataFrame, files: DataFrame) -> DataFrame:
    """`code`, the whole file at the path, or else the clone's own text, or else a comment that tells what is missing.

    files: (path, content); bytes that are no UTF-8 are left out.
    """
    text = files.select("path", by_text(lambda content: content.decode("utf-8", "ignore"))(F.col("content")).alias("_file"))
    found = results.join(text, "path", "left")
    own, no_path = F.nullif("clone_text", F.lit("")), F.coalesce(F.col("path") == "", F.lit(True))
    code = F.when(no_path, F.coalesce(own, F.lit("// No clone code available"))).when(F.col("_file").isNull(), F.coalesce(own, F.concat(F.lit("// File not found: "), "path")))
    return found.withColumn("code", code.when(strip(F.col("_file")) != "", F.col("_file")).otherwise(F.coalesce(own, F.lit("// Empty file")))).drop("_file")


def pending(table: DataFrame) -> DataFrame:
    """Rows that are not abstracted yet."""
    return table.filter("abst1 is null")


def cached_vectors(texts: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Distinct texts with the vector that is known by the content's hash, or null."""
    texts = texts.select("text").distinct().withColumn("key", F.sha2("text", 256))
    return texts.join(cache.select("key", "vector"), "key", "left") if cache is not None else texts.withColumn("vector", F.lit(None).cast("array<float>"))
