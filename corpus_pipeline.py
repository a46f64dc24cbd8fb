"""A corpus pipeline: language, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.llm import bpe, language, mixing, simhash, toxicity
from twinseek.llm.columns import held_out
from twinseek.llm.shared import new_path, table


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter. Rows with a null or repeated id are judged like
    others; other columns than those of documents go; an empty table gives an empty one."""
    names = _columns(docs)
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = language.identify(docs, path, keep=tuple(n for n in names if n not in ("doc_id", "text")), text_too=True)
    return found.filter(F.col("lang_pred") != "und").select(*names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. The model learns from the labels of documents that are there; without any, all
    documents stay. Null texts count as empty. Rows with a null or repeated id are judged like others."""
    names = _columns(docs)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    found = toxicity.scored(docs, model, keep=tuple(n for n in names if n not in ("doc_id", "text")), text_too=True)
    return found.filter(F.col("predicted") == 0).select(*names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id stays; of rows with its id, one. Rows without an id stay.

    Near duplicates share four fifths of their distinct five-word shingles or more, by exact comparison.
    """
    names = _columns(docs)
    found = simhash.similar_texts(docs)
    stay = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count()
    rows = docs.select(*names).join(stay, "doc_id")
    once, more = rows.filter("count = 1"), rows.filter("count > 1").dropDuplicates(["doc_id"])
    return once.unionByName(more).select(*names).unionByName(docs.filter("doc_id is null").select(*names))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources are repeated, as their weights ask; none is lost. A null source is a source of its own, null
    and empty texts have no tokens; an empty table gives an empty one."""
    names = _columns(docs)
    return mixing.realised(docs.select(*names)).select(*names)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) by byte-level BPE: the ids, and digests of them and of the bytes that
    they decode to. A document that stands repeatedly is encoded as often. Null texts count as empty."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ids_too=True)


STAGES = [
    ("language", keep_languages),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]
#: Models and fingerprints are beyond SQL; tests/llm/test_pipeline.py holds stages and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
