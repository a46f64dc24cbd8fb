"""The subpackage's queries, by name. None of them can be told in SQL; tests/llm/test_contracts.py holds them against plain Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinseek.llm import bpe, jpeg, language, maxent, mixing, neighbours, pages, simhash, token_orc, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.query,
    "op2_toxicity": toxicity.query,
    "op3_neighbours": neighbours.query,
    "op4_token_orc": token_orc.query,
    "op5_mixing": mixing.query,
    "op6_pages": pages.query,
    "op7_jpeg": jpeg.query,
    "op8_duckdb_bpe": bpe.query,
    "op9_language": language.query,
    "op10_maxent": maxent.query,
}
ORACLE_SQL: dict[str, str] = {}
