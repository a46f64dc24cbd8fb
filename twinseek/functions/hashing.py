"""Digests, shingles and 64-bit similarity hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.functions.abstraction import indexed_rename
from twinseek.functions.text import erase_whitespace, let


def body_hash(code: Column) -> Column:
    """MD5 of the code without white space."""
    return F.md5(erase_whitespace(code))


def renamed_hash(code: Column) -> Column:
    """M9: MD5 of the code with its names numbered."""
    return F.md5(indexed_rename(code))


def sha1(code: Column) -> Column:
    """M5."""
    return F.sha1(code)


def shingles(tokens: Column, size: int = 3) -> Column:
    """Joined runs of successive tokens; none where there are fewer."""

    def runs(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, size), ""))
        return F.when(F.size(t) >= size, every).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def word_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def words_of(text: str) -> list[str]:
    """word_tokens() of a plain value."""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def simhash(rows: DataFrame, key: str, features: Column) -> DataFrame:
    """(key, simhash): bitwise majority of the features' hashes as a decimal string; 0 without features.

    The hash is the last 64 bits of MD5. The bits are counted in one aggregation, features are never multiplied by 64.
    """
    value = F.conv(F.substring(F.md5("_f"), 17, 16), 16, -10).cast("long")
    counted = rows.select(key, F.explode_outer(features).alias("_f")).withColumn("_h", value).groupBy(key).agg(
        F.count("_h").alias("_n"), *(F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(1)).alias(f"_b{i}") for i in range(64))
    )
    bits = [F.when(F.col(f"_b{i}") * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)]
    whole = bits[0]
    for bit in bits[1:]:
        whole = whole.bitwiseOR(bit)
    return counted.select(key, F.conv(F.hex(whole), 16, 10).alias("simhash"))
