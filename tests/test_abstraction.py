"""Abstraction against plain replacement one name after the other."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from twinseek.functions import abstraction


def text_of(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", "  ", ",", "(", ") ", "\n", "é", "."]) for _ in range(n))


@pytest.mark.parametrize("seed", range(40))
def test_names_in_turn(seed):
    rng = random.Random(seed)
    words = ["a", "b", "LVAR", "x1", "a1", "DTYPE"]
    code, names = text_of(rng, words, 30), rng.sample(words + ["a b", "x1 ", "", "b*"], 4)
    want = code
    for n in filter(None, names):
        want = re.sub(rf"(^|\W){re.escape(n)}(\W)", r"\g<1>LVAR\g<2>", want)
    assert abstraction.in_turn(code, names, "LVAR") == want


@pytest.mark.parametrize("seed", range(40))
def test_numbered_words(seed):
    rng = random.Random(seed)
    code = text_of(rng, ["a1", "a2", "a3", "b", "c", "if", "printf", "a10", "9x", "éa", "_", "a4"], 40)
    names = []
    for m in re.finditer(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b", code):
        if m[1] not in names and m[1] not in abstraction.OWN_NAMES:
            names.append(m[1])
    want = code
    for i, n in enumerate(names, 1):
        want = re.sub(rf"\b{n}\b", f"a{i}", want)
    assert abstraction.numbered_words(code) == want


def test_work_grows_with_length(spark):
    """Sixteen times the words, all of them different, must not take sixteen times sixteen the time."""
    took = []
    for n in (5_000, 80_000):
        rows = spark.createDataFrame([(" ".join(f"w{(i * 7919) % n}" for i in range(n)),)], "s string").cache()
        rows.count()
        began = time.time()
        rows.select(*(f(F.col("s")) for f in (abstraction.indexed_rename, abstraction.rename_tokens, abstraction.abstracted_by_patterns))).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[1] < 60 * max(took[0], 0.2)


def test_lines_keep_their_abstraction(spark):
    code = "int f(int count) {\n  // say\n  total = count + offset_of;\n  return total_of(count, count);\n}"
    rows = spark.createDataFrame([(code,)], "s string").withColumn("abst", abstraction.abstracted_by_patterns(F.col("s")))
    rows = rows.select(abstraction.line_map(F.col("s"), F.col("abst")).alias("m")).select(abstraction.with_abstraction(F.array(F.lit("total=count+offset_of;"), F.lit("not there at all")), F.col("m")))
    assert [tuple(x) for x in rows.first()[0]] == [("total=count+offset_of;", "total=fparam+offset_of;"), ("not there at all", "not there at all")]


def test_nulls(spark):
    rows = spark.createDataFrame([(None,), ("",)], "s string")
    got = rows.select(abstraction.indexed_rename(F.col("s")).alias("a"), abstraction.rename_tokens(F.col("s")).alias("b"), abstraction.abstract(F.col("s"), 1).alias("c")).collect()
    assert [tuple(r) for r in got] == [(None, None, None), ("", "", "")]
