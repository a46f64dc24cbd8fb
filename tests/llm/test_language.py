"""Sums over segmentations against brute force, for words of any length; learning; the sample."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from twinseek.llm import language

PATH = public_tokenizers.path("piece_bpe_32k.model")


def table_of(words, seed=0, languages=3):
    rng = np.random.default_rng(seed)
    return np.append(rng.random((words.size, languages)) / words.size, np.full((1, languages), language.UNKNOWN), axis=0)


def brute(words, chances, text):
    """ln of the sum over all segmentations, from the front, in logarithms."""
    out = np.full((len(text) + 1, chances.shape[1]), -np.inf)
    out[0] = 0
    for i in range(len(text)):
        h = np.zeros(1, np.uint64)
        for j in range(i, len(text)):
            with np.errstate(over="ignore"):
                h = (h + np.uint64(ord(text[j]))) * language.MULTIPLIER
            rows, found = words.find(h)
            if len(rows) or j == i:
                out[j + 1] = np.logaddexp(out[j + 1], out[i] + np.log(chances[found[0] if len(rows) else -1]))
    return out[-1]


def offsets_of(texts):
    return np.array([ord(c) for t in texts for c in t], np.uint32), np.append(0, np.cumsum([len(t) for t in texts]))


def test_sums_of_words_of_any_length():
    words = language.Vocabulary(PATH)
    chances = table_of(words)
    texts = ["these", "zß", "responsibilities", "internationalisierungen", "x" * 31, "the" * 11, "und" * 40, "straßenbahnhaltestelle" * 9, "中é" * 300]
    got = words.score(*offsets_of(texts), chances)
    assert np.allclose(got, [brute(words, chances, "▁" + t) for t in texts], rtol=1e-9) and np.isfinite(got).all()
    assert words.longest > 8  # whole pieces of the vocabulary


def test_learning_does_not_depend_on_how_words_are_taken(monkeypatch):
    """Words side by side, and one by one as long ones are, give the same chances."""
    words = language.Vocabulary(PATH)
    texts = ["these", "straßenbahn", "le", "chats", "internationalisation", "ab"]
    counts = np.random.default_rng(1).integers(0, 5, (len(texts), 2)).astype(float)
    both = []
    for side in (32, 0):
        monkeypatch.setattr(language, "SIDE", side)
        both.append(words.learn(*offsets_of(texts), counts, rounds=2))
    assert np.allclose(*both, rtol=1e-8)


def test_sample_is_that_of_least_hash(spark):
    rows = [(i, f"wort{i % 9} haus" if i % 3 else f"word{i % 7} house", "de" if i % 3 else "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, chances = language.train(docs, PATH, F.lit(True), sample=20)
    keyed = docs.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), F.lit("language"))).orderBy("key").collect()
    picked = [r["doc_id"] for name in names for r in [r for r in keyed if r["lang"] == name][:20]]
    _, want = language.train(docs.filter(F.col("doc_id").isin(picked)), PATH, F.lit(True), sample=10**6)
    assert names == ["de", "en"] and np.allclose(chances, want)


def test_many_languages(spark):
    """More than there ever was a bound on."""
    rows = [(i, chr(97 + i % 26) * 3 + chr(97 + i // 26) * 4, f"l{i:03d}") for i in range(230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, chances = language.train(docs, PATH, F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, PATH, names, chances).collect()}
    assert len(names) == 230 and sum(got[i] == lang for i, _, lang in rows) > 200


def test_long_words_are_scored_whole(spark):
    docs = spark.createDataFrame([(1, "the house of the king", "en"), (2, "das haus von dem könig", "de")], "doc_id long, text string, lang string")
    names, chances = language.train(docs, PATH, F.lit(True))
    asked = spark.createDataFrame([(1, "the" * 5000 + "king"), (2, "haus" * 5000)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(asked, PATH, names, chances).collect()} == {1: "en", 2: "de"}
