"""Stages of the pipeline against brute force."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from twinseek.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string"


def shingles(text, size=5):
    words = [w for w in re.split(r"[\t-\r ]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    return frozenset(" ".join(words[i : i + size]) for i in range(max(min(1, len(words)), len(words) - size + 1)))


def components(rows):
    """The smallest id of each id's component, by all pairs."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if len(a & b) * 5 >= len(a | b) * 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def near_rows(seed=0):
    """Texts with copies of which 1 to 16 words in 200 are changed, so that similarities lie about 0.45 to 0.95."""
    rng, rows = random.Random(seed), []
    for k in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        rows.append((1000 - k, " ".join(words)))
        for changed in (1, 2, 3, 4, 5, 16):
            new = list(words)
            for at in rng.sample(range(200), changed):
                new[at] = f"x{rng.randrange(3000)}"
            rows.append((len(rows) * 7 % 900, "  ".join(new).title()))
    rows = list({i: t for i, t in rows}.items())
    return rows + [(2000, "a b c d e"), (2001, "A b\tc d E"), (2002, "a b c d"), (2003, "a b c d e f"), (2004, ""), (2005, None)]


def test_near_copies_are_those_of_brute_force(spark):
    rows = near_rows()
    want = components(rows)
    assert 50 < sum(i != c for i, c in want.items()) < len(rows) - 40
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], SCHEMA).repartition(5)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs).collect()} == want
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_near_copies_of_repeated_and_missing_ids(spark):
    rows = [(3, "one two three four five six"), (3, "one two three four five six"), (5, "One two three four five six"), (None, "one two three four five six"), (7, "other"), (7, "words")]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 3, 7]
    assert corpus_pipeline.drop_copies(spark, docs.filter(F.lit(False)), "").count() == 0


def test_run_is_that_of_its_stages_in_plain_python(spark, tmp_path):
    """Over a small table with near copies, texts without a letter, nulls, repeated ids and a clashing column."""
    import public_tokenizers
    import tiktoken

    from tests.llm.test_mixing import plain
    from twinseek.llm import bpe, mixing, toxicity
    from twinseek.llm.columns import held_out

    rng = random.Random(7)
    common = "the of and to in that it for was with house king water stone river".split()
    rows = []
    for i in range(240):
        words = [rng.choice(common) + str(rng.randrange(90)) * (rng.random() < 0.4) for _ in range(rng.randrange(8, 60))]
        if i % 6 == 0:
            words[rng.randrange(len(words))] = "idiot scum"
        rows.append((i, " ".join(words), "en", rng.choice("aaab")))
    rows += [(300 + i, rows[i * 7][1] + " more", "en", "b") for i in range(20)] + [(400, None, "en", "a"), (401, "12 34", "en", "a"), (402, "", None, None), (402, "the last house", None, None), (5, rows[5][1], "en", "a"), (None, "no number at all", "en", "c")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).withColumn("root", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    stay = [r for r in rows if r[1] and re.search("[^\\W\\d_]", r[1])]
    frame = spark.createDataFrame(stay, SCHEMA)
    model = toxicity.train(frame, labels, ~held_out(5, 0))
    toxic = {(r["doc_id"], r["text"]) for r in toxicity.scored(frame, model, text_too=True).filter("predicted = 1").collect()}
    assert len(toxic) > 20
    stay = [r for r in stay if (r[0], r[1]) not in toxic]
    class_of = components(sorted({(i, t) for i, t, *_ in stay if i is not None}))
    kept = {i: (i, t, lang, s) for i, t, lang, s in stay if i is not None and class_of[i] == i}
    kept = [*kept.values(), *(r for r in stay if r[0] is None)]
    assert 5 < len(stay) - len(kept)
    frame = spark.createDataFrame(kept, SCHEMA)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    hashed = frame.select("doc_id", "source", F.xxhash64(key, F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(mixing.BLOCKS)), F.lit("order")).alias("u"), F.xxhash64("doc_id", F.lit("order")).alias("v"))
    keys = {(r["doc_id"], r["source"]): (r["u"], r["v"]) for r in hashed.collect()}
    copies, _ = plain([(i, t, s) for i, t, _, s in kept], keys, mixing.ENTROPY, mixing.REPEATS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((i if i is not None else -1, tuple(own.encode_ordinary(t))) for i, t, _, s in kept for _ in range(copies[s, keys[i, s]]))
    mine = sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r["ids"])) for r in got)
    # The exponent of the plain mixture is on a grid, so a document at the very edge of a budget may differ.
    assert set(mine) == set(want) and abs(len(mine) - len(want)) <= 2
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_on_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA + ", n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mixing", "tokens"]


def test_groups_of_near_copies_are_told_in_tiles(spark, monkeypatch):
    """Small tiles, and groups that are dealt out, give the components of brute force too."""
    monkeypatch.setattr(simhash, "SPREAD", 3)
    monkeypatch.setattr(simhash, "TILE_SHINGLES", 400)
    rows = near_rows(3)
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], SCHEMA).repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs, tile=16).collect()}
    assert got == components(rows)
