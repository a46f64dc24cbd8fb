"""Cut-offs of the toxicity classifier."""

import numpy as np
from pyspark.sql import functions as F

from twinseek.llm import toxicity


def test_rows_outside_the_fitted_sample_set_cut_offs(spark):
    texts = {"en": "the {} of and to", "de": "der {} und ist nicht"}
    rows = [(i, texts["en" if i % 4 else "de"].format("idiot" if i % 3 == 0 else f"word{i % 7}"), int(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True), sample=80, epochs=2)
    de, en = 1, 2
    assert model.rows.sum(0)[0] == 340 and model.rows[0, 0] == 0
    assert model.rows[de, 1] > 20 and model.rows[en, 1] > 60
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, model).collect()}
    assert all(got[i] == y for i, _, y in rows)


def test_few_toxic_rows_of_a_language_count_in_part():
    """One language's texts score higher by 2; its cut-off follows as its toxic rows grow."""
    cuts = []
    for times in (0, 1, 20, 500):
        model = toxicity.Model()
        spoken, level = np.array([2, 2, 3, 3]), np.array([-64, 64, 64, 192])
        n, toxic = np.array([900, 100, 9 * times, times]), np.array([0, 100, 0, times])
        model.calibrate(spoken[n > 0], level[n > 0], n[n > 0], toxic[n > 0])
        cuts.append(model.cuts[3])
        assert model.rows[3].tolist() == [10 * times, times]
    assert cuts[0] <= cuts[1] < cuts[2] < cuts[3] and 1.5 < cuts[3] <= 2


def test_examples_are_whole_texts_or_left_out(spark):
    """Toxic words stand after 25,000 others."""
    rows = [(i, "the word " * (12_500 if i % 2 else 3) + ("idiot scum" if i % 2 else "and of"), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True), epochs=3)
    tail = spark.createDataFrame([(1, "idiot scum"), (2, "the word the word")], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.scored(tail, model).orderBy("doc_id").collect()] == [1, 0]
    few = toxicity.train(docs, labels, F.lit(True), epochs=1, most=500_000)
    assert few.rows.sum(0)[0] == 60 - (30 + 4) * 3 // 4 - 1  # four long texts fit; a quarter of what fits sets cut-offs
    assert toxicity.train(docs, labels, F.lit(True), epochs=1, most=5) is None
