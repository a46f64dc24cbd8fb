"""The language model: counts, base and chances against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_edges import ROWS, SCHEMA, docs, empty  # noqa: F401
from twinseek.llm import maxent

MASK = (1 << 64) - 1


def tokens(text):
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode()) if w] + [b" "]


def rows_of(model, own, place, kind):
    """The rows of a word's features, one at a time."""
    none = len(model.words) + maxent.ALIKE + 1
    before = [own[place - k] if place >= k else none for k in (1, 2, 3)]
    turn = lambda key: ((key * 0x9E3779B97F4A7C15) & MASK) >> (64 - maxent.ROWS.bit_length() + 1)
    outer = [before[0] * 8 + 1, (before[0] * 1_000_003 + before[1]) * 8 + 2, before[1] * 8 + 3, before[2] * 8 + 4]
    inner = [(before[k] * maxent.CLASSES + kind) * 8 + 5 + k for k in range(maxent.INNER)]
    return [turn(k) for k in outer], [turn(k) for k in inner]


def distribution(model, own, place):
    """Chances of all classes, and of all outputs of each class of alike words, at a place of a text."""
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    outer, _ = rows_of(model, own, place, 0)
    classes = soft(model.outer[outer].astype(np.float64).sum(0) + model.outer[-1])
    outputs = []
    for a in range(maxent.ALIKE):
        _, inner = rows_of(model, own, place, maxent.SINGLE + a)
        z = model.inner[inner].astype(np.float64).sum(0) + model.inner[maxent.ROWS + a] + model.allowed[a]
        outputs.append(soft(z) if np.isfinite(z).any() else None)
    return classes, outputs


def chance(model, word_id, classes, outputs):
    kind = model.kinds[word_id]
    if kind < maxent.SINGLE:
        return classes[kind]
    if kind < maxent.SINGLE + maxent.ALIKE:
        a, o = kind - maxent.SINGLE, model.out[word_id]
        return classes[kind] * outputs[a][o] * model.counts[word_id] / model.out_n[a][o]
    return classes[kind] / (model.class_n[kind] + model.class_v[kind] + 1)


@pytest.fixture(scope="module")
def prose(spark):
    rng = np.random.default_rng(0)
    names = [f"w{i}" for i in range(400)]
    chances = 1 / np.arange(1, 401)
    rows = [(i, " ".join(rng.choice(names, size=rng.integers(0, 60), p=chances / chances.sum())), "en", "a") for i in range(300)]
    return spark.createDataFrame(rows + [(400, "A new wordé " * 3, "en", "a"), (401, None, "en", "a")], SCHEMA).repartition(5)


def test_scores_are_those_of_plain_python(prose, monkeypatch):
    monkeypatch.setattr(maxent, "DICTIONARY", 250)
    where = F.col("doc_id") % 5 != 0
    model, counts, coded = maxent.train(prose, where)
    texts = {r["doc_id"]: tokens(r["text"]) for r in prose.collect()}
    c = Counter(w for i, ws in texts.items() if i % 5 for w in ws)
    total, ids = sum(c.values()), {w.as_py(): i for i, w in enumerate(model.words)}
    assert len(ids) <= 251 and {w: n for w, n in c.items() if w in ids} == {w: int(model.counts[i]) for w, i in ids.items()}
    last = lambda w: int(maxent.endings(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0]) % maxent.ALIKE
    code = lambda w: ids.get(w, len(ids) + last(w))
    got = {r["doc_id"]: r for r in maxent.score(model, counts, coded).collect()}
    assert set(got) == set(texts)
    for i, ws in list(texts.items())[::7] + [(400, texts[400]), (401, texts[401])]:
        own, want = [code(w) for w in ws], 0.0
        for place, w in enumerate(ws):
            p = chance(model, own[place], *distribution(model, own, place))
            want += math.log10(p * (c[w] + 1 if own[place] >= len(ids) else 1))
        r = got[i]
        assert r["score"] == pytest.approx(want, rel=1e-5) and r["n_tokens"] == len(ws) and r["n_known"] == sum(c[w] > 0 for w in ws) and r["train_tokens"] == total
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws), rel=1e-9)


def test_chances_sum_to_one(prose, monkeypatch):
    """Over all training words and one unknown word of each class, at some places."""
    monkeypatch.setattr(maxent, "DICTIONARY", 250)
    model, counts, _ = maxent.train(prose, F.lit(True))
    others = Counter()
    for r in counts.collect():
        if bytes(r["word"]) not in {w.as_py() for w in model.words}:
            others[int(model.kinds[model.codes(maxent.pa.array([bytes(r["word"])], maxent.pa.large_binary()))][0])] += r["n"] + 1
    for own in ([5, 9, 3, 0], [1], [251, 2, 40, 0]):
        classes, outputs = distribution(model, own, len(own) - 1)
        inside = sum(chance(model, i, classes, outputs) for i in range(len(model.words)))
        outside = sum(classes[k] * (others[k] + 1) / (model.class_n[k] + model.class_v[k] + 1) for k in range(maxent.SINGLE + maxent.ALIKE, maxent.CLASSES))
        empty_ = sum(classes[k] for k in range(maxent.SINGLE + maxent.ALIKE) if model.class_n[k] == 0)
        assert inside + outside + empty_ == pytest.approx(1, abs=1e-6)


def test_features_help_classes_and_words(spark):
    """After x comes a, after y comes b, whatever their frequencies; both are beyond the single words."""
    rng, rows = np.random.default_rng(1), []
    common = [f"c{i}" for i in range(40)]
    for i in range(4000):
        words = list(rng.choice(common, 8)) + [["xx", "aa"], ["yy", "bb"], [], [], []][rng.integers(5)] + list(rng.choice(common, 4))
        rows.append((i, " ".join(words), "en", "a"))
    model, counts, coded = maxent.train(spark.createDataFrame(rows, SCHEMA).repartition(2), F.lit(True))
    ids = {w.as_py(): i for i, w in enumerate(model.words)}
    at = lambda *ws: chance(model, ids[ws[-1]], *distribution(model, [ids[w] for w in ws], len(ws) - 1))
    assert min(model.kinds[ids[w]] for w in (b"aa", b"bb", b"xx", b"yy")) >= maxent.SINGLE
    assert at(b"c1", b"xx", b"aa") > 3 * at(b"c1", b"xx", b"bb") and at(b"c1", b"yy", b"bb") > 3 * at(b"c1", b"yy", b"aa")
    assert at(b"c1", b"xx", b"aa") > 3 * at(b"c1", b"c2", b"aa")


def whole_chance(model, own, place, word_id):
    """chance(), for a word of a group by the steps of the tree below it."""
    classes, outputs = distribution(model, own, place)
    kind = model.kinds[word_id]
    if kind < maxent.SINGLE or kind >= maxent.SINGLE + maxent.ALIKE:
        return chance(model, word_id, classes, outputs)
    none = len(model.words) + maxent.ALIKE + 1
    before = [int(own[place - k]) if place >= k else none for k in (1, 2)]
    p = classes[kind] * outputs[kind - maxent.SINGLE][model.out[word_id]]
    for step in model.branch[model.path[word_id] : model.path[word_id + 1]]:
        node, branch = divmod(int(step), maxent.FAN)
        rows = [((((b * 1_000_003 + node) * 8 + 5 + k) * 0x9E3779B97F4A7C15) & MASK) >> (64 - maxent.TREE_ROWS.bit_length() + 1) for k, b in enumerate(before)]
        z = np.exp(model.below[rows].astype(np.float64).sum(0) + model.node_bias[node])
        p *= z[branch] / z.sum()
    return p


def test_words_of_groups_are_scored_by_a_tree(spark):
    """More words than outputs: scores against plain Python, and the chances of all words sum to one."""
    rng = np.random.default_rng(2)
    names = np.array([f"w{i}" for i in range(6000)])
    rows = [(i, " ".join(names[np.minimum(rng.zipf(1.3, 100) - 1, rng.integers(0, 6000, 100))]), "en", "a") for i in range(400)]
    model, counts, coded = maxent.train(spark.createDataFrame(rows, SCHEMA).repartition(3), F.lit(True))
    n, depth = len(model.words), np.diff(model.path)
    assert n > maxent.SINGLE + maxent.ALIKE * maxent.OUTPUTS and depth.max() > 1
    steps = [(int(model.kinds[i]), int(model.out[i]), *model.branch[model.path[i] : model.path[i + 1]]) for i in range(n)]
    assert len(set(steps)) == n  # every word has outputs of its own
    ids = {w.as_py(): i for i, w in enumerate(model.words)}
    got = {r["doc_id"]: r["score"] for r in maxent.score(model, counts, coded).collect()}
    for i, text, *_ in rows[::100]:
        own = [ids[w] for w in tokens(text)]
        assert got[i] == pytest.approx(sum(math.log10(whole_chance(model, own, place, w)) for place, w in enumerate(own)), rel=1e-5)
    for own in ([7, 900, 1, 0], [n - 1]):
        classes, _ = distribution(model, own, len(own) - 1)
        empty_ = sum(classes[k] for k in range(maxent.CLASSES) if k >= maxent.SINGLE + maxent.ALIKE or model.class_n[k] == 0)
        assert sum(whole_chance(model, own, len(own) - 1, i) for i in range(n)) + empty_ == pytest.approx(1, abs=1e-5)


def test_features_help_words_of_groups(spark):
    """After x3 comes a3zzz: of two words of one group, the one that follows is likelier, whatever their counts."""
    rng = np.random.default_rng(3)
    common = np.array([f"c{i}" for i in range(1200)])
    rows = []
    for i in range(20_000):
        pair = [f"x{(j := rng.integers(60))}", f"a{j}zzz"] * int(rng.integers(2))
        rows.append((i, " ".join([*common[rng.integers(0, 1200, 9)], *pair, *common[rng.integers(0, 1200, 5)]]), "en", "a"))
    model, _, _ = maxent.train(spark.createDataFrame(rows, SCHEMA).repartition(1), F.lit(True))
    ids = {w.as_py(): i for i, w in enumerate(model.words)}
    a, x, gains = [ids[f"a{j}zzz".encode()] for j in range(60)], [ids[f"x{j}".encode()] for j in range(60)], []
    for i in range(60):
        for j in range(60):
            if i != j and model.kinds[a[i]] == model.kinds[a[j]] and model.out[a[i]] == model.out[a[j]]:
                p, q = (whole_chance(model, [1, x[i], w], 2, w) / model.counts[w] for w in (a[i], a[j]))
                gains.append(math.log(p / q))
    assert len(gains) > 20 and np.median(gains) > math.log(2)


def test_gradients_are_summed_by_row():
    """Against a plain sum, with rare and with very frequent rows; and steps leave other rows as they are."""
    rng = np.random.default_rng(4)
    g = rng.normal(size=(3000, 7)).astype(np.float32)
    for rows in (rng.integers(0, 9000, 6000), rng.zipf(1.5, 9000) % 9000, np.full(3000, 5), np.arange(3000)):
        want = np.zeros((9000, 7))
        np.add.at(want, rows, np.tile(g, (len(rows) // 3000, 1)).astype(np.float64))
        at, got = maxent.summed(rows, g, 9000)
        assert sorted(at) == sorted(set(rows.tolist())) and np.allclose(got, want[at], rtol=1e-4, atol=1e-3)
    weights = rng.normal(size=(100, 7)).astype(np.float32)
    before, squares = weights.copy(), np.ones_like(weights)
    maxent.steps(weights, squares, [np.full(50, 3), np.arange(50)], np.zeros(50, np.int64))
    assert (weights[50:99] == before[50:99]).all() and (weights[:50] != before[:50]).any(1).all() and (weights[99] != before[99]).any()


def test_other_words_are_counted_by_class(prose, monkeypatch):
    """The words beyond the dictionary by their endings, and the coded texts hold four bytes a word."""
    monkeypatch.setattr(maxent, "DICTIONARY", 250)
    model, counts, coded = maxent.train(prose, F.lit(True), rounds=0)
    inside, n, v = {w.as_py() for w in model.words}, np.zeros(maxent.CLASSES), np.zeros(maxent.CLASSES)
    for r in counts.collect():
        at = int(model.kinds[model.codes(maxent.pa.array([bytes(r["word"])], maxent.pa.large_binary()))][0])
        n[at], v[at] = n[at] + r["n"], v[at] + 1
        assert (bytes(r["word"]) in inside) == (at < maxent.SINGLE + maxent.ALIKE)
    assert (model.class_n == n).all() and (model.class_v == v).all() and n[maxent.SINGLE + maxent.ALIKE :].sum() > 0
    texts = {r["doc_id"]: tokens(r["text"]) for r in prose.collect()}
    for r in coded.collect():
        own = np.frombuffer(r["ids"], "<i4")
        assert [model.words[int(i)].as_py() if i < len(model.words) else None for i in own] == [w if w in inside else None for w in texts[r["doc_id"]]]


def test_small_dictionaries_need_no_groups(prose, monkeypatch):
    """Classes are evened out: each word has an output of its own."""
    monkeypatch.setattr(maxent, "DICTIONARY", 250)
    model, _, _ = maxent.train(prose, F.lit(True), rounds=0)
    assert len({(int(model.kinds[i]), int(model.out[i])) for i in range(len(model.words))}) == len(model.words)
    assert not len(model.branch)


def test_edges(docs, empty):  # noqa: F811
    got = maxent.scored(docs, F.lit(True)).collect()
    assert len(got) == len(ROWS) and all(r["n_known"] == r["n_tokens"] and r["score"] <= 0 for r in got)
    assert sorted(r["n_tokens"] for r in got) == sorted(len(tokens(t)) for _, t, *_ in ROWS)
    assert maxent.scored(empty, F.lit(True)).count() == 0
    nothing = maxent.scored(docs, F.lit(False)).collect()
    assert len(nothing) == len(ROWS) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in nothing)


def test_words_beside_each_other_are_counted(docs):  # noqa: F811
    """Against a plain count over all texts; words of over LONGEST bytes are not in the dictionary."""
    model, _, coded = maxent.train(docs, F.lit(True), rounds=0)
    ids = {w.as_py(): i for i, w in enumerate(model.words)}
    want = Counter()
    for _, t, *_ in ROWS:
        own = [ids.get(w, 10**9) for w in tokens(t)]
        for i, a in enumerate(own):
            want.update((a, own[j]) for j in (i - 2, i - 1, i + 1, i + 2) if a < len(ids) and 0 <= j < len(own) and 0 < own[j] <= maxent.CONTEXT)
    got = maxent.beside(coded, model)
    assert {(int(a), int(b) + 1): int(got[a, b]) for a, b in zip(*np.nonzero(got))} == want
