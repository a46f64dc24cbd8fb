"""The search against brute force: recall, many lengths, hot vectors, few candidates."""

import numpy as np
from pyspark.sql import functions as F

from twinseek.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, q, k=10):
    live = {i: np.array(v) for i, v in rows}
    found = sorted((float(np.sqrt(((v - live[q]) ** 2).sum())), i) for i, v in live.items() if i != q and len(v) == len(live[q]))
    return found[:k]


def test_every_length_is_searched(spark):
    """More lengths than any bound on their number there ever was."""
    rows = [(n * 10 + i, [float(i * j + 1) for j in range(n)]) for n in range(1, 1103) for i in range(3)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()
    assert len(got) == 2 * 1102 and {r["query_id"] for r in got} == {n * 10 for n in range(1, 1103)}
    for q in (10, 500, 11020):
        assert [(r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == brute(rows[3 * (q // 10 - 1) : 3 * (q // 10)], q)


def test_recall_over_blocks_and_a_hot_vector(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in centres[rng.integers(60)] + rng.normal(size=16) * 0.2]) for i in range(3000)]
    rows += [(3000 + i, [0.5] * 16) for i in range(1500)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("vec_id") % 50 == 0, block=128).collect()
    hit = total = 0
    for q in range(0, 4500, 50):
        want, mine = brute(rows, q), sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [r for r, *_ in mine] == list(range(1, 11)) and [(s, i) for _, s, i in mine] == sorted((s, i) for _, s, i in mine)
        assert all(abs(s - np.sqrt(((np.array(rows[i][1]) - np.array(rows[q][1])) ** 2).sum())) < 1e-12 for _, s, i in mine)
        if q >= 3000:
            assert [(s, i) for _, s, i in mine] == want
        hit, total = hit + len({i for _, i in want} & {i for *_, i in mine}), total + 10
    assert hit >= 0.95 * total


def test_lone_vectors_meet_all_blocks(spark):
    """Far from all others, in a block of their own."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)] + [(1000, [1000.0] * 8), (1001, [-1e200] * 8)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") >= 1000, block=16).collect()
    assert {(r["query_id"], r["rank"]) for r in got} == {(q, k) for q in (1000, 1001) for k in range(1, 11)}


def test_likeliest_blocks():
    flips = np.array([0.1, 0.4, 0.01])
    chance = {b: np.prod([f if b >> (2 - i) & 1 else 1 - f for i, f in enumerate(flips)]) for b in range(8)}
    order = sorted(chance, key=lambda b: (-chance[b], b))
    for target in (0.5, 0.9, 0.99, 1.0):
        n = next(n for n in range(1, 9) if sum(chance[b] for b in order[:n]) >= target - 1e-9)
        assert [5 ^ b for b in order[:n]] == neighbours.blocks_within(5, flips, target).tolist()
    assert neighbours.blocks_within(0, np.zeros(0)).tolist() == [0] and len(neighbours.blocks_within(0, np.full(4, 0.5), 1.0)) == 16
