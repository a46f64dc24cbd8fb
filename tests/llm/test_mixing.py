"""The documents that a mixture takes, recomputed in plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from twinseek.llm import mixing

ROWS = [(i, "w " * (i % 7 + 1), "big") for i in range(900)] + [(1000 + i, "w " * (i % 5), "mid") for i in range(200)]
ROWS += [(2000 + i, "w w w", "small") for i in range(40)] + [(3000, "w", None), (3001, None, "none"), (3000, "w", None)]


def plain(rows, keys, target, repeats):
    """{(source, id): copies}: shares, exponent, budgets and the prefix of blocks and documents, by their hashes."""
    tokens, count = {}, {}
    for i, text, source in rows:
        n = len((text or "").split())
        tokens.setdefault(source, {}).setdefault((keys[i, source]), 0)
        tokens[source][keys[i, source]] += n
        count[source] = count.get(source, 0) + n
    total = sum(count.values())
    shares = [n / total for n in count.values() if n]

    def spread_out(x):
        raised = [p**x for p in shares]
        return -sum(r / sum(raised) * math.log(r / sum(raised)) for r in raised)

    grid = [k / 20000 for k in range(20001)]
    exponent = max((x for x in grid if spread_out(x) >= target * math.log(len(shares))), default=0.0)
    while (max(shares) / min(shares)) ** (1 - exponent) > repeats:
        exponent += 1 / 20000
    out, epochs = {}, {}
    for source, blocks in tokens.items():
        epochs[source] = (max(shares) * total / count[source]) ** (1 - exponent) if count[source] else 1.0
        whole = math.floor(epochs[source] + 1e-9)
        left = math.floor(max(0.0, epochs[source] - whole) * count[source])
        by_block, taken = {}, set()
        for (u, v), n in blocks.items():
            by_block.setdefault(u, {})[v] = n
        for u in sorted(by_block):
            if sum(by_block[u].values()) <= left:
                left -= sum(by_block[u].values())
                taken |= {(u, v) for v in by_block[u]}
                continue
            for v in sorted(by_block[u]):
                if by_block[u][v] > left:
                    break
                left -= by_block[u][v]
                taken.add((u, v))
            break
        out |= {(source, k): whole + (k in taken and epochs[source] > whole) for k in blocks}
    return out, epochs


@pytest.mark.parametrize("settings", [(0.9, 2.0), (0.99, 3.5), (0.3, 2.0)])
@pytest.mark.parametrize("sources", [100_000, 2])
def test_documents_that_are_taken(spark, monkeypatch, settings, sources):
    """With two sources at most in the driver, sums and joins are made by jobs."""
    monkeypatch.setattr(mixing, "SOURCES", sources)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(6)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    hashed = docs.select("doc_id", "source", F.xxhash64(key, F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(mixing.BLOCKS)), F.lit("order")).alias("u"), F.xxhash64("doc_id", F.lit("order")).alias("v"))
    keys = {(r["doc_id"], r["source"]): (r["u"], r["v"]) for r in hashed.collect()}
    want, epochs = plain(ROWS, keys, *settings)
    rows, plan = mixing.decide(docs, target=settings[0], repeats=settings[1])
    got = {(r["source"], keys[r["doc_id"], r["source"]]): (r["copies"], r["epochs"]) for r in rows.collect()}
    # The exponent on the grid is that of the bisection to 1/20000, so a document at the very edge may differ.
    assert set(got) == set(want) and sum(got[k][0] != want[k] for k in want) <= 3
    assert all(abs(e - max(epochs[s], math.floor(epochs[s] + 1e-9))) < 1e-3 for (s, _), (_, e) in got.items())
    assert {r["source"]: r["rows"] for r in plan.collect()} == {"big": 900, "mid": 200, "small": 40, None: 2, "none": 1}
    copies = mixing.realised(docs, target=settings[0], repeats=settings[1]).groupBy("doc_id", "source").count().collect()
    times = {k: sum(1 for i, _, s in ROWS if (s, keys[i, s]) == k) for k in want}
    assert {(r["source"], keys[r["doc_id"], r["source"]]): r["count"] for r in copies} == {k: got[k][0] * times[k] for k in want}
