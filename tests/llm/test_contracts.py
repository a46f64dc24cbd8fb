"""The registered queries on the smallest tables: columns, types, whole results against the libraries or plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.test_edges import fingerprint
from tests.llm.test_pages import brute
from twinseek.llm import bpe, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def rows_of(spark, name, want):
    got = queries.QUERIES[name](spark, SF)
    types = dict(got.dtypes)
    assert {k: types.get(k) for k in want} == want
    return got.collect()


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1(spark, docs):
    got = rows_of(spark, "op1_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    prints = {d["doc_id"]: fingerprint(d["text"]) for d in docs}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{x:016x}" for i, x in prints.items()} and len(got) == len(docs)
    assert {r["doc_id"]: r["component_id"] for r in got} == components(prints)


def components(prints):
    """By all pairs."""
    root = {i: i for i in prints}
    ids = sorted(prints)
    changed = True
    while changed:
        changed = False
        for i in ids:
            near = min(root[j] for j in ids if (prints[i] ^ prints[j]).bit_count() <= 2)
            if near < root[i]:
                root[i], changed = near, True
    return root


def test_op1_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {}
    for i in range(300):
        x = int(base[rng.integers(40)])
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            x ^= 1 << int(b)
        prints[i] = x
    reps = {}
    for i, x in prints.items():
        reps.setdefault(x, i)
    classes = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)), i) for x, i in reps.items()], "fp long, rep long")
    for tile in (1024, 5):
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(classes, spark, 2, tile), spark).collect()}
        assert {i: found.get(reps[x], reps[x]) for i, x in prints.items()} == components(prints)


def test_op2(spark, docs):
    got = rows_of(spark, "op2_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert len(got) == len(docs) and all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_op2_forward_pass(spark):
    """Every filter at every place of every word, one at a time."""
    rng = np.random.default_rng(0)
    model = toxicity.Model(3)
    model.embedding[:] = rng.normal(size=model.embedding.shape)
    for w in toxicity.WIDTHS:
        model.bias[w][:] = rng.normal(size=toxicity.FILTERS)
    model.out[:] = rng.normal(size=len(model.out))
    model.cuts[:] = rng.normal(size=len(model.cuts))
    texts = ["", "one", "The two of", "der und ist nicht ein Wort", "a b c d e f g", " , ", "le chat les des"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    own = {w: k for k, said in enumerate(toxicity.FUNCTION_WORDS.values(), 1) for w in said.split() if sum(w in s.split() for s in toxicity.FUNCTION_WORDS.values()) == 1}
    for i, t in enumerate(texts):
        words = re.findall(r"[a-z0-9]+", t.lower())
        hashed, _ = toxicity.buckets(toxicity.pa.array([" ".join(words)]))
        vectors = [sum(model.embedding[h] for h in row) for row in hashed]
        pooled = []
        for w in toxicity.WIDTHS:
            places = [sum(vectors[p + j] @ model.filters[w][j] for j in range(w)) + model.bias[w] for p in range(len(words) - w + 1)]
            pooled += list(np.maximum(np.max(places, axis=0), 0)) if places else [0.0] * toxicity.FILTERS
        votes = [sum(own.get(x) == k for x in words) for k in range(len(toxicity.FUNCTION_WORDS) + 1)]
        spoken = int(np.argmax(votes)) if max(votes) else 0
        z = float(np.array(pooled) @ model.out + model.out_bias - model.cuts[spoken])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_op3(spark):
    got = rows_of(spark, "op3_neighbours", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"})
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()}
    hit = 0
    for q in (i for i in rows if i % 100 == 0):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(r["score"] == float(np.sqrt(((rows[r["vec_id"]] - rows[q]) ** 2).sum())) for r in mine)
        best = sorted((float(np.sqrt(((v - rows[q]) ** 2).sum())), i) for i, v in rows.items() if i != q)[:10]
        hit += len({i for _, i in best} & {r["vec_id"] for r in mine})
    assert len(got) == 50 and hit >= 45


def test_op4(spark, docs):
    got = rows_of(spark, "op4_token_orc", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})
    library, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    by = {r["doc_id"]: r for r in got}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        assert tuple(by[d["doc_id"]])[:4] == (d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op5(spark, docs):
    got = rows_of(spark, "op5_mixing", {"doc_id": "bigint", "source": "string", "copies": "int"})
    assert len(got) == len(docs) and all(r["copies"] >= 1 for r in got)
    assert all(r["n_tokens"] == len(re.findall(rb"[^\x20\x09-\x0D]+", next(d["text"] for d in docs if d["doc_id"] == r["doc_id"]).encode())) for r in got[:50])


def test_op6(spark):
    got = rows_of(spark, "op6_pages", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"})
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    want = dict(zip([p["page_id"] for p in pages], brute([(p["page_id"], p["url"], p["html"]) for p in pages])))
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_op7(spark, docs):
    want = {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    by = {r["doc_id"]: r for r in rows_of(spark, "op7_jpeg", want)}
    for d in docs:
        data, r = (d["text"] or "").encode(), by[d["doc_id"]]
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op8(spark, docs):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = rows_of(spark, "op8_duckdb_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    texts = {d["doc_id"]: d["text"] or "" for d in docs}
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_op9(spark, docs):
    got = rows_of(spark, "op9_language", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    lang = {d["doc_id"]: d["lang"] for d in docs}
    assert len(got) == len(docs) and all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]] is not None]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op10(spark, docs):
    want = {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    got = {r["doc_id"]: r for r in rows_of(spark, "op10_maxent", want)}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {d["doc_id"]: re.findall(rb"[^\x20\x09-\x0D]+", (d["text"] or "").translate(lower).encode()) + [None] for d in docs}
    c = pd.Series([w or b" " for i, ws in texts.items() if remainder(i, 7) != 2 for w in ws]).value_counts().to_dict()
    total = sum(c.values())
    for i, ws in texts.items():
        counts = np.array([c.get(w or b" ", 0) for w in ws])
        base = np.log10((counts + 1) / (total + len(c) + 1)).sum()
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(i, 7) == 2, len(ws), int((counts > 0).sum()), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
