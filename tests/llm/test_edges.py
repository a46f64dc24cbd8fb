"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator; and brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from twinseek.llm import bpe, jpeg, language, mixing, neighbours, pages, simhash, token_orc, toxicity
from twinseek.llm.shared import new_path

LONG = "The quick word " * 20000
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "123 456", "de", "a"), (5, "the cat and the dog of it", "en", "b"),
    (6, "le chat et les chiens dans une maison", "fr", "b"), (7, "le chat et les chiens dans une maison", "fr", "b"), (7, "le chat et les chiens dans une maison", "fr", "b"),
    (None, "no number at all here", None, "b"), (8, LONG, "en", None), (9, "x" * 3000 + " it's 'the end", "en", "c"), (10, "é中   don't\r\n\r\n", "en", "c"),
    (11, "you idiot and scum of the", "en", "c"), (12, "the idiot is that scum", "en", "c"),
]
CLASH = ("fp", "rep", "cell", "part", "row", "n", "word", "key", "block", "rest", "_key", "_u", "count", "toxic", "score", "ids")
SCHEMA = "doc_id long, text string, lang string, source string"
FAST = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.withColumns({c: F.lit(None).cast("string") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(text):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    want = {i: fingerprint(t) for i, t, *_ in ROWS}
    assert all(r["fp"] % (1 << 64) == want[r["doc_id"]] for r in got)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[7] == by[6] == 6 and by[None] is None
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_components_follow_chains_and_tiles(spark):
    rows = spark.createDataFrame([((1 << k) - 1, 100 - k) for k in range(40)] + [(-(1 << 50), 7)], "fp long, rep long")
    roots = simhash.components(simhash.links(rows, spark, 2, tile=4), spark).collect()
    assert {r["node"] for r in roots} == {100 - k for k in range(39)} and {r["root"] for r in roots} == {61}


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i > 10)) for i in range(1, 13)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True), epochs=3)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert len(got) == len({r[0] for r in ROWS}) and all(0 <= s <= 1 for s in got.values()) and got[11] > got[6]
    assert toxicity.train(empty, labels, F.lit(True)) is None and toxicity.scored(empty, None).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (304, []), (None, [1.0] * 8), (305, [1.0, 2.0])]
    rows += [(400 + i, [1.0] * 8) for i in range(40)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, block=64).collect()
    live = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    hit = 0
    for q in {r["query_id"] for r in got}:
        want = sorted((float(np.sqrt(((v - live[q]) ** 2).sum())), i) for i, v in live.items() if i != q)[:10]
        mine = [(r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert len(mine) == 10 and mine == sorted(mine)
        hit += len({i for _, i in want} & {i for _, i in mine})
    assert {r["query_id"] for r in got} == {0, 50, 100, 150, 200, 250, 400} and hit >= 63
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_token_orc(spark, docs, empty):
    from tokenizers import Tokenizer

    json = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(json)
    path = new_path(spark, "test")
    token_orc.write(docs, path, json)
    got = sorted(token_orc.digests(spark, path).collect(), key=lambda r: r["start"])
    start = 0
    for r in got:
        texts = {t or "" for i, t, *_ in ROWS if i == r["doc_id"]}
        want = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want]
        start += r["n_tokens"]
    assert len(got) == len(ROWS) and token_orc.read(spark, path, [5]).count() == 1
    path = new_path(spark, "test")
    token_orc.write(empty, path, json)
    assert token_orc.digests(spark, path).count() == 0


def test_mixing(docs, empty):
    rows, plan = mixing.decide(docs, target=0.99, repeats=3.0)
    rows, plan = rows.collect(), {r["source"]: r for r in plan.collect()}
    assert len(rows) == len(ROWS) and all(r["copies"] >= 1 for r in rows)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert sum(r["n_tokens"] * r["copies"] for r in own) <= own[0]["epochs"] * sum(r["n_tokens"] for r in own) + 1e-6
    assert 1 <= max(p["epochs"] for p in plan.values()) <= 3 + 1e-6
    assert mixing.decide(empty)[0].count() == 0
    assert abs(mixing.entropy([0.5, 0.5], 1) - np.log(2)) < 1e-12 and mixing.find_exponent([0.5, 0.5]) == 1


PAGE = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use</div>{}<aside>More</aside><footer>&copy; x</footer></body></html>'


def test_pages(spark):
    rows = [
        (1, "http://a.b/x/1", PAGE.format("<article><h1>One &amp;  two</h1><p>First<br>line<p>Second</article><div class=comments><p>Nice!</div>")),
        (2, "http://a.b/x/2", PAGE.format("<article><p>Second</p></article>")), (3, None, None), (4, "", ""), (5, "http://c.d/1", "<p>Same</p><p>Own five</p><p>Same end</p>"),
        (6, "http://c.d/2?q", "<p>Same</p><p>Own six</p><p>Same end</p>"), (7, "no url", "plain < text & <b>bold</b>"), (8, "http://e/f", "<nav>unclosed <article><p>Kept"), (None, "http://g", "<!-- <p>no -->yes<!-- open"),
    ]
    got = {r["page_id"]: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash"))).collect()}
    want = {1: "One & two\n\nFirst line\n\nSecond", 2: "Second", 3: "", 4: "", 5: "Own five", 6: "Own six", 7: "plain < text & bold", 8: "Kept", None: "yes"}
    assert {k: r["text"] for k, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert pages.shared(list("abcbdab"), list("bdcaba")) and len(pages.shared(list("abcbdab"), list("bdcaba"))) == 4


def test_jpeg(docs, empty):
    got = jpeg.features(jpeg.with_media(docs)).collect()
    texts = [(i, (t or "").encode()) for i, t, *_ in ROWS]
    assert len(got) == len(ROWS)
    for r in got:
        payload = [t + bytes(max(64, -(-len(t) // 64) * 64) - len(t)) for i, t in texts if i == r["doc_id"]][0]
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["payload_bytes"] == len(payload) and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert jpeg.features(jpeg.with_media(empty)).count() == 0
    noise = np.random.default_rng(1).integers(0, 256, 64 * 9000).astype(np.uint8)
    assert (np.concatenate([t.ravel() for _, t in jpeg.thumbnails(jpeg.store(noise))]) == noise).all()


def test_bpe(docs, empty):
    ranks = bpe.read_ranks(FAST)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_decode(docs, FAST, ids_too=True, texts_too=True).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r["ids"] in [own.encode_ordinary(t or "") for i, t, *_ in ROWS if i == r["doc_id"]]
        assert own.decode_bytes(r["ids"]) == bytes(r["decoded"]) and r["decoded_sha256"] == hashlib.sha256(bytes(r["decoded"])).hexdigest()
    assert bpe.encode_decode(empty, FAST).count() == 0


def test_language(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    names, chances = language.train(docs, path, F.lit(True))
    assert names == ["de", "en", "fr"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, path, names, chances).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[6] == "fr" and got[5] == "en"
    assert language.identify(empty, path).count() == 0


def test_segmentations_are_all_summed():
    words = language.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    chances = np.append(rng.random((words.size, 1)) / words.size, [[language.UNKNOWN]], axis=0)

    def brute(text):
        if not text:
            return 1.0
        total = 0.0
        for k in range(1, len(text) + 1):
            h = np.zeros(1, np.uint64)
            for c in text[:k]:
                h = (h + np.uint64(ord(c))) * language.MULTIPLIER
            rows, found = words.find(h)
            chance = chances[found[0], 0] if len(rows) else language.UNKNOWN if k == 1 else 0
            total += chance * brute(text[k:]) if chance else 0
        return total

    points = np.array([ord(c) for c in "thesezß"], np.uint32)
    got = words.score(points, np.array([0, 5, 7]), chances)
    assert np.allclose(got[:, 0], np.log([brute("▁these"), brute("▁zß")]))
