"""Token ids against the libraries: long pieces, added tokens, skipped row groups."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinseek.llm import bpe, token_orc
from twinseek.llm.shared import new_path

FAST, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_of_any_length_are_contracted_as_by_the_library(monkeypatch):
    rng = random.Random(0)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(FAST), special_tokens={})
    pieces = [b"x" * 5000, b"=" * 3001, bytes(rng.choice(b"abcdefghij") for _ in range(2000)), b"the and thethethe ingthe" * 40, "é中漢字仮名".encode() * 100, b"\xff\x00" * 300]
    pieces += [bytes(rng.choice(b" theandig=x") for _ in range(rng.randrange(2, 40))) for _ in range(1500)]
    work = bpe.Coder(FAST)
    for long, rows in ((bpe.LONG, bpe.ROUND_ROWS), (1, 20_000)):
        monkeypatch.setattr(bpe, "LONG", long)
        monkeypatch.setattr(bpe, "ROUND_ROWS", rows)
        n, ids, decoded = work.make(pa.array(pieces, pa.large_binary()))
        for piece, count, found, back in zip(pieces, n.to_pylist(), ids.to_pylist(), decoded.to_pylist()):
            assert [int(x) for x in found.split()] == own._encode_single_piece(piece) and back == piece
            assert count == len(found.split())


def test_added_tokens_have_the_librarys_ids():
    library = Tokenizer.from_file(JSON)
    texts = ["a <|endoftext|> b", "", "<|endoftext|><|endoftext|>", "plain it's", "  <|endoftext|>\n\n x", "<|endoftext|", "é <|endoftext|>中"]
    ids, at = token_orc.encode(pa.array(texts), JSON, 2)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    ids, at = token_orc.encode(pa.array(texts[:3]), JSON, None)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts[:3]]


def test_row_groups_without_an_id_are_skipped(spark):
    path = new_path(spark, "test")
    docs = spark.range(20_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    token_orc.write(docs, path, JSON)

    def scanned(doc_ids):
        rows = token_orc.read(spark, path, doc_ids)
        plan, count = rows._jdf.queryExecution().executedPlan(), len(rows.collect())
        leaves = plan.collectLeaves()
        return count, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    assert scanned(None) == (20_000, 20_000)
    found, read = scanned([4_000])
    assert found == 1 and read <= 1_000  # one row group
    assert scanned([4_001]) == (0, 0)  # the Bloom filter knows that an odd id is not there
    ids = np.concatenate([np.array(r["ids"]) for r in token_orc.read(spark, path, [4_000]).collect()])
    assert ids.tolist() == Tokenizer.from_file(JSON).encode("text 2000", add_special_tokens=False).ids + [2]


def test_memory_is_given_back_after_every_chunk(monkeypatch):
    """Chunks hold half a MB of text, and what the queries of one have freed does not wait for the eighth."""
    given = []
    monkeypatch.setattr(bpe, "give_back", lambda: given.append(1))
    batch = pa.record_batch({"doc_id": pa.array(range(500)), "text": pa.array(["the house " * 1000] * 500)})
    sizes = []
    for part in bpe.encoded(iter([batch]), FAST, True, False):
        assert len(given) >= len(sizes)
        sizes.append(part.num_rows * 10_000)
    assert sum(sizes) == 5_000_000 and max(sizes) <= 1 << 19 and len(given) >= len(sizes)
