"""Byte-level BPE by recursive queries in DuckDB, and back.

A partition's distinct pieces of text go to DuckDB as token-position rows. A recursive query joins adjacent tokens with the
merge table and contracts each piece's leftmost pair of least rank until no pair is left; an ordered aggregation joins the
tokens' bytes again. A piece that is a token as it stands is taken whole, as tiktoken does.

One pair a round would need a round for every byte of a long piece. Pieces of over LONG bytes therefore contract all
occurrences of the pair of least rank in one round, from the left, up to the first after which a pair of still lower rank
stands beside the new token: so far one pair after the other would contract the same ones, in the same order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.llm.columns import Known, chunks, coded, give_back, kept, pieces, text_bytes
from twinseek.llm.shared import table

#: Bytes of a piece up to which a round contracts one pair.
LONG = 256
#: Bytes of pieces in one recursive query, and rows that its rounds make, about; a query that is not done by then goes on in the next.
QUERY_BYTES, ROUND_ROWS = 50_000, 1_000_000
#: Bytes of text that are looked at together. What a chunk's queries free is given back after it: allocators would keep more than is used.
CHUNK = 1 << 19
#: Pieces whose ids are kept between chunks.
KEPT = 250_000

ENCODE = """
WITH RECURSIVE seq(gen, piece, pos, id) AS (
  SELECT 0, piece, pos, id FROM at_first
  UNION ALL
  SELECT s.gen + 1, s.piece, CASE WHEN s.pos > b.k THEN s.pos - 1 ELSE s.pos END, CASE WHEN s.pos = b.k THEN b.merged ELSE s.id END
  FROM seq s JOIN (
    SELECT piece, (best & 4294967295)::INT AS k, (best >> 32)::INT AS merged
    FROM (SELECT x.piece, min((m.merged::BIGINT << 32) + x.pos) AS best
          FROM seq x JOIN seq y ON y.piece = x.piece AND y.pos = x.pos + 1 JOIN merges m ON m.l = x.id AND m.r = y.id
          GROUP BY x.piece)) b ON b.piece = s.piece
  WHERE s.pos <> b.k + 1)
SELECT piece, pos, id FROM (SELECT *, max(gen) OVER (PARTITION BY piece) AS last_gen FROM seq) WHERE gen = last_gen
UNION ALL SELECT piece, 0, id FROM whole
"""
ENCODE_LONG = """
WITH RECURSIVE seq(gen, piece, pos, id) AS (
  SELECT 0, piece, pos, id FROM at_first
  UNION ALL
  (WITH pairs AS (
    SELECT x.piece, x.pos, m.l, m.r, m.merged FROM seq x JOIN seq y ON y.piece = x.piece AND y.pos = x.pos + 1 JOIN merges m ON m.l = x.id AND m.r = y.id),
  low AS (SELECT piece, min(merged) AS merged FROM pairs GROUP BY piece),
  hits AS (SELECT pairs.* FROM pairs JOIN low USING (piece, merged)),
  runs AS (SELECT *, pos - row_number() OVER (PARTITION BY piece ORDER BY pos) AS run FROM hits WHERE l = r),
  apart AS (
    SELECT piece, pos, merged FROM hits WHERE l <> r
    UNION ALL
    SELECT piece, pos, merged FROM (SELECT *, row_number() OVER (PARTITION BY piece, run ORDER BY pos) AS k FROM runs) WHERE k % 2 = 1),
  stops AS (
    SELECT a.piece, min(a.pos) AS pos FROM apart a JOIN risky ON risky.id = a.merged
    LEFT JOIN apart b ON b.piece = a.piece AND b.pos = a.pos - 2
    LEFT JOIN seq before ON before.piece = a.piece AND before.pos = a.pos - 1
    LEFT JOIN seq after ON after.piece = a.piece AND after.pos = a.pos + 2
    LEFT JOIN odd o1 ON o1.l = coalesce(b.merged, before.id) AND o1.r = a.merged AND o1.merged < a.merged
    LEFT JOIN odd o2 ON o2.l = a.merged AND o2.r = after.id AND o2.merged < a.merged
    WHERE o1.merged IS NOT NULL OR o2.merged IS NOT NULL GROUP BY a.piece),
  taken AS (SELECT a.* FROM apart a LEFT JOIN stops s USING (piece) WHERE s.pos IS NULL OR a.pos <= s.pos)
  SELECT s.gen + 1, s.piece, (row_number() OVER (PARTITION BY s.piece ORDER BY s.pos) - 1)::INT, coalesce(t.merged, s.id)
  FROM seq s JOIN low ON low.piece = s.piece LEFT JOIN taken t ON t.piece = s.piece AND t.pos = s.pos
  LEFT JOIN taken g ON g.piece = s.piece AND g.pos = s.pos - 1 WHERE g.pos IS NULL AND s.gen < {rounds}))
SELECT piece, pos, id, gen FROM (SELECT *, max(gen) OVER (PARTITION BY piece) AS last_gen FROM seq) WHERE gen = last_gen
"""
DECODE = """
SELECT piece, count(*) AS n, string_agg(id::VARCHAR, ' ' ORDER BY pos) || ' ' AS ids, unhex(string_agg(t.hex, '' ORDER BY pos)) AS bytes
FROM encoded JOIN tokens t USING (id) GROUP BY piece ORDER BY piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """One DuckDB connection with the merge table, and the pieces that it has coded lately."""

    def __init__(self, path: str):
        import duckdb

        self.ranks, self.known = read_ranks(path), Known(KEPT)
        pairs = [(a, b, m) for token, m in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '150MB'")
        self.db.execute("SET temp_directory = ''")  # what a query makes is bounded
        l, r, m = (pa.array(x, pa.int32()) for x in zip(*pairs))
        self.table("merges_in", {"l": l, "r": r, "merged": m})
        self.db.execute("CREATE TABLE merges AS FROM merges_in")
        # Pairs whose token ranks below one of its parts, and such parts.
        self.db.execute("CREATE TABLE odd AS FROM merges WHERE merged < l OR merged < r")
        self.db.execute("CREATE TABLE risky AS SELECT DISTINCT id FROM (SELECT l AS id FROM odd WHERE merged < l UNION ALL SELECT r FROM odd WHERE merged < r)")
        self.table("tokens_in", {"id": pa.array(self.ranks.values(), pa.int32()), "hex": pa.array([x.hex() for x in self.ranks])})
        self.db.execute("CREATE TABLE tokens AS FROM tokens_in")
        give_back()

    def table(self, name: str, columns: dict) -> None:
        self.db.register(name, pa.table(columns))

    def make(self, new: pa.Array) -> list[pa.Array]:
        """(number of ids, ids each with a blank after it, decoded bytes) for each piece."""
        data, at = text_bytes(new)
        parts, lo = [], 0
        while lo < len(new):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + QUERY_BYTES, side="right")) - 1)
            parts.append(self.code(new.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]))
            lo = hi
        empty = [pa.array([], pa.int64()), pa.array([], pa.large_binary()), pa.array([], pa.large_binary())]
        return [pa.concat_arrays(x) for x in zip(empty, *parts)]

    def code(self, new: pa.Array, data: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        n = np.diff(at)
        whole = np.array([self.ranks.get(x, -1) for x in new.to_pylist()], np.int32)
        position = np.arange(len(data)) - np.repeat(at[:-1], n)
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        wholes = {"piece": pa.array(np.flatnonzero(whole >= 0).astype(np.int32)), "id": pa.array(whole[whole >= 0])}
        self.table("whole", wholes)
        use = np.repeat((whole < 0) & (n <= LONG), n)
        self.table("at_first", {"piece": pa.array(owner[use]), "pos": pa.array(position[use].astype(np.int32)), "id": pa.array(self.bytes[data][use])})
        self.db.execute("CREATE OR REPLACE TEMP TABLE encoded AS " + ENCODE)
        use = np.repeat((whole < 0) & (n > LONG), n)
        rows = pa.table({"piece": pa.array(owner[use]), "pos": pa.array(position[use].astype(np.int32)), "id": pa.array(self.bytes[data][use])})
        while rows.num_rows:
            rounds = max(1, ROUND_ROWS // rows.num_rows)
            self.db.register("at_first", rows)
            got = self.db.sql(ENCODE_LONG.replace("{rounds}", str(rounds))).to_arrow_table()
            done = pc.less(got.column("gen"), rounds)
            self.db.register("found", got.filter(done).select(["piece", "pos", "id"]))
            self.db.execute("INSERT INTO encoded FROM found")
            rows = got.filter(pc.invert(done)).select(["piece", "pos", "id"])
        got = self.db.sql(DECODE).to_arrow_table().combine_chunks()
        columns = [got.column(k).cast(t).combine_chunks() for k, t in (("n", pa.int64()), ("ids", pa.large_binary()), ("bytes", pa.large_binary()))]
        return [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in columns]


def coder(path: str) -> Coder:
    return kept(f"duckdb bpe {path}", lambda: Coder(path))


def encoded(batches: Iterator[pa.RecordBatch], path: str, ids_too: bool, texts_too: bool) -> Iterator[pa.RecordBatch]:
    """encode_decode() of a task's rows."""
    work = coder(path)
    for part in chunks(batches, most=CHUNK):
        data, at, doc = pieces(part.column("text"))
        distinct, codes = coded(data, at)
        rows, columns = work.known.look_up(distinct, work.make)
        rows = pa.array(rows[codes])
        n = np.append(0, np.cumsum(columns[0].take(rows).to_numpy()))[doc]
        out = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(n).astype(np.int64))}
        for name, column, cut_off in (("ids", columns[1], 1), ("decoded", columns[2], 0)):
            all_bytes, ends = text_bytes(column.take(rows))
            ends = ends[doc]
            view = memoryview(np.ascontiguousarray(all_bytes))
            spans = [(a, max(a, b - cut_off)) for a, b in zip(ends[:-1], ends[1:])]
            out[f"{name}_sha256"] = pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in spans], pa.string())
            if name == "ids" and ids_too:
                values = np.fromstring(bytes(view), np.int32, sep=" ") if len(view) else np.zeros(0, np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), pa.array(values))
            if name == "decoded" and texts_too:
                out["decoded"] = pa.array([bytes(view[a:b]) for a, b in spans], pa.binary())
        yield pa.record_batch({k: out[k] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded") if k in out})
        give_back()


def encode_decode(docs: DataFrame, path: str, ids_too: bool = False, texts_too: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ids_too also ids, with texts_too also the decoded bytes, of every row.

    Null texts count as empty; the empty text has no ids, and its digests are those of nothing. Null or repeated ids and
    other columns make no difference.
    """
    more = ["ids array<int>"] * ids_too + ["decoded binary"] * texts_too
    schema = ", ".join(["doc_id long", "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *more])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: encoded(batches, path, ids_too, texts_too), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
