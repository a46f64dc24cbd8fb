"""Token ids as ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

Files are dealt out and sorted by doc_id, so that ranges of ids prune files and stripes by their statistics, single ids
also by the Bloom filters, and stripes are read in parallel. A file's rows keep their order in `seq`.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinseek.llm.columns import Known, chunks, clean_utf8, coded, kept, pieces, ranges
from twinseek.llm.shared import cut, new_path, table

OPTIONS = {"compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def encoder(path: str):
    """The tokenizer, its added tokens, and what gives its ids for distinct pieces of text, each encoded once while it is known."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def make(new: pa.Array) -> list[pa.Array]:
        offsets, values = [np.zeros(1, np.int64)], []
        for i in range(0, len(new), 20000):
            found = [x.ids for x in tokenizer.encode_batch_fast([x.decode() for x in new[i : i + 20000].to_pylist()], add_special_tokens=False)]
            offsets.append(np.cumsum([len(x) for x in found]) + offsets[-1][-1])
            values += [np.array(sum(found, []) if len(found) < 2 else [y for x in found for y in x], np.int32)]
        return [pa.LargeListArray.from_arrays(pa.array(np.concatenate(offsets)), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))]

    return tokenizer, [x.content for x in tokenizer.get_added_tokens_decoder().values()], make, Known(1_000_000)


def encode(texts: pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, each text's first id), with end_id after each text's ids. Pieces are those of the file's own byte-level splitter.

    Texts that hold one of the file's added tokens go to the library whole, which takes such tokens out before it splits.
    """
    tokenizer, added, make, known = kept(f"encoder {path}", lambda: encoder(path))
    texts = clean_utf8(texts.cast(pa.large_binary()))
    special = np.zeros(len(texts), bool)
    for content in added:
        special |= pc.match_substring(texts, content.encode()).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(special)
    if len(rows):
        own = [np.array(tokenizer.encode(texts[int(i)].as_py().decode(), add_special_tokens=False).ids, np.int32) for i in rows]
        ids, offsets = encode(pc.if_else(pa.array(special), b"", texts), path, end_id)
        sizes = np.zeros(len(texts), np.int64)
        sizes[rows] = [len(x) for x in own]
        ids = np.insert(ids, np.repeat(offsets[rows], sizes[rows]), np.concatenate(own))
        return ids, offsets + np.append(0, np.cumsum(sizes))
    data, at, doc = pieces(texts)
    distinct, codes = coded(data, at)
    rows, (lists,) = known.look_up(distinct, make)
    first = lists.offsets.to_numpy()
    rows = rows[codes]
    sizes = (first[1:] - first[:-1])[rows]
    ids = lists.values.to_numpy()[ranges(first[rows], sizes)]
    offsets = np.append(0, np.cumsum(sizes))[doc]
    if end_id is not None:
        ids = np.insert(ids, offsets[1:], end_id)
        offsets = offsets + np.arange(len(offsets))
    return ids.astype(np.int32), offsets


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2) -> None:
    """Writes (doc_id, seq, n_tokens, ids) of every whole text to path, in ascending doc_id order.

    Null texts count as empty. Null ids come first; rows of one id stand in the order of their texts. An empty table
    gives files without rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for part in chunks(batches, most=8 << 20):
            ids, offsets = encode(part.column("text"), tokenizer, end_id)
            n = part.num_rows
            for lo in range(0, n, 512):
                hi = min(n, lo + 512)
                lists = pa.ListArray.from_arrays(pa.array((offsets[lo : hi + 1] - offsets[lo]).astype(np.int32)), pa.array(ids[offsets[lo] : offsets[hi]]))
                yield pa.record_batch({"doc_id": part.column("doc_id").slice(lo, hi - lo), "seq": pa.array(np.arange(seq + lo, seq + hi)), "n_tokens": pa.array(np.diff(offsets[lo : hi + 1])), "ids": lists})
            seq += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, "doc_id long, seq long, n_tokens long, ids array<int>").write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of files that write() made; with doc_ids, stripes that cannot hold them are skipped by their metadata."""
    rows = spark.read.schema("doc_id long, seq long, n_tokens long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    Starts are added up in two steps: files' totals, of which there are as many as files, then rows within a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            first, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b].data) for a, b in zip(first[:-1], first[1:])]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "seq": batch.column("seq"), "file": batch.column("file"), "n_tokens": pa.array(np.diff(first).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    rows = read(spark, path).select("doc_id", "seq", "ids", F.col("_metadata.file_name").alias("file"))
    found = cut(rows.mapInArrow(run, "doc_id long, seq long, file string, n_tokens long, ids_crc32 long"), spark)
    files = found.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("least"))
    before = Window.orderBy(F.col("least").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return found.join(files, "file").select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-orc")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return digests(spark, path)
