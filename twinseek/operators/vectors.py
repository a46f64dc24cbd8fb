"""Exact similarity joins of vectors: blocks of vectors meet others as matrices, and each task keeps what it must."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinseek.functions.text import let

BLOCK, PACK = 4096, 512
#: Vectors of a block that a task holds, and rows that it gives together, about.
HELD, ROWS = 8192, 100_000
#: Queries, and numbers of their vectors, that are sent to all tasks, at most: 64 MB.
SENT, SENT_VALUES = 50_000, 8_000_000


def dot(a: Column, b: Column) -> Column:
    """M2."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """M1: of length 1; the zero vector stays as it is."""
    both = F.struct(a.alias("a"), norm(a).alias("n"))
    return let(both, lambda b: F.transform(b["a"], lambda x: F.when(b["n"] > 0, x.cast("double") / b["n"]).otherwise(x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """M3: null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def _matrices(ids: np.ndarray, vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vectors the ids and the matrix of them; zero, null and non-finite ones have no similarity and are left out."""
    at, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes, out = np.diff(at), {}
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        m = values[at[rows][:, None] + np.arange(d)]
        with np.errstate(all="ignore"):
            size = np.sqrt((m * m).sum(1))
            on = np.isfinite(size) & (size > 0)
        out[int(d)] = ids[rows[on]], m[on] / size[on][:, None]
    return out


def _beside(ids: np.ndarray, vectors: pa.ListArray, asked: dict) -> dict[int, np.ndarray]:
    """By length the unit vectors of the queries' second vectors, in the order of `asked`; NaN where there is none."""
    of = {d: dict(zip(own.tolist(), m)) for d, (own, m) in _matrices(ids, vectors).items()}
    return {d: np.array([of.get(d, {}).get(i, np.full(d, np.nan)) for i in qid.tolist()]).reshape(-1, d) for d, (qid, _) in asked.items()}


def _hits(asked: dict, there: dict, threshold: float | None, k: int | None, beside: dict | None = None) -> Iterator[pa.RecordBatch]:
    """What of two tables of matrices is alike; of each query the k best at most."""
    for d in asked.keys() & there.keys():
        (qid, q), (cid, c) = asked[d], there[d]
        for lo in range(0, len(qid), PACK):
            s, own = q[lo : lo + PACK] @ c.T, qid[lo : lo + PACK]
            ok = own[:, None] != cid[None]
            if threshold is not None:
                ok &= s >= threshold
            if k is not None:
                for r in np.flatnonzero(ok.sum(1) > k):
                    on = np.flatnonzero(ok[r])
                    ok[r, on[np.lexsort((cid[on], -s[r, on]))[k:]]] = False
            row, column = np.nonzero(ok)
            first, second = s[row, column], None
            if beside is not None:
                w = beside[d][lo : lo + PACK]
                second = (w @ c.T)[row, column]
                near = np.flatnonzero(np.abs(second - first) < 1e-9)  # equal vectors must have equal cosines, which products of matrices need not give
                at, by = q[lo + row[near]], c[column[near]]
                first[near], second[near] = (at * by).sum(1), (w[row[near]] * by).sum(1)
            for at in range(0, len(row), ROWS):
                part = slice(at, at + ROWS)
                columns = {"query_id": pa.array(own[row[part]]), "id": pa.array(cid[column[part]]), "similarity": pa.array(first[part])}
                yield pa.record_batch(columns if second is None else columns | {"beside": pa.array(second[part], from_pandas=True)})


def _clean(rows: DataFrame, *also: str) -> DataFrame:
    plain = lambda v: F.transform(v, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))
    return rows.filter(F.col("id").isNotNull() & (F.size("v") > 0)).select(F.col("id").cast("long").alias("id"), plain("v").alias("v"), *(plain(c).alias(c) if c == "beside" else c for c in also))


def _in_blocks(blocks: int, own: DataFrame, others: DataFrame, columns: list[str], make: Callable, of: Callable, schema: str) -> DataFrame:
    """of(made, batch) of each block of rows, which make() has made ready, and batches of the rows that are dealt to it.

    own: (block, *columns); others: the same, a row for each block that it meets. A task holds a block and a batch.
    """
    columns = list(dict.fromkeys(["block", *columns]))
    rows = own.select(F.lit(0).alias("later"), *columns).unionByName(others.select(F.lit(1).alias("later"), *columns))
    rows = rows.repartitionById(blocks, "block").sortWithinPartitions("block", "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, made = None, [], None
        for batch in batches:
            key = batch.column("block").to_numpy() * 2 + batch.column("later").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo).select(columns)
                if key[lo] // 2 != block:
                    block, held, made = key[lo] // 2, [], None
                if key[lo] % 2 == 0:
                    held.append(part)
                elif held:
                    made = made or make(pa.Table.from_batches(held).combine_chunks())
                    for at in range(0, part.num_rows, BLOCK):
                        yield from of(made, part.slice(at, BLOCK))

    return rows.mapInArrow(run, schema)


def similar(queries: DataFrame, corpus: DataFrame, threshold: float | None = None, k: int | None = None, beside: bool = False) -> DataFrame:
    """(query_id, id, similarity) by cosine, itself excluded: those of at least the threshold, the k best, or both.

    Both tables have (id, v). Vectors of other lengths than a query's, and null, empty, zero or non-finite ones, have no
    similarity. Ties go to the smaller id. SENT queries at most are sent to all tasks, which read the corpus where it is; of more
    each task holds a block, which the corpus passes. With `beside` queries have a second vector of that name, and what is found
    its cosine with it, or null: vectors are never joined to pairs.
    """
    also, schema = (["beside"] if beside else []), "query_id long, id long, similarity double" + (", beside double" if beside else "")
    queries, corpus = _clean(queries, *also), _clean(corpus)
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v") * (2 if beside else 1)), F.lit(0)).alias("values")).first()

    def made(rows: pa.Table) -> tuple[dict, dict | None]:
        ids = rows.column("id").to_numpy()
        asked = _matrices(ids, _one(rows.column("v")))
        return asked, _beside(ids, _one(rows.column("beside")), asked) if beside else None

    def met(held: tuple, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return _hits(held[0], _matrices(part.column("id").to_numpy(), _one(part.column("v"))), threshold, k, held[1])

    if size["n"] <= SENT and size["values"] <= SENT_VALUES:
        told = queries.sparkSession.sparkContext.broadcast(made(queries.toArrow()))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK):
                    yield from met(told.value, batch.slice(lo, BLOCK))

        found = corpus.mapInArrow(near, schema)
    else:
        blocks = _blocks(size["n"])
        asked = queries.withColumn("block", _block(blocks))
        there = corpus.select("id", "v", *(F.lit(None).cast("array<double>").alias(c) for c in also), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        found = _in_blocks(blocks, asked, there, ["id", "v", *also], made, met, schema)
    if k is None:
        return found
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def pair_counts(rows: DataFrame, threshold: float) -> DataFrame:
    """(tp, fp): of pairs of rows (id, v, label) with a cosine of at least the threshold how many have the same label, and
    how many have not; null is no one's. All pairs are compared, each once, in blocks; a task tells its counts only."""
    rows = _clean(rows, "label").withColumn("label", F.col("label").cast("string"))
    blocks = _blocks(rows.count())
    rows = rows.withColumn("own", _block(blocks))
    # Of two blocks one meets the other's rows: that from which the other is not more than half the way around.
    way = F.pmod(F.col("own") - F.col("block"), F.lit(blocks))
    half = (way * 2 < blocks) | ((way * 2 == blocks) & (F.col("block") < F.col("own")))
    met = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).filter(half)

    def made(part) -> dict:
        """By length ids, matrix, labels, and whether a row is of the block that it meets, of which each pair is to count once."""
        ids = part.column("id").to_numpy()
        of = dict(zip(ids.tolist(), zip(part.column("label").to_pylist(), (part.column("own").to_numpy() == part.column("block").to_numpy()).tolist())))
        return {d: (own, m, [of[i][0] for i in own.tolist()], np.array([of[i][1] for i in own.tolist()])) for d, (own, m) in _matrices(ids, _one(part.column("v"))).items()}

    def count(held: dict, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        same = every = 0
        for d, (cid, c, told, inner) in made(part).items():
            if d not in held:
                continue
            qid, q, names, _ = held[d]
            codes = {n: i for i, n in enumerate({*names, *told} - {None})}
            a, b = (np.array([codes.get(n, -1) for n in x])[:, None] for x in (names, told))
            for lo in range(0, len(qid), PACK):
                mine = a[lo : lo + PACK]
                hit = (q[lo : lo + PACK] @ c.T >= threshold) & (mine >= 0) & (b >= 0).T
                if inner.any():
                    hit &= ~inner[None] | (qid[lo : lo + PACK][:, None] < cid[None])
                every += int(np.count_nonzero(hit))
                same += int(np.count_nonzero(hit & (mine == b.T)))
        yield pa.record_batch({"tp": pa.array([same]), "fp": pa.array([every - same])})

    found = _in_blocks(blocks, met.filter("own = block"), met, ["id", "v", "label", "own"], made, count, "tp long, fp long")
    return found.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"))


def _one(lists) -> pa.ListArray:
    """A list array that begins at its first value, whatever it was cut from."""
    return pa.concat_arrays(lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]) if not isinstance(lists, pa.ChunkedArray) or lists.num_chunks else pa.array([], lists.type)


def _blocks(n: int) -> int:
    return max(1, -(-n // HELD))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")


def nearer_to_first(pairs: DataFrame, first: Column, second: Column) -> DataFrame:
    """pairs that are nearer to the first vector than to the second; no similarity, no pair."""
    return pairs.filter(second < first)
