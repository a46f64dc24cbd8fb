"""Approximate nearest neighbours by a forest of hash prefixes.

Vectors are dealt to blocks by a short prefix of hash bits, signs of projections through the mean of their length; a block
that many vectors share is dealt out in parts. In a part each tree sorts long strings of such bits. A query descends in every
tree to its longest matching prefix, then ascends in all trees together, one bit at a time, until a neighbour as near as its
k-th best so far is unlikely to share no prefix with it; a prefix gives all its vectors, however many. Candidates are ranked
by their exact distance.

A query first meets its own block. The distance of its k-th best there tells how likely a nearer neighbour's bits differ, so
it then goes to the blocks that together hold such a neighbour with probability REACH, the likeliest first: few where vectors
have near neighbours, most where they have none. Queries that still have fewer than k meet all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinseek.llm.columns import give_back
from twinseek.llm.shared import cut, table

TREES, BITS, SEED = 24, 48, 42
#: Vectors in a block on average, and queries in a pack.
BLOCK, PACK = 2048, 512
#: The chance that a neighbour is missed by a block's trees, and that it is in one of the blocks that are asked.
MISS, REACH = 0.05, 0.96
#: Vectors that a length's mean is taken of, about.
SAMPLE = 2000
#: Rows of a table that is sent to all tasks, at most; a larger one is joined by its keys.
SENT = 100_000


def directions(dims: int, bits: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dims, bits))


def signs(vectors: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """On which side of the mean a vector is along each axis. Scaled, so that large components do no harm."""
    with np.errstate(all="ignore"):
        scale = np.maximum(np.abs(vectors).max(1, keepdims=True), 1e-300)
        return (vectors / scale) @ axes > (mean @ axes) / scale


def strings(vectors: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Hash strings of BITS bits, by vector and tree, as integers whose first bit is the highest."""
    return signs(vectors, mean, axes).reshape(len(vectors), -1, BITS) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)[::-1])


def enough(reach: float, norm: float) -> int:
    """The longest prefix at which trees miss a neighbour at the distance `reach` with a chance of MISS at most."""
    half = min(1.0, reach / (2 * norm)) if norm > 0 and reach < np.inf else 1.0
    same = 1 - 2 * np.arcsin(half) / np.pi
    if same <= 0:
        return 0
    return BITS if same >= 1 else int(min(BITS, np.log(1 - MISS ** (1 / TREES)) / np.log(same)))


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance): of each query the k nearest candidates of a part, ties to the smaller id. reach: the distance of
    the k-th best that is known of elsewhere, or infinity."""
    with np.errstate(all="ignore"):
        mean = vectors.mean(0)
        mean = np.where(np.isfinite(mean), mean, 0)
        norms = np.sqrt(((queries - mean) ** 2).sum(1))
    axes = directions(vectors.shape[1], TREES * BITS)
    keys, query_keys = strings(vectors, mean, axes), strings(queries, mean, axes)
    order = np.argsort(keys, axis=0, kind="stable")
    low, high = np.zeros((BITS + 1, TREES, len(queries)), np.int64), np.zeros((BITS + 1, TREES, len(queries)), np.int64)
    for t in range(TREES):
        tree = keys[order[:, t], t]
        for depth in range(BITS + 1):
            rest = np.uint64((1 << (BITS - depth)) - 1)
            low[depth, t] = np.searchsorted(tree, query_keys[:, t] & ~rest)
            high[depth, t] = np.searchsorted(tree, query_keys[:, t] | rest, side="right")
    wanted = min(len(ids), k + 1)
    sizes = (high - low).sum(1)
    out = []
    for q in range(len(queries)):
        # Fewer than these cannot be enough; above, the trees ascend together.
        depth = max(int(np.flatnonzero(sizes[:, q] >= wanted)[-1]), 0)
        seen, distance = np.zeros(len(ids), bool), np.full(len(ids), np.nan)
        while True:
            for t in range(TREES):
                seen[order[low[depth, t, q] : high[depth, t, q], t]] = True
            new = np.flatnonzero(seen & np.isnan(distance))
            with np.errstate(all="ignore"):
                distance[new] = np.sqrt(((vectors[new] - queries[q]) ** 2).sum(1))
            found = np.flatnonzero(seen & (ids != query_ids[q]))
            best = min(reach[q], np.partition(distance[found], k - 1)[k - 1] if len(found) >= k else np.inf)
            if depth <= enough(best, norms[q]):
                break
            depth -= 1
        own = distance[found]
        if len(found) > k:
            on = np.flatnonzero(own <= np.partition(own, k - 1)[k - 1])
            found, own = found[on], own[on]
        first = np.lexsort((ids[found], own))[:k]
        out.append((np.full(len(first), query_ids[q]), ids[found[first]], own[first]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def deviations(margin: np.ndarray, reach: float, away: float, dims: int) -> np.ndarray:
    """How many standard deviations a neighbour at the distance `reach` is from the other side of each axis, of a vector that
    is `away` from the mean, if it is as far from the mean and otherwise in any direction."""
    if not reach > 0:
        return np.full(len(margin), 40.0)
    half = reach / (2 * away) if away > 0 else 1.0
    if not half < 0.7:
        return np.zeros(len(margin))
    steps = margin * (1 - 2 * half * half) / (reach * np.sqrt(1 - half * half)) * np.sqrt(dims)
    return np.where(np.isfinite(steps), steps, 0)


def blocks_within(prefix: int, flips: np.ndarray, target: float = REACH) -> np.ndarray:
    """The likeliest blocks that together hold a neighbour with the chance `target`, when each bit of the query's prefix, the
    highest first, differs in the neighbour with the chance in `flips` (0.5 at most). The query's own block is the first."""
    bits = len(flips)
    if not bits:
        return np.array([prefix])
    flips = np.clip(flips, 1e-12, 0.5)
    costs, base = np.log((1 - flips) / flips), np.log1p(-flips).sum()
    most = max(costs.min(), 1.0)
    while True:
        total, mask = np.zeros(1), np.zeros(1, np.int64)
        for i, c in enumerate(costs):
            on = total + c <= most
            total, mask = np.append(total, total[on] + c), np.append(mask, mask[on] | (1 << (bits - 1 - i)))
        chance = np.exp(base - total)
        if chance.sum() >= target or most >= costs.sum():
            break
        most *= 1.3
    order = np.lexsort((mask, total))
    n = int(np.searchsorted(np.cumsum(chance[order]), min(target, chance.sum()) - 1e-12)) + 1
    return prefix ^ mask[order][:n]


def joined(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of a table that is sent to all tasks if it has SENT rows at most."""
    return rows.join(F.broadcast(small) if small.count() <= SENT else small, on)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query's candidates, all rows but its own, by Euclidean distance.

    vectors has vec_id and embedding; other columns are ignored but by is_query. Vectors that are null, empty or zero or have
    null or non-finite components, and rows without an id, take no part. Vectors of other lengths than a query's are no
    candidates; there may be any number of lengths. Of rows with one id the first by their components stays. Fewer candidates
    give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    own = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size(own) > 0) & F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(own, lambda x: x != 0))
    rows = cut(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")).withColumn("d", F.size("v")), spark)

    # Of each length the number of vectors, the bits of a block's prefix, and the mean.
    lengths = rows.groupBy("d").agg(F.count("*").alias("n")).withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / block))).cast("int"))
    some = joined(rows, lengths, ["d"]).filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.ceil(F.col("n") / SAMPLE)) == 0)
    at = some.select("d", F.posexplode("v").alias("i", "x")).groupBy("d", "i").agg(F.avg("x").alias("x"))
    means = at.groupBy("d").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    lengths = cut(lengths.join(means, "d", "left"), spark)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's block."""
        axes: dict = {}
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for i, (d, bits) in enumerate(zip(batch.column("d").to_pylist(), batch.column("bits").to_pylist())):
                if bits:
                    if (d, bits) not in axes:
                        axes[d, bits] = directions(d, bits, SEED + 1)
                    mean = np.zeros(d) if batch.column("mean")[i].as_py() is None else batch.column("mean")[i].values.to_numpy()
                    side = signs(batch.column("v")[i].values.to_numpy()[None], mean, axes[d, bits])[0]
                    out[i] = side @ (1 << np.arange(bits, dtype=np.int64)[::-1])
            yield pa.record_batch({k: batch.column(k) for k in ("vec_id", "v", "asks", "d")} | {"block": pa.array(out)})
        give_back()

    rows = cut(joined(rows, lengths, ["d"]).mapInArrow(placed, "vec_id long, v array<double>, asks boolean, d int, block long"), spark)
    counts = rows.groupBy("d", "block").agg(F.count("*").alias("n"), F.count_if("asks").alias("queries"))
    counts = cut(counts.select("d", "block", F.ceil(F.col("n") / (2 * block)).alias("parts"), F.ceil(F.col("queries") / PACK).alias("packs")), spark)
    pack = F.collect_list(F.struct("vec_id", "v")).alias("pack")
    there = joined(rows, counts.select("d", "block", "parts"), ["d", "block"]).groupBy("d", "block", F.pmod(F.xxhash64("vec_id"), "parts").alias("part")).agg(pack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, query_ids, reach = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "query_ids", "reach"))
                d = batch.column("d")[i].as_py()
                v, q = (batch.column(c)[i].values.flatten().to_numpy().reshape(-1, d) for c in ("v", "q"))
                found = search(ids, v, query_ids, q, reach, k)
                if len(found[0]):
                    yield pa.record_batch(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found))))
        give_back()

    def asked(queries: DataFrame) -> DataFrame:
        """What blocks give to queries (query_id, q, reach, d, block), in packs."""
        number = queries.groupBy("d", "block").agg(F.ceil(F.count("*") / PACK).alias("packs"))
        packs = queries.join(number, ["d", "block"]).groupBy("d", "block", F.pmod(F.xxhash64("query_id", F.lit(2)), "packs").alias("no"))
        packs = packs.agg(F.collect_list(F.struct("query_id", "q", "reach")).alias("asked"))
        pairs = packs.join(there, ["d", "block"]).select(
            "d", F.col("pack.vec_id").alias("ids"), F.col("pack.v").alias("v"), F.col("asked.query_id").alias("query_ids"), F.col("asked.q").alias("q"), F.col("asked.reach").alias("reach")
        )
        return pairs.mapInArrow(run, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    queries = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "d", "block")
    first = cut(best(asked(queries.withColumn("reach", F.lit(float("inf"))))).drop("rank"), spark)
    known = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("farthest"))
    known = queries.join(known, "query_id", "left").withColumn("reach", F.when(F.col("n") >= k, F.col("farthest")))
    known = joined(known.drop("n"), lengths, ["d"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other blocks that a query goes to. Without k found, what was found or its distance from the mean tells the scale."""
        from math import erf

        for batch in batches:
            for i in range(batch.num_rows):
                d, bits, home = (batch.column(c)[i].as_py() for c in ("d", "bits", "block"))
                if not bits:
                    continue
                q = batch.column("q")[i].values.to_numpy()
                mean = np.zeros(d) if batch.column("mean")[i].as_py() is None else batch.column("mean")[i].values.to_numpy()
                axes = directions(d, bits, SEED + 1)
                reach = batch.column("reach")[i].as_py()
                with np.errstate(all="ignore"):
                    away = float(np.sqrt(((q - mean) ** 2).sum()))
                    scale = reach if reach is not None else max(batch.column("farthest")[i].as_py() or 0.0, 2 * away)
                    margin = np.abs((q - mean) @ axes) / np.sqrt((axes**2).sum(0))
                flips = np.array([0.5 * (1 - erf(s / np.sqrt(2))) for s in deviations(margin, scale, away, d)])
                others = blocks_within(home, flips)
                others = others[others != home]
                if len(others):
                    n = len(others)
                    yield pa.record_batch({"query_id": pa.array(np.full(n, batch.column("query_id")[i].as_py())), "q": batch.column("q").take(pa.array(np.full(n, i))), "reach": pa.array(np.full(n, np.inf if reach is None else reach)), "d": pa.array(np.full(n, d, np.int32)), "block": pa.array(others)})
        give_back()

    further = known.mapInArrow(spread, "query_id long, q array<double>, reach double, d int, block long")
    found = cut(best(first.unionByName(asked(further.join(counts.select("d", "block"), ["d", "block"])))), spark)

    # Queries whose blocks held fewer than k of the vectors that there are meet all blocks.
    short = queries.join(found.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").join(lengths.select("d", "n"), "d")
    short = cut(short.filter(F.coalesce("have", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("query_id", "q", "d"), spark)
    if not short.isEmpty():
        every = short.join(counts.select("d", "block"), "d").withColumn("reach", F.lit(float("inf")))
        rest = best(asked(every))
        found = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
