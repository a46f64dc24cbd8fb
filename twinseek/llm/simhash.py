"""SimHash near duplicates by tiled exact comparison.

Fingerprints are compared in tiles of equal population counts of their four 16-bit quarters. The sum of the four counts'
differences is at most the Hamming distance, so tiles whose counts are further apart than the radius are skipped and no
link is lost. Distinct fingerprints only are compared; copies share a class. There are at most 17^4 = 83,521 counts, so what
the tasks get of them is bounded. A tile has at most TILE fingerprints or so, however many share its counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.llm.columns import chunks, give_back, lower_ascii, ranges, spaces, text_bytes, xxh64
from twinseek.llm.shared import cut, new_path

#: Fingerprints in a tile on average, where counts are shared by more.
TILE = 1024
CELLS = 17**4
#: Words of a wide fingerprint, and bits by which similar sets may differ in the first word and in all. At a similarity of 0.8
#: a bit differs with a chance of 0.15 (at worst, 4 of 5 shingles, 0.19), so 39 (48) of 256 do, give or take 6.
WIDE, FIRST, RADIUS = 4, 23, 76
#: Wide fingerprints in a tile, at most.
WIDE_TILE = 1 << 14
#: Members of a group that meet its leader in one place, and shingles of members that are compared together, about.
SPREAD, TILE_SHINGLES = 10_000, 250_000
#: Rows of a table that is sent to all tasks, at most.
SENT = 100_000
#: Bits that tell which ids are in candidates.
BITS = 1 << 26


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) texts with one blank after each run of letters: (bytes, begin and end of each word, each text's first word).

    Words of two texts may touch, as no shingle holds both.
    """
    inside = ~spaces()[data]
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = inside[edge]
    ends[edge[edge > 0] - 1] = inside[edge[edge > 0] - 1]
    place = np.cumsum(kept, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    starts = np.flatnonzero(begins)
    doc = np.searchsorted(starts, offsets)
    begin, end = place[starts] - 1, place[ends]
    joined = lower_ascii()[data]
    joined[~inside] = 32
    return joined[kept], begin, end, doc


def shingled(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of each word shingle, shingles of each text). Fewer words than size are one shingle, no words none."""
    joined, begin, end, doc = spaced(*text_bytes(texts))
    n = np.diff(doc)
    shingles = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = ranges(doc[:-1], shingles)
    last = first + np.repeat(np.minimum(n, size) - 1, shingles)
    return xxh64(joined, begin[first], end[last] - begin[first]), shingles


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of each text's hashes."""
    out = np.zeros(len(counts), np.uint64)
    if len(full := np.flatnonzero(counts)):
        edges = np.append(0, np.cumsum(counts[full]))
        ones = np.zeros((len(full), 64), np.int64)
        step, lo = 1 << 15, 0
        while lo < len(full):
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + step, side="right")) - 1)
            for part in range(edges[lo], edges[hi], step) if hi == lo + 1 else (edges[lo],):
                stop = min(part + step, edges[hi]) if hi == lo + 1 else edges[hi]
                bits = np.unpackbits(hashes[part:stop].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[lo:hi] += np.add.reduceat(bits, np.array([0]) if hi == lo + 1 else edges[lo:hi] - part, axis=0, dtype=np.int64)
            lo = hi
        out[full] = np.packbits(ones * 2 > counts[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(texts: pa.Array, size: int = 3) -> np.ndarray:
    """64-bit fingerprints of texts, by word shingles of the given size."""
    return majority(*shingled(texts, size))


def with_fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null texts count as empty, whose fingerprint is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            yield pa.record_batch({"doc_id": part.column("doc_id"), "fp": pa.array(fingerprints(part.column("text"), size).view(np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def neighbours(radius: int) -> np.ndarray:
    """All differences of four counts whose sizes sum to the radius at most."""
    steps = range(-radius, radius + 1)
    grid = np.array(np.meshgrid(steps, steps, steps, steps)).reshape(4, -1).T
    return grid[np.abs(grid).sum(1) <= radius]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: each node to the smallest of its component."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    on = label != np.arange(len(nodes))
    return nodes[on], nodes[label[on]]


def links(classes: DataFrame, spark: SparkSession, radius: int = 2, tile: int = TILE) -> DataFrame:
    """(u, v): links between the representatives of fingerprints that differ in 1 to radius bits; the components of all such."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(65535)) for k in range(4)]
    cells = cut(classes.filter("rep is not null").withColumn("cell", sum((q * 17**k for k, q in enumerate(quarter)), F.lit(0))), spark)
    sizes = np.zeros(CELLS, np.int64)
    for row in cells.groupBy("cell").count().toLocalIterator():  # CELLS rows at most
        sizes[row["cell"]] = row["count"]
    parts = -(-sizes // tile)
    spread = spark.sparkContext.broadcast(parts)
    near = neighbours(radius)

    if parts.max() > 1:
        shares = spark.createDataFrame([(int(c), int(parts[c])) for c in np.flatnonzero(parts)], "cell int, parts long")
        tiles = cells.join(F.broadcast(shares), "cell").withColumn("part", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")))
    else:
        tiles = cells.withColumn("part", F.lit(0).cast("long"))
    tiles = tiles.groupBy("cell", "part").agg(F.collect_list(F.struct("fp", "rep")).alias("tile")).select("cell", "part", F.col("tile.fp").alias("fp"), F.col("tile.rep").alias("rep"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every tile once to each pair of tiles that it is in."""
        parts = spread.value
        for batch in batches:
            cell, part = (batch.column(k).to_numpy().astype(np.int64) for k in ("cell", "part"))
            for i in range(batch.num_rows):
                mine = np.array([cell[i] // 17**k % 17 for k in range(4)])
                others = mine + near
                others = others[((others >= 0) & (others <= 16)).all(1)] @ np.array([17**k for k in range(4)])
                others = others[parts[others] > 0]
                other = np.repeat(others, parts[others])
                number = np.concatenate([np.arange(parts[o]) for o in others])
                a, b = np.full(len(other), cell[i]) * (1 << 32) + part[i], other * (1 << 32) + number
                yield pa.record_batch({"lo": pa.array(np.minimum(a, b)), "hi": pa.array(np.maximum(a, b)), "fp": batch.column("fp").take(pa.array(np.full(len(a), i))), "rep": batch.column("rep").take(pa.array(np.full(len(a), i)))})
        give_back()

    pairs = tiles.mapInArrow(deal, "lo long, hi long, fp array<long>, rep array<long>").groupBy("lo", "hi").agg(F.collect_list(F.struct("fp", "rep")).alias("tiles")).select(F.col("tiles.fp").alias("fp"), F.col("tiles.rep").alias("rep"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for fp, rep in zip(batch.column("fp"), batch.column("rep")):
                fp, rep = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in fp], [x.values.to_numpy(zero_copy_only=False) for x in rep]
                a, b = fp[0], fp[-1]
                found_u, found_v = [], []
                for lo in range(0, len(a), 256):
                    i, j = np.nonzero(np.bitwise_count(a[lo : lo + 256, None] ^ b[None, :]) <= radius)
                    u, v = rep[0][i + lo], rep[-1][j]
                    on = u != v
                    found_u.append(u[on])
                    found_v.append(v[on])
                u, v = np.concatenate(found_u), np.concatenate(found_v)
                if len(u):
                    u, v = forest(u, v)
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.record_batch({"u": pa.array(np.concatenate(us)), "v": pa.array(np.concatenate(vs))})
        give_back()

    return pairs.mapInArrow(compare, "u long, v long")


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, root): of each node that has a link, the smallest of its component. Large-star and small-star steps, each cut."""
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), spark)
    told = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, spark)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = cut(small, spark)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == told:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        told = now


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs.

    Null texts count as empty; texts without a word have fingerprint 0 and are linked like any other. A row whose doc_id is
    null gets a fingerprint, and the component of the other rows with it or else null; it links no others. Repeated rows
    give repeated rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    prints = cut(with_fingerprints(docs, size), spark)
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(classes, spark, radius, tile), spark)
    labels = classes.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct word shingles of each text, ascending; each text's first one)."""
    hashes, shingles = shingled(texts, size)
    owner = np.repeat(np.arange(len(shingles)), shingles)
    hashes = hashes[np.lexsort((hashes, owner))]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(shingles) + 1))


def wide_fingerprints(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints of WIDE words of 64 bits for sets of hashes; each word's bits are of another mixture of the hash."""
    out = np.zeros((len(at) - 1, WIDE), np.uint64)
    with np.errstate(over="ignore"):
        for w in range(WIDE):
            x = (hashes + np.uint64(w)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, w] = majority(x ^ (x >> np.uint64(32)), np.diff(at))
    return out


def with_wide_fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, n, fp): a number for each set of shingles, its size, and its wide fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            hashes, at = shingle_sets(part.column("text"), size)
            keys = xxh64(hashes.view(np.uint8), at[:-1] * 8, np.diff(at) * 8).view(np.int64)
            prints = pa.FixedSizeListArray.from_arrays(pa.array(wide_fingerprints(hashes, at).ravel().view(np.int64)), WIDE).cast(pa.list_(pa.int64()))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "key": pa.array(keys), "n": pa.array(np.diff(at)), "fp": prints})

    return docs.mapInArrow(run, "doc_id long, key long, n long, fp array<long>")


def level_of(n):
    """The level of a set's size: sizes of one level differ by a fiftieth at most, or not at all."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / math.log(1.02) + 1e-9).cast("int")


def level_tiles(counts: dict[int, int], tile: int) -> dict[int, tuple[int, int]]:
    """For each level its first tile and its number of tiles. Small levels that follow each other share one."""
    out, number, room = {}, -1, 0
    for level in sorted(counts):
        if counts[level] > room:
            parts = -(-counts[level] // tile)
            out[level] = number + 1, parts
            number, room = number + parts, tile - counts[level] if parts == 1 else 0
        else:
            out[level] = number, 1
            room -= counts[level]
    return out


def candidates(classes: DataFrame, share: tuple[int, int], tile: int) -> DataFrame:
    """(u, v): links between representatives of sets (rep, n, fp) whose fingerprints are near enough for the similarity; the
    components of all such links. Tiles whose sizes cannot be similar are not compared."""
    spark = classes.sparkSession
    num, den = share
    rows = classes.filter("n > 0").withColumn("level", level_of(F.col("n")))
    spans = {r["level"]: (r["count"], r["least"], r["most"]) for r in rows.groupBy("level").agg(F.count("*").alias("count"), F.min("n").alias("least"), F.max("n").alias("most")).collect()}  # a few hundred levels
    dealt = level_tiles({k: v[0] for k, v in spans.items()}, tile)
    ends: dict[int, tuple[int, int]] = {}
    for level, (first, parts) in dealt.items():
        for t in range(first, first + parts):
            least, most = ends.get(t, (1 << 62, 0))
            ends[t] = min(least, spans[level][1]), max(most, spans[level][2])
    bounds = np.array([ends[t] for t in range(len(ends))], np.int64).reshape(-1, 2)
    told = spark.sparkContext.broadcast(bounds)  # sixteen bytes a tile

    levels = F.broadcast(spark.createDataFrame([(k, first, parts) for k, (first, parts) in dealt.items()], "level int, first int, parts int"))
    tiles = rows.join(levels, "level").withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts"))).cast("long"))
    packed = tiles.groupBy("tile").agg(F.collect_list(F.struct("rep", "n", "fp")).alias("m")).select("tile", F.col("m.rep").alias("rep"), F.col("m.n").alias("n"), F.flatten(F.col("m.fp")).alias("fp"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every tile once to each pair of tiles that it is in."""
        least, most = told.value.T
        for batch in batches:
            for i, t in enumerate(batch.column("tile").to_pylist()):
                others = np.flatnonzero((most * den >= least[t] * num) & (most[t] * den >= least * num))
                for lo in range(0, len(others), 8):
                    o = others[lo : lo + 8]
                    row = pa.array(np.full(len(o), i))
                    yield pa.record_batch({"lo": pa.array(np.minimum(o, t)), "hi": pa.array(np.maximum(o, t)), **{k: batch.column(k).take(row) for k in ("rep", "n", "fp")}})
        give_back()

    schema = "lo long, hi long, rep array<long>, n array<long>, fp array<long>"
    pairs = packed.mapInArrow(deal, schema).groupBy("lo", "hi").agg(F.collect_list(F.struct("rep", "n", "fp")).alias("t")).select(F.col("t.rep").alias("rep"), F.col("t.n").alias("n"), F.col("t.fp").alias("fp"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rep, n, fp = ([x.values.to_numpy() for x in batch.column(k)[i]] for k in ("rep", "n", "fp"))
                fp = [np.ascontiguousarray(x.view(np.uint64).reshape(-1, WIDE).T) for x in fp]
                u, v = near(rep[0], n[0], fp[0], rep[-1], n[-1], fp[-1], share)
                if len(u):
                    u, v = forest(u, v)
                    yield pa.record_batch({"u": pa.array(u), "v": pa.array(v)})
        give_back()

    return pairs.mapInArrow(compare, "u long, v long")


def near(ra, na, a, rb, nb, b, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different members of two tiles whose fingerprints differ by FIRST bits at most in the first word, and by RADIUS
    in all, and whose sizes allow the similarity."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(ra), 16):
        i, j = np.nonzero(np.bitwise_count(a[0, lo : lo + 16, None] ^ b[0][None, :]) <= FIRST)
        i += lo
        on = (na[i] * share[1] >= nb[j] * share[0]) & (nb[j] * share[1] >= na[i] * share[0]) & (ra[i] != rb[j])
        i, j = i[on], j[on]
        far = sum(np.bitwise_count(a[w][i] ^ b[w][j]).astype(np.int64) for w in range(WIDE))
        us.append(ra[i[far <= RADIUS]])
        vs.append(rb[j[far <= RADIUS]])
    return np.concatenate(us), np.concatenate(vs)


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows with the ids of `ids`, and of few others: no text is moved to tell them. BITS bits are sent."""
    spot = F.pmod(F.xxhash64("doc_id", F.lit("bit")), F.lit(BITS))
    rows = ids.select(spot.alias("spot")).groupBy(F.shiftright("spot", 5).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 31 as int)))").alias("bits")).toArrow()
    mask = np.zeros(BITS >> 5, np.uint32)
    mask[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    told = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("spot").to_numpy()
            on = told.value[at >> 5] >> (at & 31).astype(np.uint32) & 1 > 0
            yield batch.filter(pa.array(on)).select(["doc_id", "text"])
        give_back()

    return docs.withColumn("spot", spot).mapInArrow(run, "doc_id long, text string")


def sent(small: DataFrame) -> DataFrame:
    """A table that is sent to all tasks if it has SENT rows at most, so that rows of a large group stay where they are."""
    return F.broadcast(small) if small.count() <= SENT else small


def leaders(members: DataFrame) -> DataFrame:
    """(root, leader) of members (root, rep, fp): that whose fingerprint is nearest to the bits that most of its group have."""
    bits = members.select("root", F.posexplode("fp").alias("w", "x"))
    counted = bits.groupBy("root", "w").agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("x", i).bitwiseAND(1)).alias(f"b{i}") for i in range(64)))
    word = F.lit(0).cast("long")
    for i in range(64):
        word = word.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    middle = sent(cut(counted.select("root", "w", word.alias("middle")), members.sparkSession))
    far = members.select("root", "rep", F.posexplode("fp").alias("w", "x")).join(middle, ["root", "w"]).groupBy("root", "rep").agg(F.sum(F.bit_count(F.col("x").bitwiseXOR(F.col("middle")))).alias("far"))
    return far.groupBy("root").agg(F.min_by("rep", F.struct("far", "rep")).alias("leader"))


def linked(rows: list[int], sets: list[np.ndarray], asks: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): links of sets that ask to sets that are similar; the components of all such. All intersections of a set with the
    others are counted together."""
    num, den = share
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ids = np.array(rows, np.int64)
    for i in np.flatnonzero(asks):
        lo, hi = np.searchsorted(every, sets[i]), np.searchsorted(every, sets[i], side="right")
        shared = np.bincount(owner[ranges(lo, hi - lo)], minlength=len(sets))
        j = np.flatnonzero(shared * (num + den) >= num * (sizes[i] + sizes))
        j = j[ids[j] != ids[i]]
        us.append(np.full(len(j), ids[i]))
        vs.append(ids[j])
    u, v = np.concatenate(us), np.concatenate(vs)
    return forest(u, v) if len(u) else (u, v)


def similar(members: DataFrame, docs: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """(u, v): links between members (root, rep, fp) of a group that are similar by their whole sets; the components of all such.

    Every member is compared with its group's leader. Those that are not similar to it then meet all members, in tiles. So a
    group of many copies of one text is told by one comparison each, and no group has to fit into one task.
    """
    spark = docs.sparkSession
    num, den = share
    led = sent(cut(leaders(members), spark))
    texts = of_ids(docs, members.select(F.col("rep").alias("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=1 << 20):
            hashes, at = shingle_sets(part.column("text"), size)
            keys = xxh64(hashes.view(np.uint8), at[:-1] * 8, np.diff(at) * 8).view(np.int64)
            yield pa.record_batch({"root": part.column("root"), "rep": part.column("doc_id"), "key": pa.array(keys), "set": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))})
        give_back()

    path = new_path(spark, "shingle-sets")
    texts.join(members.select(F.col("rep").alias("doc_id"), "root"), "doc_id").select("root", "doc_id", "text").mapInArrow(run, "root long, rep long, key long, set array<long>").dropDuplicates(["root", "rep", "key"]).write.parquet(path)
    sets = spark.read.schema("root long, rep long, set array<long>").parquet(path)
    # Large groups are dealt out, with their leader's set to each share of them.
    groups = sets.groupBy("root").agg(F.ceil(F.count("*") / SPREAD).alias("parts"), F.greatest(F.ceil(F.sum(F.size("set")) / TILE_SHINGLES), F.lit(1)).alias("tiles"))
    groups = sent(cut(groups, spark))
    salted = sets.join(groups, "root").withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    first = sets.join(led, "root").filter("rep = leader").join(groups, "root").select("root", "leader", F.col("set").alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = salted.join(first, ["root", "part"]).filter("rep <> leader")
    alike = F.size(F.array_intersect("set", "first")) * (num + den) >= num * (F.size("set") + F.size("first"))
    told = cut(both.select("root", "rep", "leader", alike.alias("alike")), spark)
    links_ = told.filter("alike").select(F.col("leader").alias("u"), F.col("rep").alias("v"))
    rest = cut(told.filter("not alike").select("root", "rep"), spark)
    if rest.isEmpty():
        return links_

    open_ = sets.join(rest.select("root").distinct(), "root").join(groups, "root")
    pack = F.collect_list(F.struct("rep", "set")).alias("m")
    there = open_.groupBy("root", F.pmod(F.xxhash64("rep", F.lit(2)), "tiles").alias("tile")).agg(pack).select("root", F.col("m").alias("all"))
    asked = open_.join(rest, ["root", "rep"]).groupBy("root", F.pmod(F.xxhash64("rep", F.lit(3)), "tiles").alias("tile")).agg(pack).select("root", F.col("m").alias("asks"))
    pairs = asked.join(there, "root").select(*(F.col(f"{side}.{k}").alias(f"{side}_{k}") for side in ("asks", "all") for k in ("rep", "set")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = [batch.column(f"{side}_rep")[i].as_py() for side in ("asks", "all")]
                sets_ = [x.values.to_numpy() for side in ("asks", "all") for x in batch.column(f"{side}_set")[i]]
                u, v = linked(rows[0] + rows[1], sets_, np.arange(len(sets_)) < len(rows[0]), share)
                if len(u):
                    yield pa.record_batch({"u": pa.array(u), "v": pa.array(v)})
        give_back()

    return links_.unionByName(pairs.mapInArrow(compare, "u long, v long"))


def similar_texts(docs: DataFrame, size: int = 5, share: tuple[int, int] = (4, 5), tile: int = WIDE_TILE) -> DataFrame:
    """(doc_id, component_id) of every row with an id: components of pairs whose sets of word shingles have a Jaccard similarity
    of share or more.

    Wide fingerprints of the sets are compared in tiles, tiles of sizes that cannot be similar being skipped; what they link
    is checked by the whole sets. Equal sets count once. Null texts count as empty; texts without a word are alike. Repeated
    rows give repeated rows, and their component is that of all texts with their id. Other columns are ignored; an empty table
    gives none.
    """
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    path = new_path(spark, "wide-fingerprints")
    with_wide_fingerprints(docs, size).write.parquet(path)
    sets = spark.read.schema("doc_id long, key long, n long, fp array<long>").parquet(path)
    classes = cut(sets.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp")), spark)
    roots = components(candidates(classes, share, tile), spark)
    roots = cut(roots.select(F.col("root"), F.col("node").alias("rep")).union(roots.select("root", F.col("root").alias("rep")).distinct()), spark)
    members = classes.join(roots, "rep").groupBy("root", "rep").agg(F.first("fp").alias("fp"))
    edges = similar(cut(members, spark), docs, size, share)
    found = components(edges, spark)
    labels = classes.join(found, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("root", "rep").alias("component_id"))
    return sets.select("doc_id", "key").join(labels, "key").select("doc_id", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinseek.llm.shared import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
