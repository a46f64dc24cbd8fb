"""A hashed maximum-entropy language model with a class-factored softmax.

A word's chance is that of its class, given hashed features of the words before it (the last one, the last two, and two
skips), times that of the word in its class, given hashed features of the class with the last word and with the one before
(a skip). The commonest words are classes by themselves. A class of alike words has an output for each word if it has enough,
else for each of its OWN commonest words and some for groups of the rest, by their endings. Below such a group a tree goes down
to the words: a step's chance is a softmax too, given hashed features of the node with the last word and with the one before.
So every word of the dictionary has outputs of its own; among words beyond it counts tell a word's part. The counts of all
training words come from the whole corpus.

The weights are trained by distributed gradient updates: in each round every task starts from the same weights, takes
gradient steps over its own documents, and the tasks' changes are averaged by their numbers of words. Rounds share the
training documents out, so each is used once. Texts are split and coded once, to a table of ids from which everything after
the counts is made, and scored in numpy batches.

The commonest words, DICTIONARY at most, are known to all tasks; other words' counts are joined to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.llm.columns import Known, chunks, coded, give_back, held_out, ranges, spaces, text_bytes, words
from twinseek.llm.shared import new_path, table

#: Words that all tasks know, at most, and the longest of them in bytes; so 16 MB at most.
DICTIONARY, LONGEST = 1 << 18, 64
#: Classes of one word each, of alike dictionary words, and of other words; hashed rows of weights; features of a class, and of a
#: word in its class.
SINGLE, ALIKE, ROWS, FEATURES, INNER = 24, 16, 1 << 13, 4, 2
CLASSES = SINGLE + 2 * ALIKE
#: Outputs of a class of alike words, and those that stand for a word of its own.
OUTPUTS, OWN = 64, 48
#: Branches of a node below a group, of which the first half are words as long as there are more; hashed rows of weights of all nodes.
FAN, TREE_ROWS = 16, 1 << 14
#: Commonest words that classes of alike words are made from, and commonest words beside them that count. Other words go by their endings.
FITTED, CONTEXT = 1 << 14, 48
ROUNDS, BATCH, RATE = 2, 1 << 14, 0.2
#: Words whose classes are looked at together, so that they stay in the cache.
LOOK = 1024
#: The end of a text as a word: no word holds a blank.
END = b" "
#: Weights that travel together, and tasks whose changes are added up first.
BLOCK, GROUP = 1 << 14, 64
#: Ids of texts that are looked at together.
TOKENS = 1 << 18


def doc_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word, each text's first word); lower-cased A-Z."""
    data, at, doc = words(*text_bytes(texts), spaces())
    distinct, codes = coded(data, at)
    return distinct, codes, doc


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all documents, with the end of each text as a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, ends = Known(600_000), np.zeros(0, np.int64), 0

        def told() -> pa.RecordBatch:
            return pa.record_batch({"word": known.words.cast(pa.binary()), "n": pa.array(counts[: len(known.words)])})

        for part in chunks(batches):
            ends += part.num_rows
            if len(known.words) > known.most:
                yield told()
                known, counts = Known(known.most), np.zeros(0, np.int64)
            distinct, codes, _ = doc_words(part.column("text"))
            rows, _ = known.look_up(distinct, lambda new: [pa.array(np.zeros(len(new), np.int8))])
            counts = np.concatenate([counts, np.zeros(len(known.words) - len(counts), np.int64)])
            counts[rows] += np.bincount(codes, minlength=len(distinct))
        if len(known.words):
            yield told()
        if ends:
            yield pa.record_batch({"word": pa.array([END], pa.binary()), "n": pa.array([ends])})

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """words (the dictionary, END first), counts, cls: each word's class; ending: class of other words by their last bytes;
    out: the output of its class that stands for a word; branch[path[i] : path[i + 1]]: the steps of id i below its output, each a
    node's number times FAN and the branch taken; node_bias: log of the branches' parts of a node's count.

    Tasks get a model's values, from which of() makes it again: they need not be able to import this class.
    """

    @classmethod
    def of(cls, values: dict) -> Model:
        model = cls.__new__(cls)
        model.__dict__ = values
        return model

    def other_class(self, distinct: pa.Array) -> np.ndarray:
        data, at = text_bytes(distinct)
        return self.ending[endings(data, at)]

    def codes(self, distinct: pa.Array) -> np.ndarray:
        """Ids of words: the place in the dictionary, or for another word a number beyond it, by its class."""
        at = pc.index_in(distinct, value_set=self.words)
        ids = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        return np.where(ids >= 0, ids, len(self.words) + self.other_class(distinct))

    def classes(self) -> np.ndarray:
        """The class of each id."""
        return np.append(self.cls, SINGLE + ALIKE + np.arange(ALIKE))

    def features(self, own: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """(class of each word, rows of its class's features, rows of the features of the word in its class, the words before) of ids in texts."""
        kind = self.kinds[own]
        none = len(self.words) + ALIKE + 1
        before = []
        for k in (1, 2, 3):
            b = np.empty(len(own), np.int64)
            b[k:] = own[:-k]
            first = doc[:-1] + k - 1  # the k-th word of a text has k - 1 before it
            b[first[first < doc[1:]]] = none
            if k > 1:
                b[before[-1] == none] = none
            before.append(b)
        mix, turn = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - ROWS.bit_length() + 1)
        with np.errstate(over="ignore"):
            keys = [before[0] * 8 + 1, (before[0] * 1_000_003 + before[1]) * 8 + 2, before[1] * 8 + 3, before[2] * 8 + 4]
            rows = [((k.astype(np.uint64) * mix) >> turn).astype(np.int32) for k in keys]
            inner = [((((before[k] * CLASSES + kind) * 8 + 5 + k).astype(np.uint64) * mix) >> turn).astype(np.int32) for k in range(INNER)]
        return kind, rows, inner, before[:INNER]

    def steps_below(self, own: np.ndarray, before: list[np.ndarray], most: int) -> Iterator[tuple]:
        """(place of the word, rows of the step's features, node, branch) of all steps below outputs, by `most` words that have any."""
        at, turn = np.flatnonzero(self.path[own + 1] > self.path[own]), np.uint64(64 - TREE_ROWS.bit_length() + 1)
        for lo in range(0, len(at), most):
            some = at[lo : lo + most]
            begin, n = self.path[own[some]], self.path[own[some] + 1] - self.path[own[some]]
            place, step = np.repeat(some, n), self.branch[ranges(begin, n)]
            node = step // FAN
            with np.errstate(over="ignore"):
                rows = [((((b[place] * 1_000_003 + node) * 8 + 5 + k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> turn).astype(np.int32) for k, b in enumerate(before)]
            yield place, rows, node, step % FAN


def endings(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number below 4096 by a word's last three bytes."""
    n = np.diff(at)
    out = np.zeros(len(n), np.int64)
    for k in (1, 2, 3):
        out = out * 31 + np.where(n >= k, np.append(data, 0)[np.maximum(at[1:] - k, 0)], 0)
    return out % 4096


def raised(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials of z, or of z less each row's largest, their sums). Without need the largest is not looked for: it costs most."""
    one = np.ones(z.shape[1], z.dtype)
    if z.max() < 60:
        out = np.exp(z)
        total = out @ one
        if total.min() > 1e-20:
            return out, total
    z -= z.max(1, keepdims=True)
    out = np.exp(z)
    return out, out @ one


def logits(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray | None = None, kind: np.ndarray | None = None) -> np.ndarray:
    """Sums of the rows of the features and of the bias: the kind's row of bias, or without it the last row of the weights."""
    z = np.take(weights, rows[0], axis=0, mode="clip")
    more = np.empty_like(z)
    for r in rows[1:]:
        z += np.take(weights, r, axis=0, out=more, mode="clip")
    z += weights[-1] if bias is None else np.take(bias, kind, axis=0, out=more, mode="clip")
    return z


def summed(rows: np.ndarray, g: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums of g over each): rows[i] gets g[i % len(g)]; rows are below most, and some whole times as many as g.

    The first of each row are taken together, then the second, and so on, the most frequent rows first; the last few rows by themselves.
    """
    order = np.argsort(rows.astype(np.uint16) if most <= 1 << 16 else rows, kind="stable")
    ranked, source = rows[order], np.tile(np.arange(len(g)), len(rows) // len(g))[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    n = np.diff(np.append(first, len(rows)))
    by = np.argsort(-n, kind="stable")
    first, n = first[by], n[by]
    total, k = np.take(g, source[first], axis=0), 1
    for left in np.cumsum(np.bincount(n)[::-1])[::-1][2:].tolist():  # rows that occur more than k times
        if left <= 64:
            break
        total[:left] += np.take(g, source[first[:left] + k], axis=0)
        k += 1
    for i in np.flatnonzero(n[:64] > k):
        total[i] += np.take(g, source[first[i] + k : first[i] + n[i]], axis=0).sum(0)
    return ranked[first], total


def steps(weights: np.ndarray, squares: np.ndarray, rows: list[np.ndarray], target: np.ndarray, kind: np.ndarray | None = None, allowed: np.ndarray | None = None, bias: np.ndarray | None = None) -> None:
    """One gradient step (Adagrad) on a batch of words. The last row of the weights is the bias; with kind and allowed the last
    rows are, one for each kind, and outputs that a kind does not have are not allowed. With kind and bias the kinds' biases
    are given and stay. Rows of no word have no gradient and stay as they are.
    """
    g = np.empty((len(target), weights.shape[1]), weights.dtype)
    free = len(weights) - (len(allowed) if allowed is not None else 1 if bias is None else 0)
    own_bias = weights[free:] + allowed if allowed is not None else bias
    for lo in range(0, len(target), LOOK):
        z = logits(weights, [r[lo : lo + LOOK] for r in rows], own_bias, None if kind is None else kind[lo : lo + LOOK])
        chance, total = raised(z)
        np.multiply(chance, (1 / total)[:, None], out=g[lo : lo + LOOK])
    g[np.arange(len(g)), target] -= 1
    grad = np.zeros_like(weights)
    at, total = summed(np.concatenate(rows + ([kind + free] if allowed is not None else [])), g, len(weights))
    grad[at] = total
    if kind is None:
        grad[free] = g.sum(0)
    square = grad * grad
    squares += square
    grad *= RATE
    grad /= np.sqrt(squares, out=square)
    weights -= grad


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, each text's first id) of coded texts, some TOKENS ids together or one text."""
    for batch in batches:
        data, at = text_bytes(batch.column("ids"))
        ids, at, lo = data.view("<i4"), at // 4, 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + TOKENS, side="right")) - 1)
            yield batch.slice(lo, hi - lo), ids[at[lo] : at[hi]].astype(np.int64), at[lo : hi + 1] - at[lo]
            lo = hi


def code(docs: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, trains, ids, other) of docs (doc_id, text, trains), written and read again: the ids of a text's words with
    END, four bytes each, and its words beyond the dictionary, each with its number. Texts are split into words here for the last time."""
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(vars(model).copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(told.value)
        for part in chunks(batches):
            distinct, codes, doc = doc_words(part.column("text"))
            ids = model.codes(distinct)
            own = np.insert(ids[codes], doc[1:], 0).astype("<i4")
            places = 4 * (doc + np.arange(len(doc)))
            where = np.flatnonzero(np.append(ids, 0)[codes] >= len(model.words))
            owner = np.repeat(np.arange(part.num_rows), np.diff(doc))[where]
            both, tf = np.unique(owner * max(1, len(distinct)) + codes[where], return_counts=True)
            owner, word = both // max(1, len(distinct)), both % max(1, len(distinct))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)), pa.StructArray.from_arrays([distinct.take(pa.array(word)).cast(pa.binary()), pa.array(tf.astype(np.int32))], ["word", "tf"]))
            yield pa.record_batch({k: part.column(k) for k in ("row", "doc_id", "trains")} | {"ids": pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(places.astype("<i8")), pa.py_buffer(own)]).cast(pa.binary()), "other": lists})
        give_back()

    path = new_path(spark, "coded-texts")
    schema = "row long, doc_id long, trains boolean, ids binary, other array<struct<word: binary, tf: int>>"
    docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "trains", "text").select("row", "doc_id", "trains", "text").mapInArrow(run, schema).write.parquet(path)
    told.destroy()
    return spark.read.schema(schema).parquet(path)


def beside(coded_: DataFrame, model: Model) -> np.ndarray:
    """How often each of the FITTED commonest words stands one or two places from each of the CONTEXT commonest, over all texts.

    Tasks send sums of FITTED x CONTEXT numbers at most, and so many rows reach the driver at most.
    """
    n, most = min(len(model.words), FITTED), min(len(model.words) - 1, CONTEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n * CONTEXT, np.int64)
        for part, own, doc in texts_of(batches):
            owner = np.repeat(np.arange(part.num_rows), np.diff(doc))
            near = np.flatnonzero((own > 0) & (own <= most))
            cells = []
            for k in (-2, -1, 1, 2):
                at = near[(near + k >= 0) & (near + k < len(own))]
                at = at[owner[at + k] == owner[at]]
                at = at[own[at + k] < n]
                cells.append(own[at + k] * CONTEXT + own[at] - 1)
            seen += np.bincount(np.concatenate(cells), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.record_batch({"cell": pa.array(at), "n": pa.array(seen[at])})

    sums = coded_.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((len(model.words), CONTEXT), np.float64)
    seen.reshape(-1)[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return seen


def make_classes(model: Model, seen: np.ndarray) -> None:
    """Classes of alike dictionary words: k-means on the commonest words beside them."""
    n = len(model.words)
    model.cls = np.zeros(n, np.int64)
    model.cls[: min(n, SINGLE)] = np.arange(min(n, SINGLE))
    total = seen.sum(1)
    vectors = np.sqrt(seen / np.maximum(total, 1)[:, None])
    on = np.flatnonzero((total >= 4) & (np.arange(n) >= SINGLE))
    cluster = np.full(n, -1)
    if len(on) >= ALIKE:
        v = vectors[on]
        centres = [v[np.argmax(total[on])]]
        for _ in range(ALIKE - 1):
            centres.append(v[np.argmin(np.max(v @ np.array(centres).T, axis=1) - (total[on] > np.median(total[on])))])
        centres = np.array(centres)
        for _ in range(10):
            own = (v @ centres.T).argmax(1)
            for c in range(ALIKE):
                if (own == c).any():
                    m = (v[own == c] * np.log1p(total[on][own == c])[:, None]).sum(0)
                    centres[c] = m / max(float(np.linalg.norm(m)), 1e-9)
        cluster[on] = own
    data, at = text_bytes(model.words)
    last = endings(data, at)
    votes = np.zeros((4096, ALIKE))
    np.add.at(votes, (last[on], np.maximum(cluster[on], 0)), np.log1p(total[on]))
    common = votes.sum(0).argmax()
    model.ending = np.where(votes.max(1) > 0, votes.argmax(1), common)
    rest = np.arange(n) >= SINGLE
    model.cls[rest] = SINGLE + np.where(cluster[rest] >= 0, cluster[rest], model.ending[last[rest]])


def even_out(model: Model) -> None:
    """As long as the classes' outputs suffice for the whole dictionary, words that find none in their class go where there is room."""
    n = np.bincount(model.cls, minlength=SINGLE + ALIKE)[SINGLE:]
    if n.sum() <= ALIKE * OUTPUTS:
        over = np.concatenate([np.flatnonzero(model.cls == SINGLE + a)[OUTPUTS:] for a in range(ALIKE)])
        room = np.repeat(np.arange(ALIKE), np.maximum(OUTPUTS - n, 0))
        model.cls[over] = SINGLE + room[: len(over)]


def make_outputs(model: Model) -> None:
    """The outputs of classes of alike words: one for each word, or if there are too many the OWN commonest one each and the others in
    groups by their endings, with a tree down to the words below each."""
    even_out(model)
    n = len(model.words)
    data, at = text_bytes(model.words)
    group = endings(data, at) % (OUTPUTS - OWN)
    model.out, below = np.zeros(n, np.int64), np.full(n, -1)
    model.allowed = np.full((ALIKE, OUTPUTS), -np.inf, np.float32)
    model.out_n = np.zeros((ALIKE, OUTPUTS))
    for a in range(ALIKE):
        own = np.flatnonzero(model.cls == SINGLE + a)  # the commonest first
        rank = np.arange(len(own))
        out = np.where((rank < OWN) | (len(own) <= OUTPUTS), rank, OWN + group[own])
        total = np.bincount(out, weights=model.counts[own], minlength=OUTPUTS)
        model.out[own], model.out_n[a] = out, total
        model.allowed[a][total > 0] = 0
        if len(own) > OUTPUTS:
            below[own[OWN:]] = a * OUTPUTS + out[OWN:]
    make_tree(model, below)
    model.kinds = model.classes()


def make_tree(model: Model, below: np.ndarray) -> None:
    """Trees down to the words below each group: below is a word's group, or less than 0 without one.

    Up to FAN words are the branches of a node. Of more words the FAN / 2 commonest are, and the others share the other branches
    evenly in the order of their spelling from the end, each a node again.
    """
    n, half = len(model.words), FAN // 2
    spelling = np.empty(n, np.int64)
    spelling[pc.array_sort_indices(pc.binary_reverse(model.words)).to_numpy()] = np.arange(n)
    word = np.flatnonzero(below >= 0)
    group, nodes, found = below[word], 0, []
    while len(word):
        _, node, size = np.unique(group, return_inverse=True, return_counts=True)
        word, node = word[size[node] > 1], node[size[node] > 1]  # a word alone has no step to take
        _, node, size = np.unique(node, return_inverse=True, return_counts=True)
        begin = np.cumsum(size) - size
        order = np.lexsort((word, node))  # the commonest first
        word, node = word[order], node[order]
        rank, size = np.arange(len(word)) - begin[node], size[node]
        more = np.flatnonzero((size > FAN) & (rank >= half))
        by = more[np.lexsort((spelling[word[more]], node[more]))]
        place = np.arange(len(word)) - begin[node] - half  # `by` fills the places of `more`, which are a node's last
        rank[by] = half + place[more] * half // (size[more] - half)
        found.append((word, (nodes + node) * FAN + rank))
        word, group, nodes = word[more], node[more] * FAN + rank[more], nodes + len(begin)
    word, branch = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(word, kind="stable")
    model.path, model.branch = np.append(0, np.cumsum(np.bincount(word, minlength=n + ALIKE))), branch[order].astype(np.int32)
    count = np.bincount(branch, weights=model.counts[word], minlength=nodes * FAN).reshape(nodes, FAN)
    with np.errstate(divide="ignore"):
        model.node_bias = (np.log(count) - np.log(count.sum(1, keepdims=True))).astype(np.float32)


def train(docs: DataFrame, train_where, rounds: int = ROUNDS) -> tuple[Model, DataFrame, DataFrame]:
    """(model, counts, coded texts of all rows), learned from the rows where train_where holds."""
    spark = docs.sparkSession
    every = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(train_where, F.lit(False)).alias("trains"))
    path = new_path(spark, "word-counts")
    word_counts(every.filter("trains")).write.parquet(path)
    counts = spark.read.schema("word binary, n long").parquet(path)
    model = Model()
    model.total, model.distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())

    # The least count of which no more than DICTIONARY words have it or a greater one, by a histogram of bounded size.
    able = counts.filter((F.octet_length("word") <= LONGEST) & (F.col("word") != F.lit(END)))
    level = F.floor(F.log2("n") * 64)
    least, left = None, DICTIONARY
    for r in able.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if r["count"] > left:
            break
        left, least = left - r["count"], r["level"]
    known = able.filter(level >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")]) if least is not None else None
    own = known.column("word").combine_chunks().cast(pa.large_binary()) if known is not None else pa.array([], pa.large_binary())
    ends = counts.filter(F.col("word") == F.lit(END)).first()
    model.words = pa.concat_arrays([pa.array([END], pa.large_binary()), own.chunk(0) if isinstance(own, pa.ChunkedArray) else own])
    model.counts = np.append(ends["n"] if ends else 0, known.column("n").to_numpy() if known is not None else []).astype(np.int64)

    # Other words' classes are told by their endings; the texts are coded with places for them, which become classes below.
    model.cls, model.ending = np.zeros(len(model.words), np.int64), np.arange(4096) % ALIKE
    coded_ = code(every, model)
    make_classes(model, beside(coded_.filter("trains"), model))
    model.ending = np.arange(4096) % ALIKE
    make_outputs(model)

    def by_ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(ALIKE), np.zeros(ALIKE)
        for batch in batches:
            kind = ending[endings(*text_bytes(batch.column("word")))]
            n += np.bincount(kind, weights=batch.column("n").to_numpy(), minlength=ALIKE)
            v += np.bincount(kind, minlength=ALIKE)
        yield pa.record_batch({"kind": pa.array(np.arange(ALIKE)), "n": pa.array(n), "v": pa.array(v)})

    # Of all words by their endings, those that are not in the dictionary.
    ending, own = model.ending, np.flatnonzero(model.counts)
    model.class_n, model.class_v = (np.bincount(model.cls[own], weights=w, minlength=CLASSES) for w in (model.counts[own], np.ones(len(own))))
    for r in counts.mapInArrow(by_ending, "kind long, n double, v double").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        known = own[model.other_class(model.words.take(pa.array(own))) == r["kind"]]
        at = SINGLE + ALIKE + r["kind"]
        model.class_n[at], model.class_v[at] = r["n"] - model.counts[known].sum(), r["v"] - len(known)
    told = spark.sparkContext.broadcast(vars(model).copy())
    outer, inner = np.zeros((ROWS + 1, CLASSES), np.float32), np.zeros((ROWS + ALIKE, OUTPUTS), np.float32)
    outer[-1] = np.log(model.class_n + 1) - np.log(model.class_n.sum() + CLASSES)
    inner[ROWS:] = np.log(np.maximum(model.out_n, 1)) - np.log(np.maximum(model.out_n.sum(1, keepdims=True), 1))
    below = np.zeros((TREE_ROWS if len(model.branch) else 0, FAN), np.float32)
    weights, shapes = np.concatenate([outer.ravel(), inner.ravel(), below.ravel()]), (outer.shape, inner.shape, below.shape)

    for turn in range(rounds if len(model.words) > 1 else 0):
        now = spark.sparkContext.broadcast(weights)

        def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            model, base = Model.of(told.value), now.value
            weights, squares, n = base.copy(), np.full_like(base, 1.0), 0
            (outer, inner, below), (outer_squares, inner_squares, below_squares) = parted(weights, shapes), parted(squares, shapes)
            for _, own, doc in texts_of(batches):
                kind, rows, within, before = model.features(own, doc)
                for lo in range(0, len(own), BATCH):
                    steps(outer, outer_squares, [r[lo : lo + BATCH] for r in rows], kind[lo : lo + BATCH])
                at = np.flatnonzero((kind >= SINGLE) & (kind < SINGLE + ALIKE))
                for lo in range(0, len(at), BATCH):
                    some = at[lo : lo + BATCH]
                    steps(inner, inner_squares, [r[some] for r in within], model.out[own[some]], kind[some] - SINGLE, model.allowed)
                for _, under, node, branch in model.steps_below(own, before, BATCH // 4):
                    steps(below, below_squares, under, branch, node, bias=model.node_bias)
                n += len(own)
            if n:
                change, task = (weights - base) * np.float32(n), TaskContext.get().partitionId()
                blocks = [change[i : i + BLOCK].tobytes() for i in range(0, len(change), BLOCK)]
                yield pa.record_batch({"block": pa.array(np.arange(len(blocks))), "part": pa.array(np.full(len(blocks), task // GROUP)), "n": pa.array(np.full(len(blocks), n)), "change": pa.array(blocks, pa.binary())})
            give_back()

        def added(table_: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table_.column("change").to_pylist())
            return pa.table({"block": table_.column("block")[:1], "part": pa.array([0], pa.int64()), "n": pa.array([pc.sum(table_.column("n")).as_py()]), "change": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        schema = "block long, part long, n long, change binary"
        some = coded_.filter(F.col("trains") & (F.pmod(F.xxhash64("doc_id", F.lit("round")), rounds) == turn)).select("ids")
        for r in some.mapInArrow(shard, schema).groupBy("block", "part").applyInArrow(added, schema).groupBy("block").applyInArrow(added, schema).collect():
            at = r["block"] * BLOCK
            change = np.frombuffer(r["change"], np.float32)
            weights[at : at + len(change)] += change / r["n"]
        now.destroy()
    told.destroy()  # executors keep it as a file each
    model.outer, model.inner, model.below = parted(weights, shapes)
    return model, counts, coded_


def parted(flat: np.ndarray, shapes: tuple) -> list[np.ndarray]:
    """Views of a flat array as matrices."""
    ends = np.cumsum([a * b for a, b in shapes])
    return [flat[end - a * b : end].reshape(a, b) for end, (a, b) in zip(ends, shapes)]


def log_chances(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log10 of the softmax at the targets. raised() takes from z what it takes off."""
    _, total = raised(z)
    return (z[np.arange(len(z)), target] - np.log(total)) / np.log(10)


def chances(model: Model, own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """log10 of each word's chance. Of a word beyond the dictionary it lacks log10(its count + 1)."""
    kind, rows, within, before = model.features(own, doc)
    out = np.empty(len(own))
    for lo in range(0, len(own), LOOK):
        out[lo : lo + LOOK] = log_chances(logits(model.outer, [r[lo : lo + LOOK] for r in rows]), kind[lo : lo + LOOK])
    at, bias = np.flatnonzero((kind >= SINGLE) & (kind < SINGLE + ALIKE)), model.inner[ROWS:] + model.allowed
    for lo in range(0, len(at), LOOK):
        some = at[lo : lo + LOOK]
        out[some] += log_chances(logits(model.inner, [r[some] for r in within], bias, kind[some] - SINGLE), model.out[own[some]])
    for place, under, node, branch in model.steps_below(own, before, LOOK):
        first = np.flatnonzero(np.diff(place, prepend=-1))
        out[place[first]] += np.add.reduceat(log_chances(logits(model.below, under, model.node_bias, node), branch), first)
    at = np.flatnonzero(kind >= SINGLE + ALIKE)
    out[at] -= np.log10(model.class_n + model.class_v + 1)[kind[at]]
    return out


def score(model: Model, counts: DataFrame, coded_: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every coded text; log10.

    Without training words all counts are 0. Repeated rows are scored each.
    """
    told = coded_.sparkSession.sparkContext.broadcast(vars(model).copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(told.value)
        size = len(model.words)
        base = np.append(np.log10(model.counts + 1), np.zeros(ALIKE))
        seen = np.append(model.counts > 0, np.zeros(ALIKE, bool)).astype(np.int64)
        for part, own, doc in texts_of(batches):
            sums = [np.add.reduceat(x, doc[:-1]) for x in (chances(model, own, doc), base[own], seen[own])]
            yield pa.record_batch({"row": part.column("row"), "doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(doc)), "score": pa.array(sums[0]), "base": pa.array(sums[1]), "known": pa.array(sums[2])})
        give_back()

    found = coded_.select("row", "doc_id", "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, score double, base double, known long")
    more = coded_.select("row", F.explode("other").alias("x")).select("row", "x.word", "x.tf").join(counts, "word")
    more = more.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("more"), F.sum("tf").alias("more_known"))
    rest = float(np.log10(model.total + model.distinct + 1))
    extra = F.coalesce("more", F.lit(0.0))
    return found.join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * rest).alias("base_score"), (F.col("score") + extra).alias("score"),
    )


def scored(docs: DataFrame, train_where) -> DataFrame:
    """score() of every row of docs by what train() learns from the rows where train_where holds.

    Null texts count as empty: the end of the text alone. Rows with a null or repeated id are rows like others; other columns
    are ignored; an empty table gives none. Tasks take their gradient steps alone between two averages, so weights depend in
    some measure on how texts are dealt to tasks.
    """
    return score(*train(docs, train_where))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), ~held_out(7, 2))
    return found.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
