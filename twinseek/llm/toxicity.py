"""Toxicity by a convolutional text classifier in numpy.

Words, and their first four and six bytes, are hashed to buckets with an embedding each, whose sum is the word's; filters over one, two and three words are pooled by their maximum over
the whole text; a logistic layer gives the score. It is trained in numpy on a bounded sample of labelled rows. Cut-offs are
calibrated by the language that a text's commonest function words tell, on all labelled rows outside the fitted sample, and moved to 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.llm.columns import chunks, held_out, marks, text_bytes, words, xxh64
from twinseek.llm.shared import table

BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
#: Labelled rows that are looked at for fitting, at most: those of least hash. Bytes of their texts together, at most: a row
#: that would exceed them is left out whole, and sets cut-offs like others that are not fitted on.
SAMPLE, SAMPLE_BYTES = 8000, 100_000_000
EPOCHS, BATCH, SEED = 8, 64, 42
#: Steps of a logit that cut-offs are told by, the largest logit, and toxic rows at which a language's own cut-off counts half.
LEVELS, FURTHEST, SHRINK = 64, 64, 40
#: Bytes of a word's beginning that are hashed beside the word, so that unseen forms of a stem are known.
STEMS = (4, 6)
#: Common function words of four languages.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine zu mit den von",
    "en": "the of and to in is that it for was with this",
    "es": "el los las que y en un una por con para del",
    "fr": "le les des et un une que dans pour qui sur du",
}


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each word, each text's first word). Words are runs of letters, digits and non-ASCII characters, A-Z lowered."""
    data, at, doc = words(*text_bytes(texts), marks())
    sizes = np.diff(at)
    hashes = [xxh64(data, at[:-1], sizes), *(xxh64(data, at[:-1], np.minimum(sizes, n), n) for n in STEMS)]
    return np.column_stack([(h & np.uint64(BUCKETS - 1)).astype(np.int32) for h in hashes]), doc


def languages() -> np.ndarray:
    """The number of a bucket's language, where a function word of one language has it: 1, 2, ...; else 0."""
    out = np.zeros(BUCKETS, np.int8)
    all_words = [w for text in FUNCTION_WORDS.values() for w in text.split()]
    for k, text in enumerate(FUNCTION_WORDS.values(), 1):
        own = [w for w in text.split() if all_words.count(w) == 1]
        ids, _ = buckets(pa.array([" ".join(own)]))
        out[ids[:, 0]] = k
    return out


class Model:
    """Tasks get a model's values, from which of() makes it again: they need not be able to import this class."""

    @classmethod
    def of(cls, values: dict | None) -> Model | None:
        if values is None:
            return None
        model = cls.__new__(cls)
        model.__dict__ = values
        return model

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.embedding = np.zeros((BUCKETS, DIMS), np.float32)
        self.filters = {w: rng.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out, self.out_bias = np.full(FILTERS * len(WIDTHS), 0.2, np.float32), np.float32(0)
        self.cuts = np.zeros(len(FUNCTION_WORDS) + 1)
        #: Rows, and toxic rows, of each language that set its cut-off; of no language first.
        self.rows = np.zeros((len(FUNCTION_WORDS) + 1, 2), np.int64)
        for w in WIDTHS:
            self.filters[w][0, 0, :] = np.abs(self.filters[w][0, 0, :]) + 0.5

    def pooled(self, ids: np.ndarray, doc: np.ndarray, where: bool = False):
        """Each text's largest value of each filter, 0 at least; with where, also the word at which it is (-1: none)."""
        n = len(doc) - 1
        values, places = np.zeros((n, FILTERS * len(WIDTHS)), np.float32), np.full((n, FILTERS * len(WIDTHS)), -1, np.int64)
        vectors = sum(self.embedding[ids[:, j]] for j in range(ids.shape[1]))
        sizes = np.diff(doc)
        for k, w in enumerate(WIDTHS):
            full = np.flatnonzero(sizes >= w)
            if not len(full):
                continue
            last = len(ids) - w + 1
            found = sum(vectors[j : last + j] @ self.filters[w][j] for j in range(w)) + self.bias[w]
            at, ends = doc[full], doc[full + 1] - w + 1
            edges = np.minimum(np.ravel(np.column_stack([at, ends])), last)
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            if where:
                for i, a, b in zip(full, at, ends):
                    best = found[a:b].argmax(0)
                    own = found[a + best, np.arange(FILTERS)]
                    values[i, columns] = np.maximum(own, 0)
                    places[i, columns] = np.where(own > 0, a + best, -1)
            else:
                step = np.append(edges, last) if edges[-1] < last else edges
                step = step[:-1] if step[-1] >= last else step
                values[full, columns] = np.maximum(np.maximum.reduceat(found, step, axis=0)[::2][: len(full)], 0)
        return (values, places) if where else values

    def logits(self, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return self.pooled(ids, doc) @ self.out + self.out_bias

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adagrad on the logistic loss. The embeddings' first component begins as the bucket's smoothed log odds."""
        rng = np.random.default_rng(seed)
        seen = np.zeros((2, BUCKETS))
        for ids, label in zip(texts, labels):
            seen[label, np.unique(ids)] += 1
        total = np.maximum(np.array([(labels == 0).sum(), (labels == 1).sum()]), 1)
        odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
        both = seen.sum(0)
        self.embedding[:] = rng.normal(0, 0.02, self.embedding.shape) * (both >= 3)[:, None]
        self.embedding[:, 0] = odds * both / (both + 10)
        self.out_bias = np.float32(-2)
        weight = np.array([1.0, max(1.0, total[0] / total[1] / 3)])
        squares: dict = {}

        def step(name, values, gradient, rate=0.05, rows=None):
            state = squares.setdefault(name, np.full(values.shape, 1e-2, np.float32))
            if rows is None:
                state += gradient**2
                values -= rate * gradient / np.sqrt(state)
            else:
                state[rows] += gradient**2
                values[rows] -= rate * gradient / np.sqrt(state[rows])

        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                own = order[lo : lo + BATCH]
                ids, doc = np.concatenate([texts[i] for i in own]), np.append(0, np.cumsum([len(texts[i]) for i in own]))
                values, places = self.pooled(ids, doc, where=True)
                y = labels[own]
                z = values @ self.out + self.out_bias
                error = ((1 / (1 + np.exp(-z)) - y) * weight[y] / len(own)).astype(np.float32)
                back = error[:, None] * self.out * (places >= 0)
                step("out", self.out, values.T @ error + 1e-4 * self.out)
                bias = np.array([self.out_bias])
                step("bias", bias, np.array([error.sum()]))
                self.out_bias = bias[0]
                for k, w in enumerate(WIDTHS):
                    i, f = np.nonzero(places[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
                    if not len(i):
                        continue
                    at, g = places[i, k * FILTERS + f], back[i, k * FILTERS + f]
                    grad, rows, vectors = np.zeros_like(self.filters[w]), [], []
                    for j in range(w):
                        e = self.embedding[ids[at + j]].sum(1)
                        np.add.at(grad[j].T, f, g[:, None] * e)
                        rows.append(ids[at + j].ravel())
                        vectors.append(np.repeat(g[:, None] * self.filters[w][j][:, f].T, ids.shape[1], axis=0))
                    rows, back_to = np.unique(np.concatenate(rows), return_inverse=True)
                    to = np.zeros((len(rows), DIMS), np.float32)
                    np.add.at(to, back_to, np.concatenate(vectors))
                    to *= (both[rows] >= 3)[:, None]
                    step(("filter", w), self.filters[w], grad)
                    step(("filter bias", w), self.bias[w], np.bincount(f, weights=g, minlength=FILTERS).astype(np.float32))
                    step("embedding", self.embedding, to, 0.02, rows)

    def spoken(self, ids: np.ndarray, doc: np.ndarray, table_: np.ndarray) -> np.ndarray:
        """The number of the language of which a text has most function words; 0 without any."""
        kinds = table_[ids[:, 0]]
        counts = np.zeros((len(doc) - 1, len(FUNCTION_WORDS) + 1))
        owner = np.repeat(np.arange(len(doc) - 1), np.diff(doc))
        np.add.at(counts, (owner[kinds > 0], kinds[kinds > 0]), 1)
        return np.where(counts.max(1) > 0, counts.argmax(1), 0)

    def calibrate(self, spoken: np.ndarray, level: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> None:
        """Each language's cut-off of the best F1, drawn towards that of all languages where few toxic rows are known.

        n rows, of which `toxic` are toxic, have the language and the level (steps of 1 / LEVELS of a logit).
        """

        def best(on: np.ndarray) -> float:
            at, back = np.unique(-level[on], return_inverse=True)
            y, all_ = np.bincount(back, weights=toxic[on]), np.bincount(back, weights=n[on])
            k = int((2 * np.cumsum(y) / (np.cumsum(all_) + max(1, y.sum()))).argmax())
            return float(-(at[k] + at[min(k + 1, len(at) - 1)]) / 2 / LEVELS)

        every = np.ones(len(level), bool)
        pooled = best(every) if toxic.sum() else 0.0
        self.cuts[:] = pooled
        for k in range(len(self.cuts)):
            on = spoken == k
            self.rows[k] = n[on].sum(), toxic[on].sum()
            if k and toxic[on].sum():
                self.cuts[k] = (toxic[on].sum() * best(on) + SHRINK * pooled) / (toxic[on].sum() + SHRINK)

    def score(self, ids: np.ndarray, doc: np.ndarray, table_: np.ndarray) -> np.ndarray:
        z = self.logits(ids, doc) - self.cuts[self.spoken(ids, doc, table_)]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, train_where, sample: int = SAMPLE, epochs: int = EPOCHS, most: int = SAMPLE_BYTES) -> Model | None:
    """A model of labels.toxic where train_where holds, fitted on three quarters of `sample` rows at most; None if there are none.

    Rows whose label or id is null are no examples; of several labels of a document the largest counts. All labelled rows
    that the model is not fitted on set the cut-offs.
    """
    spark = docs.sparkSession
    ids = labels.filter(train_where & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = {r["doc_id"]: r["toxic"] for r in ids.withColumn("key", F.xxhash64("doc_id", F.lit("toxicity"))).orderBy("key", "doc_id").limit(sample).collect()}
    if not chosen:
        return None
    texts_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = F.broadcast(spark.createDataFrame(list(chosen.items()), "doc_id long, toxic int"))
    sizes = {r["doc_id"]: r["size"] for r in texts_of.join(wanted, "doc_id").groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).collect()}
    left, fits = most, []
    for i in (i for i in chosen if i in sizes):  # by hash
        if sizes[i] <= left:
            left -= sizes[i]
            fits.append((i, chosen[i]))
    if not fits:
        return None
    wanted = F.broadcast(spark.createDataFrame(fits, "doc_id long, toxic int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            found, doc = buckets(part.column("text"))
            found = found.astype(np.uint16)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "toxic": part.column("toxic"), "ids": pa.array([found[a:b].tobytes() for a, b in zip(doc[:-1], doc[1:])], pa.binary())})

    rows = texts_of.join(wanted, "doc_id").mapInArrow(run, "doc_id long, toxic int, ids binary").toArrow().to_pylist()
    rows = sorted({r["doc_id"]: r for r in rows}.values(), key=lambda r: r["doc_id"])
    if not rows:
        return None
    texts, y = [np.frombuffer(r["ids"], np.uint16).reshape(-1, 1 + len(STEMS)) for r in rows], np.array([min(1, max(0, r["toxic"])) for r in rows])
    order = np.random.default_rng(SEED).permutation(len(rows))
    cut = len(rows) // 4
    model = Model()
    model.fit([texts[i] for i in order[cut:]], y[order[cut:]], epochs)
    fitted = spark.createDataFrame([(rows[i]["doc_id"],) for i in order[cut:]], "doc_id long")
    told = spark.sparkContext.broadcast(vars(model).copy())

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kinds = Model.of(told.value), languages()
        for part in chunks(batches, most=2 << 20):
            found, doc = buckets(part.column("text"))
            level = np.floor(np.clip(model.logits(found, doc), -FURTHEST, FURTHEST) * LEVELS).astype(np.int64)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "spoken": pa.array(model.spoken(found, doc, kinds).astype(np.int64)), "level": pa.array(level)})

    others = ids.join(F.broadcast(fitted), "doc_id", "left_anti")
    # Every text gets its level, so that levels and not texts travel to the labels. 2 x FURTHEST x LEVELS of each language at most are collected.
    found = texts_of.filter("doc_id is not null").mapInArrow(levels, "doc_id long, spoken long, level long").join(others, "doc_id")
    sums = found.groupBy("spoken", "level").agg(F.count("*").alias("n"), F.sum(F.least(F.greatest("toxic", F.lit(0)), F.lit(1))).alias("toxic")).toArrow()
    model.calibrate(*(sums.column(k).to_numpy() for k in ("spoken", "level", "n", "toxic")))
    return model


def scored(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = (), text_too: bool = False) -> DataFrame:
    """(doc_id, score, predicted) of every row, by its whole text, and the columns to keep; with text_too the text (null: empty).

    Null texts count as empty, which have a score too; without a model every score is 0.
    """
    told = docs.sparkSession.sparkContext.broadcast(None if model is None else vars(model).copy())
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, spoken = Model.of(told.value), languages()
        for part in chunks(batches, most=2 << 20):
            ids, doc = buckets(part.column("text"))
            score = model.score(ids, doc, spoken) if model is not None else np.zeros(part.num_rows)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))} | ({"text": part.column("text").cast(pa.string())} if text_too else {}) | {k: part.column(k) for k in keep})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return rows.mapInArrow(run, "doc_id long, score double, predicted int" + ", text string" * text_too + "".join(f", {k} {kinds[k]}" for k in keep))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return scored(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
