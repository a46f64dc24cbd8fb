"""Language by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary, learned by expectation maximisation. A word's
probability is the sum over all its segmentations into pieces, which a forward pass gives for many words side by side. A
text's language is the one that makes its words likeliest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinseek.llm.columns import LETTER, Known, char_classes, chunks, clean_utf8, code_points, coded, held_out, kept, text_bytes
from twinseek.llm.shared import table

#: The probability of a letter outside the vocabulary.
UNKNOWN = 1e-7
#: Letters of words that are scored side by side, at most: longer words would go below the least number, so they go one by one.
SIDE = 32
#: Documents of each language that the probabilities are learned from, at most: those of least hash.
SAMPLE = 600
#: Shares in which a language's documents are ranked first, so that no task has to rank all of them.
SHARES = 64
#: Numbers that a task keeps of words that it has scored, at most, and makes at once: fewer words where there are more languages.
KEPT, AT_ONCE = 2_000_000, 100_000
START = 0x2581
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letter_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of lower-cased letters, each word's offset, each text's first word)."""
    lowered = pc.utf8_lower(clean_utf8(texts).cast(pa.large_string()))
    data, offsets = text_bytes(lowered)
    points = code_points(data)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    doc = np.searchsorted(lead, offsets)
    inside = char_classes()[points] == LETTER
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = doc[:-1][doc[:-1] < len(points)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    where = np.flatnonzero(inside)
    return points[where], np.append(np.searchsorted(where, starts), len(where)), np.searchsorted(starts, doc)


class Vocabulary:
    """Pieces of letters, found by a hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        names = sorted({x.lower() for x in names if (x.lstrip("▁").isalpha() or x == "▁") and x.count("▁") <= 1})
        self.size, self.longest = len(names), max(map(len, names))
        hashes = np.zeros(len(names), np.uint64)
        for i, x in enumerate(names):
            h = np.zeros(1, np.uint64)
            for c in x:
                h = (h + np.uint64(ord(c))) * MULTIPLIER
            hashes[i] = h[0]
        if len(set(hashes.tolist())) < len(names):
            raise ValueError("two pieces have one hash")
        self.hashes = np.append(hashes, np.uint64(0))
        self.slots = np.full(1 << 20, -1, np.int32)
        self.slots[(hashes >> np.uint64(44)).astype(np.int64)] = np.arange(len(names))
        beaten = np.flatnonzero(self.slots[(hashes >> np.uint64(44)).astype(np.int64)] != np.arange(len(names)))
        self.more = np.full(1 << 20, -1, np.int32)
        low = ((hashes >> np.uint64(20)) & np.uint64((1 << 20) - 1)).astype(np.int64)
        self.more[low[beaten]] = beaten
        if (self.more[low[beaten]] != beaten).any():
            raise ValueError("two pieces have one slot twice")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, pieces) of the hashes that are pieces."""
        a = self.slots[(hashes >> np.uint64(44)).astype(np.int64)]
        a = np.where(self.hashes[a] == hashes, a, self.more[((hashes >> np.uint64(20)) & np.uint64((1 << 20) - 1)).astype(np.int64)])
        rows = np.flatnonzero((a >= 0) & (self.hashes[a] == hashes))
        return rows, a[rows]

    def arcs(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces) of a matrix of words of one length, in the order of `from`; piece -1 is an unknown letter."""
        n, length = words.shape
        with np.errstate(over="ignore"):
            for i in range(length):
                h = np.zeros(n, np.uint64)
                for j in range(i, min(length, i + self.longest)):
                    h = (h + words[:, j].astype(np.uint64)) * MULTIPLIER
                    rows, found = self.find(h)
                    if j == i and len(rows) < n:
                        odd = np.ones(n, bool)
                        odd[rows] = False
                        odd = np.flatnonzero(odd)
                        yield i, j + 1, odd, np.full(len(odd), -1)
                    if len(rows):
                        yield i, j + 1, rows, found

    def groups(self, points: np.ndarray, offsets: np.ndarray, most: int = 20000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, matrix) of words of one length, SIDE at most, each with the mark of a word's start."""
        sizes = np.diff(offsets)
        order = np.argsort(sizes, kind="stable")
        order = order[: np.searchsorted(sizes[order], SIDE, side="right")]
        edges = np.flatnonzero(np.diff(sizes[order], prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(order))):
            for lo in range(a, b, most):
                own = order[lo : min(b, lo + most)]
                size = sizes[own[0]]
                matrix = np.empty((len(own), size + 1), np.uint32)
                matrix[:, 0] = START
                matrix[:, 1:] = points[offsets[own][:, None] + np.arange(size)]
                yield own, matrix

    def long_words(self, points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(number, letters with the mark of a word's start) of each word of over SIDE letters."""
        for i in np.flatnonzero(np.diff(offsets) > SIDE):
            yield int(i), np.append(np.uint32(START), points[offsets[i] : offsets[i + 1]].astype(np.uint32))

    def spans(self, word: np.ndarray) -> np.ndarray:
        """By length less one and first letter: the piece that these letters of a long word are, -1 for an unknown letter, -2 for none."""
        n = len(word)
        out = np.full((self.longest, n), -2, np.int32)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(self.longest, n)):
                h = (h[: n - k] + word[k:].astype(np.uint64)) * MULTIPLIER
                rows, found = self.find(h)
                if k == 0:
                    out[0] = -1
                out[k][rows] = found
        return out

    def chain(self, spans: np.ndarray, chances: np.ndarray, back: bool = False) -> np.ndarray:
        """ln of the sum over all segmentations of the letters before each place of a long word, with back of those from it on,
        by place and language. Sums are taken beside their largest part, so that no word is too long."""
        longest, n = spans.shape
        known = np.append(chances, np.zeros((1, chances.shape[1])), axis=0)  # -1 is the unknown letter, -2 none
        rows = np.where(spans >= 0, spans, np.where(spans == -1, len(chances) - 1, len(chances))).astype(np.int32)
        out = np.zeros((n + 1, chances.shape[1]))
        for j in range(n - 1, -1, -1) if back else range(1, n + 1):
            k = np.arange(min(longest, n - j if back else j))
            others = j + k + 1 if back else j - k - 1
            steps = known[rows[k, j] if back else rows[k, others]]
            top = out[others].max(0)
            out[j] = top + np.log(np.maximum((steps * np.exp(out[others] - top)).sum(0), 1e-300))
        return out

    def score(self, points: np.ndarray, offsets: np.ndarray, chances: np.ndarray) -> np.ndarray:
        """ln of each word's probability in each language. chances: by piece and language, the last row for unknown letters."""
        out = np.zeros((len(offsets) - 1, chances.shape[1]))
        for own, matrix in self.groups(points, offsets, max(1, AT_ONCE // chances.shape[1])):
            out[own] = np.log(self.forward(matrix, chances)[-1])
        for i, word in self.long_words(points, offsets):
            out[i] = self.chain(self.spans(word), chances)[-1]
        return out

    def forward(self, matrix: np.ndarray, chances: np.ndarray) -> np.ndarray:
        alpha = np.zeros((matrix.shape[1] + 1, len(matrix), chances.shape[1]))
        alpha[0] = 1
        for i, j, rows, found in self.arcs(matrix):
            alpha[j][rows] += alpha[i][rows] * chances[found]
        return alpha

    def learn(self, points: np.ndarray, offsets: np.ndarray, counts: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Chances by expectation maximisation. counts: by word and language."""
        languages = counts.shape[1]
        chances = np.full((self.size + 1, languages), 1 / self.size)
        chances[-1] = UNKNOWN
        for _ in range(rounds):
            found_counts = np.zeros((self.size + 1, languages))
            for own, matrix in self.groups(points, offsets, max(1, AT_ONCE // languages)):
                alpha = self.forward(matrix, chances)
                beta = np.zeros_like(alpha)
                weight = counts[own] / np.maximum(alpha[-1], 1e-300)
                beta[-1] = 1
                for i, j, rows, found in reversed(list(self.arcs(matrix))):
                    step = chances[found] * beta[j][rows]
                    beta[i][rows] += step
                    gain = alpha[i][rows] * step * weight[rows]
                    for k in range(languages):
                        found_counts[:, k] += np.bincount(np.where(found < 0, self.size, found), weights=gain[:, k], minlength=self.size + 1)
            for w, word in self.long_words(points, offsets):
                spans = self.spans(word)
                before, after = self.chain(spans, chances), self.chain(spans, chances, back=True)
                for k in range(len(spans)):
                    at = np.flatnonzero(spans[k] > -2)
                    pieces = np.where(spans[k][at] < 0, self.size, spans[k][at])
                    gain = np.exp(before[at] + np.log(chances[pieces]) + after[at + k + 1] - before[-1]) * counts[w]
                    np.add.at(found_counts, pieces, gain)
            chances = (found_counts + 0.01) / (found_counts[:-1].sum(0) + 0.01 * self.size)
            chances[-1] = UNKNOWN
        return chances


def vocabulary(path: str) -> Vocabulary:
    return kept(f"pieces {path}", lambda: Vocabulary(path))


def train(docs: DataFrame, path: str, train_where, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, chances) from the rows where train_where holds and lang is known: `sample` of each language at most.

    What reaches the driver grows with the number of languages, of which a corpus has some hundreds at most: `sample` keys and
    the words of as many texts, and chances of 260 KB, for each.
    """
    rows = docs.filter(train_where & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Tasks send `sample` keys of each language at most: the limit on the rank is applied before the exchange too.
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit("language"))
    # A language's keys are first ranked in SHARES shares, then what is left of it together.
    first = F.row_number().over(Window.partitionBy("lang", "share").orderBy("key"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    few = rows.select("lang", key.alias("key")).withColumn("share", F.pmod("key", F.lit(SHARES))).withColumn("rank", first).filter(F.col("rank") <= sample)
    picked = few.withColumn("rank", rank).filter(F.col("rank") <= sample).select("lang", "key").toArrow()
    names = sorted(set(picked.column("lang").to_pylist()))
    if not names:
        return [], np.zeros((vocabulary(path).size + 1, 0))
    keys = docs.sparkSession.createDataFrame([(k,) for k in sorted(set(picked.column("key").to_pylist()))], "key long")
    chosen = rows.withColumn("key", key).join(F.broadcast(keys), "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            points, at, doc = letter_words(part.column("text"))
            lang = part.column("lang").dictionary_encode()
            owner = np.repeat(lang.indices.to_numpy(), np.diff(doc))
            distinct, codes = coded(points.view(np.uint8), at * 4)
            both, n = np.unique(owner.astype(np.int64) * len(distinct) + codes, return_counts=True) if len(codes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.record_batch({"lang": lang.dictionary.take(pa.array(both // max(1, len(distinct)))), "word": distinct.take(pa.array(both % max(1, len(distinct)))).cast(pa.binary()), "n": pa.array(n)})

    counts = chosen.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    distinct = counts.column("word").combine_chunks().dictionary_encode()
    distinct = distinct.combine_chunks() if isinstance(distinct, pa.ChunkedArray) else distinct
    table_ = np.zeros((len(distinct.dictionary), len(names)))
    np.add.at(table_, (distinct.indices.to_numpy(), np.searchsorted(names, counts.column("lang").to_pylist())), counts.column("n").to_numpy())
    data, at = text_bytes(distinct.dictionary)
    return names, vocabulary(path).learn(np.frombuffer(data.tobytes(), "<u4"), at // 4, table_)


def predict(docs: DataFrame, path: str, names: list[str], chances: np.ndarray, keep: tuple[str, ...] = (), text_too: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, and the columns to keep, with text_too the text (null: empty): the likeliest language of the whole text.

    The score is its share if all languages are as likely beforehand. Null texts, texts without a letter, and all texts
    where nothing could be learned, are `und` with score 0. Of equally likely languages the first by name is taken.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((names, chances))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, chances = model.value
        words, known = vocabulary(path), Known(max(1000, KEPT // max(1, len(names))))

        def make(new: pa.Array) -> list[pa.Array]:
            data, at = text_bytes(new)
            return [pa.array(x) for x in words.score(np.frombuffer(data.tobytes(), "<u4"), at // 4, chances).astype(np.float32).T]

        for part in chunks(batches):
            points, at, doc = letter_words(part.column("text"))
            total = np.zeros((part.num_rows, len(names)))
            if len(at) > 1 and names:
                distinct, codes = coded(points.view(np.uint8), at * 4)
                found, columns = known.look_up(distinct, make)
                full = np.flatnonzero(np.diff(doc))
                for k, column in enumerate(columns):
                    total[full, k] = np.add.reduceat(column.to_numpy()[found[codes]].astype(np.float64), doc[full])
            sure = (np.diff(doc) > 0) & bool(names)
            best = total.argmax(1) if names else np.zeros(part.num_rows, np.int64)
            score = np.where(sure, 1 / np.exp(total - total.max(1, initial=-np.inf, keepdims=True)).sum(1), 0) if names else np.zeros(part.num_rows)
            out = {"doc_id": part.column("doc_id"), "lang_pred": pa.array([names[b] if s else "und" for b, s in zip(best, sure)], pa.string()), "score": pa.array(score)}
            yield pa.record_batch(out | ({"text": part.column("text").cast(pa.string())} if text_too else {}) | {k: part.column(k) for k in keep})

    kinds = dict(docs.dtypes)
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double" + ", text string" * text_too + "".join(f", {k} {kinds[k]}" for k in keep))


def identify(docs: DataFrame, path: str, keep: tuple[str, ...] = (), text_too: bool = False) -> DataFrame:
    """predict() by what train() learns from the documents whose crc32 of doc_id, mod 3, is not 1."""
    names, chances = train(docs, path, ~held_out(3, 1))
    return predict(docs, path, names, chances, keep, text_too)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
