"""Whole columns of text as numpy arrays: words, tokens and hashes without a Python loop over them."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together. A longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20


def kept(key: str, build: Callable, alone: bool = True):
    """What build() gives, once in each Python process: modules that are shipped by value have no lasting globals.

    Processes serve one operator after another, so what is kept `alone` gives way to the next such thing.
    """
    store = sys.__dict__.setdefault("_twinseek_kept", {})
    if key not in store:
        if alone:
            for other in [k for k, (_, single) in store.items() if single]:
                del store[other]
            gc.collect()
            give_back()
        store[key] = build(), alone
    return store[key][0]


def give_back() -> None:
    """Returns memory that is free to the system, of which executors share what the JVM leaves."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about `most` bytes in the column, one row at least. Nulls become empty texts.

    Free memory is returned now and then: what allocators keep would grow to twice what is used.
    """
    done = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
            part = batch.slice(begin, end - begin)
            yield part.set_column(at, pa.field(column, pa.large_binary()), pc.fill_null(part.column(at), "" if pa.types.is_string(part.column(at).type) or pa.types.is_large_string(part.column(at).type) else b"").cast(pa.large_binary()))
            begin = end
            done += 1
            if done % 8 == 0:
                give_back()
    give_back()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, "<i8", len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, "<i8")
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def spaces() -> np.ndarray:
    """Bytes 9-13 and 32 separate words."""
    table = np.zeros(256, bool)
    table[9:14] = table[32] = True
    return table


def marks() -> np.ndarray:
    """Every ASCII byte that is neither a letter nor a digit separates."""
    table = np.zeros(256, bool)
    table[:128] = [not chr(c).isalnum() for c in range(128)]
    return table


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words of texts: (bytes without separators, each word's offset, each text's first word)."""
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    before = np.cumsum(inside, dtype=np.int64)
    bytes_ = lower_ascii()[data[inside]]
    return bytes_, np.append(before[starts] - 1, len(bytes_)), np.searchsorted(starts, offsets)


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(distinct byte strings, code of each) of the strings between successive offsets."""
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, "<i8")), pa.py_buffer(np.ascontiguousarray(data))])
    known = array.dictionary_encode()
    return known.dictionary, known.indices.to_numpy(zero_copy_only=False)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def held_out(crc_mod: int, remainder: int, doc_id: str = "doc_id"):
    """crc32 of the id as text, by its remainder. A null id counts as the empty text, whose crc32 is 0."""
    from pyspark.sql import functions as F

    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % crc_mod) == remainder


# XXH64. Fixed values of the published algorithm.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[starts[i] : starts[i] + lengths[i]] for every i, in blocks that stay in the cache."""
    padded = np.concatenate([data, np.zeros(40, np.uint8)])
    wide, half = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,)), np.ndarray(len(padded) - 3, "<u4", padded, 0, (1,))
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), 16384):
        out[i : i + 16384] = _xxh64(padded, wide, half, starts[i : i + 16384].astype(np.int64), lengths[i : i + 16384].astype(np.int64), seed)
    return out


def _xxh64(data, wide, half, at, n, seed) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = np.uint64(seed)
        at, h = at.copy(), np.full(len(at), seed + P5)
        if len(big := np.flatnonzero(n >= 32)):
            lanes = [np.full(len(big), x) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            left = n[big] // 32
            while len(on := np.flatnonzero(left > 0)):
                p = at[big[on]]
                for k in range(4):
                    lanes[k][on] = _rotl(lanes[k][on] + wide[p + 8 * k] * P2, 31) * P1
                at[big[on]] += 32
                left[on] -= 1
            x = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for lane in lanes:
                x = (x ^ (_rotl(lane * P2, 31) * P1)) * P1 + P4
            h[big] = x
        h += n.astype(np.uint64)
        left = n & 31
        for k in range(1, 4):
            on = np.flatnonzero(left >= 8 * k)
            h[on] = _rotl(h[on] ^ (_rotl(wide[at[on]] * P2, 31) * P1), 27) * P1 + P4
            at[on] += 8
        on = np.flatnonzero(left & 4)
        h[on] = _rotl(h[on] ^ (half[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
        at[on] += 4
        for k in range(1, 4):
            on = np.flatnonzero((left & 3) >= k)
            h[on] = _rotl(h[on] ^ (data[at[on]].astype(np.uint64) * P5), 11) * P1
            at[on] += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


#: Unicode's White_Space property, fixed values.
WHITE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def char_classes() -> np.ndarray:
    """The class of every code point, built once in a process."""

    def build() -> np.ndarray:
        import regex

        text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, name in ((LETTER, "L"), (NUMBER, "N")):
            for m in regex.finditer(rf"\p{{{name}}}+", text):
                a, b = ord(m[0][0]), ord(m[0][-1])
                table[a : b + 1] = kind
        table[0xD800:0xE000] = OTHER
        table[list(WHITE)] = SPACE
        return table

    return kept("char_classes", build, alone=False)


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")


def clean_utf8(texts: pa.Array) -> pa.Array:
    """Bytes that are no UTF-8 become U+FFFD."""
    try:
        text_bytes(texts)[0].tobytes().decode("utf-8")
        return texts
    except UnicodeDecodeError:
        return pa.array([x.decode("utf-8", "replace").encode() for x in texts.to_pylist()], pa.large_binary())


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts split as public_tokenizers.PATTERN does: (bytes, each piece's byte offset, each text's first piece).

    A run of one class is a piece; a blank before it joins it; of white space before other characters the last one stands
    apart; an apostrophe that begins a piece takes a contraction's letters.
    """
    texts = clean_utf8(texts)
    data, offsets = text_bytes(texts)
    points = code_points(data)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    doc = np.searchsorted(lead, offsets)
    n = len(points)
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[doc[:-1]] = True
    first = first[:n]
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(begin[1:] & ~first[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    begin[after - 1] = True
    begin[after[points[after - 1] == 32]] = False
    quote = np.flatnonzero((points == 39) & begin)
    quote = quote[(quote + 1 < n)]
    quote = quote[~first[quote + 1] & (kind[quote + 1] == LETTER)]
    a = points[quote + 1]
    b = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
    b = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n - 1)], b, 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    begin[quote[one | two] + 1] = False
    ends = np.concatenate([quote[one] + 2, quote[two] + 3])
    begin[ends[ends < n]] = True
    starts = np.flatnonzero(begin)
    return data, np.append(lead[starts], len(data)), np.searchsorted(starts, doc)


class Known:
    """Values of distinct byte strings, kept between chunks: some columns for each string. At `most` strings it starts anew."""

    def __init__(self, most: int = 500_000):
        self.most, self.words, self.columns = most, pa.array([], pa.large_binary()), None

    def look_up(self, words_: pa.Array, make: Callable[[pa.Array], list[pa.Array]]) -> tuple[np.ndarray, list[pa.Array]]:
        """(row of each word, columns), by make() for words that are new."""
        if len(self.words) > self.most:
            self.words, self.columns = pa.array([], pa.large_binary()), None
        at = pc.index_in(words_, value_set=self.words)
        if at.null_count or self.columns is None:
            new = words_.filter(pc.is_null(at))
            made, old = make(new), len(self.words)
            self.words = pa.concat_arrays([self.words, new])
            self.columns = made if self.columns is None else [pa.concat_arrays([a, b]) for a, b in zip(self.columns, made)]
            rows = pc.fill_null(at, 0).to_numpy().astype(np.int64)
            rows[pc.is_null(at).to_numpy(zero_copy_only=False)] = old + np.arange(len(new))
            return rows, self.columns
        return at.to_numpy().astype(np.int64), self.columns
