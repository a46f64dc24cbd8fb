"""Baseline JPEG media columns: markers, Huffman scans, and luminance thumbnails from the DC coefficients alone, in numpy.

A payload is stored as a greyscale baseline JPEG whose 8x8 blocks are flat: sample k is block k's DC coefficient, quantised
by 8, and thus exact. A row of blocks has 64 samples and ends in a restart marker, so that all rows of all images are
decoded side by side. Payloads of more than 8,191 rows take several images, one after the other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.llm.columns import chunks, ranges, text_bytes
from twinseek.llm.shared import table

SIDE, MAX_ROWS = 64, 8191
#: Rows of blocks that are coded side by side.
LANES = 1 << 14
#: Numbers of codes of 1 to 16 bits, and the symbols: the standard's luminance DC table; and one for AC with "end of block" alone.
DC_CODES, DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
AC_CODES, AC_SYMBOLS = (1, *[0] * 15), (0,)


def code_table(counts, symbols) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) by the next 16 bits; length 0 where no code fits."""
    symbol, length, code, k = np.zeros(65536, np.int32), np.zeros(65536, np.int32), 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            lo = code << (16 - bits)
            symbol[lo : lo + (1 << (16 - bits))], length[lo : lo + (1 << (16 - bits))] = symbols[k], bits
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


def codes_of(counts, symbols) -> tuple[np.ndarray, np.ndarray]:
    code, length, c, k = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            code[symbols[k]], length[symbols[k]] = c, bits
            c, k = c + 1, k + 1
        c <<= 1
    return code, length


def header(rows: int) -> bytes:
    def part(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    return (
        b"\xff\xd8" + part(0xDB, b"\0" + bytes([8] + [1] * 63)) + part(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, SIDE * 8, 1, 1, 0x11, 0))
        + part(0xC4, b"\x00" + bytes(DC_CODES) + bytes(DC_SYMBOLS)) + part(0xC4, b"\x10" + bytes(AC_CODES) + bytes(AC_SYMBOLS))
        + part(0xDD, struct.pack(">H", SIDE)) + part(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def code_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows with stuffed zeros, each row's size) of rows of 64 samples."""
    dc, dc_len = codes_of(DC_CODES, DC_SYMBOLS)
    rows = len(samples)
    diff = np.diff(samples.astype(np.int32), axis=1, prepend=128).ravel()
    size = np.zeros(511, np.int64)
    size[:] = [abs(d).bit_length() for d in range(-255, 256)]
    category = size[diff + 255]
    # The code, the difference's own bits, and the one bit of the end of the block: 16 at most.
    value = ((dc[category] << category) + np.where(diff < 0, diff + (1 << category) - 1, diff)) << 1
    bits = dc_len[category] + category + 1
    ends = np.cumsum(bits.reshape(rows, SIDE), axis=1)
    row_bytes = (ends[:, -1] + 7) // 8
    base = (np.cumsum(row_bytes) - row_bytes) * 8
    at = (base[:, None] + ends - bits.reshape(rows, SIDE)).ravel()
    shifted, slot = value << (24 - bits - (at & 7)), at >> 3
    total = int(row_bytes.sum())
    out = np.zeros(total + 3)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount(slot + k, weights=(shifted >> shift) & 255, minlength=total + 3)
    out = out[:total].astype(np.uint8)
    out[np.cumsum(row_bytes) - 1] |= ((1 << (row_bytes * 8 - ends[:, -1])) - 1).astype(np.uint8)
    full = out == 255
    return np.insert(out, np.flatnonzero(full) + 1, 0), row_bytes + np.add.reduceat(full, np.cumsum(row_bytes) - row_bytes, dtype=np.int64)


def store(payload: np.ndarray) -> bytes:
    """A payload of a multiple of 64 bytes as one or more JPEG images."""
    samples = payload.reshape(-1, SIDE)
    return b"".join(store_many([samples[i : i + MAX_ROWS] for i in range(0, len(samples), MAX_ROWS)]))


def store_many(images: list[np.ndarray]) -> list[bytes]:
    """One JPEG image for each array of rows of 64 samples; rows of all images are coded together, LANES at a time."""
    rows = np.concatenate(images)
    coded = [code_rows(rows[i : i + LANES]) for i in range(0, len(rows), LANES)]
    stream, sizes = (np.concatenate(x) for x in zip(*coded))
    ends, view, out, k = np.append(0, np.cumsum(sizes)), stream.tobytes(), [], 0
    for image in images:
        n = len(image)
        parts = [header(n)]
        for i in range(n):
            parts += [view[ends[k + i] : ends[k + i + 1]], bytes((0xFF, 0xD0 + i % 8)) if i < n - 1 else b"\xff\xd9"]
        out.append(b"".join(parts))
        k += n
    return out


class Image:
    """What the markers of one image say. Progressive and arithmetic-coded files are refused."""

    def __init__(self, data, at: int):
        self.quant, self.huffman, self.interval, self.parts = {}, {}, 0, {}
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        at += 2
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide, k = body[0] >> 4, body[0] & 15
                    self.quant[k] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError(f"not a baseline JPEG: marker {marker:x}")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, 16 + (body[2 + 2 * i] & 15)) for i in range(body[0])]
                break
        self.begin = at
        if len(self.scan) == 1:
            # Alone in its scan, a part's blocks come row by row.
            self.blocks = [(self.scan[0][0], 0, 0, *self.scan[0][1:])]
            self.across, self.down, self.h, self.v = -(-self.width // 8), -(-self.height // 8), 1, 1
        else:
            h, v = (max(p[k] for p in self.parts.values()) for k in (0, 1))
            self.blocks = [(c, x, y, d, a) for c, d, a in self.scan for y in range(self.parts[c][1]) for x in range(self.parts[c][0])]
            self.across, self.down = -(-self.width // (8 * h)), -(-self.height // (8 * v))
            self.h, self.v = self.parts[self.scan[0][0]][:2]
        self.units = self.across * self.down
        self.key = (tuple(sorted(self.huffman.items())), tuple(self.blocks))


def thumbnails(data: bytes) -> list[tuple[Image, np.ndarray]]:
    """The images in the bytes, one after the other, each with its luminance thumbnail of a sample for each block."""
    raw = np.frombuffer(data, np.uint8)
    full = np.flatnonzero(raw[:-1] == 255)
    after = raw[full + 1]
    stops, restarts = full[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 255)], full[(after >= 0xD0) & (after <= 0xD7)]
    images, lanes, at = [], [], 0
    while at < len(data) - 1:
        image = Image(data, at)
        k = np.searchsorted(stops, image.begin)
        end = int(stops[k]) if k < len(stops) else len(data)
        inner = restarts[np.searchsorted(restarts, image.begin) : np.searchsorted(restarts, end)]
        lanes.append((np.append(image.begin, inner + 2), np.append(inner, end)))
        images.append(image)
        while end < len(data) - 1 and not (data[end] == 0xFF and data[end + 1] == 0xD9):
            end += 1
        at = end + 2
    if not images:
        return []
    out: list[np.ndarray | None] = [None] * len(images)
    groups: dict = {}
    for i, image in enumerate(images):
        groups.setdefault(image.key, []).append(i)
    for members in groups.values():
        begin, end = (np.concatenate([lanes[i][k] for i in members]) for k in (0, 1))
        count = np.concatenate([np.minimum(images[i].interval or images[i].units, images[i].units - np.arange(len(lanes[i][0])) * (images[i].interval or images[i].units)) for i in members])
        dcs = np.concatenate([decode(raw, begin[lo : lo + LANES], end[lo : lo + LANES], np.maximum(count[lo : lo + LANES], 0), images[members[0]]) for lo in range(0, len(begin), LANES)])
        k = 0
        for i in members:
            image = images[i]
            n = image.units * image.h * image.v
            own, k = dcs[k : k + n], k + n
            # Blocks of a unit stand together: to rows.
            own = own.reshape(image.down, image.across, image.v, image.h).transpose(0, 2, 1, 3).reshape(image.down * image.v, image.across * image.h)
            part = image.parts[image.scan[0][0]]
            own = own[: -(-image.height // 8), : -(-image.width // 8)]
            out[i] = np.clip(np.round(own * image.quant[part[2]] / 8) + 128, 0, 255).astype(np.uint8)
    return list(zip(images, out))


def decode(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, count: np.ndarray, image: Image) -> np.ndarray:
    """The first part's DC coefficients of all lanes, lane after lane; a lane is the bytes between two restart markers."""
    sizes = end - begin
    data = raw[ranges(begin, sizes)]
    first = np.cumsum(sizes) - sizes
    stuffed = np.zeros(len(data) + 1, bool)
    stuffed[1:-1] = (data[:-1] == 255) & (data[1:] == 0)
    stuffed[first[sizes > 0]] = False
    stuffed = stuffed[: len(data)]
    first = first - np.append(0, np.cumsum(stuffed))[first]
    data = np.concatenate([data[~stuffed], np.full(8, 255, np.uint8)]).astype(np.int64)
    window = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    most = len(window) - 1

    def peek(at: np.ndarray) -> np.ndarray:
        return (window[np.minimum(at >> 3, most)] >> (8 - (at & 7))) & 65535

    tables = {k: code_table(*v) for k, v in image.huffman.items()}
    order = np.argsort(-count, kind="stable")
    at, left = first[order] * 8, count[order]
    luma = image.scan[0][0]
    per_unit = sum(b[0] == luma for b in image.blocks)
    most_units = int(left[0]) if len(left) else 0
    out = np.zeros((len(order), most_units * per_unit), np.int32)
    before = {c: np.zeros(len(order), np.int64) for c, *_ in image.scan}
    for unit in range(most_units):
        n = int(np.searchsorted(-left, -unit, side="left"))
        pos, k = at[:n], unit * per_unit
        for c, _, _, d, a in image.blocks:
            symbols, lengths = tables[d]
            bits = peek(pos)
            size = symbols[bits].astype(np.int64)
            pos = pos + lengths[bits]
            own = peek(pos) >> (16 - size)
            pos += size
            own = np.where((own >> np.maximum(size - 1, 0)) == 0, own - (1 << size) + 1, own) * (size > 0)
            before[c][:n] += own
            if c == luma:
                out[:n, k] = before[c][:n]
                k += 1
            symbols, lengths = tables[a]
            on, done = np.arange(n), np.zeros(n, np.int64)
            while len(on):
                bits = peek(pos[on])
                symbol = symbols[bits]
                length = lengths[bits]
                pos[on] += np.maximum(length, 1) + (symbol & 15)
                done[on] += (symbol >> 4) + 1
                on = on[(symbol != 0) & (done[on] < 63)]
        at[:n] = pos
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back][np.arange(out.shape[1]) < (count * per_unit)[:, None]]


def average_hash(thumbnail: np.ndarray) -> str:
    """Which of 8 x 8 areas are lighter than their mean, as 16 hex digits. Areas of a smaller thumbnail repeat samples."""
    for axis in (0, 1):
        n = thumbnail.shape[axis]
        edges = np.arange(8) * n // 8
        sizes = np.maximum(np.diff(np.append(edges, n)), 1)
        thumbnail = np.add.reduceat(thumbnail, edges, axis=axis, dtype=np.float64) / (sizes if axis else sizes[:, None])
    return np.packbits(thumbnail > thumbnail.mean()).tobytes().hex()


def padded(text: memoryview | bytes) -> np.ndarray:
    n = len(text)
    out = np.zeros(max(SIDE, -(-n // SIDE) * SIDE), np.uint8)
    out[:n] = np.frombuffer(text, np.uint8)
    return out


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every row: its whole text as JPEG. Null texts count as empty: one row of 64 zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            data, at = text_bytes(part.column("text"))
            images, owner = [], []
            for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
                rows = padded(data[a:b]).reshape(-1, SIDE)
                for lo in range(0, len(rows), MAX_ROWS):
                    images.append(rows[lo : lo + MAX_ROWS])
                    owner.append(i)
            stored: list[list[bytes]] = [[] for _ in range(part.num_rows)]
            for i, image in zip(owner, store_many(images)):
                stored[i].append(image)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": pa.array(np.diff(at)), "media": pa.array([b"".join(x) for x in stored], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Adds to (doc_id, n_bytes, media) what the stored bytes tell: the payload's digests, dimensions and thumbnail hash.

    Media that are null or empty have no payload: sizes 0, digests of nothing, dimensions 0x0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "media"):
            blobs = [x or b"" for x in part.column("media").to_pylist()]
            found = thumbnails(b"".join(blobs))
            rows, k, at = [], 0, 0
            for blob in blobs:
                own, at = [], at + len(blob)
                while k < len(found) and found[k][0].begin < at:
                    own.append(found[k])
                    k += 1
                pixels = np.concatenate([t.ravel() for _, t in own]) if own else np.zeros(0, np.uint8)
                name = "+".join(f"{i.width}x{i.height}:{average_hash(t)}" for i, t in own) or "0x0:"
                rows.append((len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-SIDE:]), len(blob), hashlib.sha256(blob).hexdigest(), name))
            columns = dict(zip(("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), zip(*rows)))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes")} | {k: pa.array(v) for k, v in columns.items()})

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(with_media(table(spark, sf_dir, "documents")))
