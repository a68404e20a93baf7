"""Media columns: payloads as baseline JPEG, and a JPEG reader in numpy.

Storing. The format's unit is a quantised coefficient. A payload of 64 n bytes becomes
n blocks of 64 coefficients in scan order, each byte a coefficient of magnitude class 8
(byte b stands for b if b >= 128 and for b - 255 below; these are the 256 values of that
class, and b itself is their bit pattern), with quantiser 1. A restart marker after every
block keeps the DC predictor at zero. Width and height are near a square of blocks; a
comment segment holds the text's size and the payload's. Nothing is lost.

Reading. ``parse`` walks the markers (DQT, SOF0, DHT, DRI, SOS, COM, restarts) of any
baseline file: several components, sampling factors, scans and restart intervals. Entropy
decoding goes in step over all restart segments of all images that share tables and
layout: one symbol for each at a time, by a table of all 16-bit prefixes. The DC terms of
the first component give a luminance thumbnail of one pixel a block, hashed by the signs
of its horizontal differences on an 8 x 9 grid.

Edge cases: null and empty texts are 64 zero bytes; equal texts give equal values; a
null media value gives null features; a file that isn't baseline JPEG raises ValueError;
an empty table gives an empty result. Payloads may have up to 4 GB.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.bpe import slabs
from terrane.llm.runtime import small_batches
from terrane.llm.textops import text_buffer

UNIT, MOST = 64, 8191  # bytes a block; blocks in a row or column
#: Each Huffman table of ours has one code, the bit 0, for run 0 and class 8.
_TABLE = bytes([1] + [0] * 15 + [0x08])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_FIXED = _segment(0xDB, bytes([0] + [1] * 64)), _segment(0xC4, b"\x00" + _TABLE) + _segment(0xC4, b"\x10" + _TABLE) + _segment(0xDD, b"\x00\x01") + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def shape_of(blocks: int) -> tuple[int, int]:
    """Columns and rows of blocks."""
    wide = min(MOST, max(1, int(np.ceil(np.sqrt(blocks)))))
    high = -(-blocks // wide)
    if high > MOST:
        raise ValueError("the payload is too long for one image")
    return wide, high


def to_jpegs(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """One file for each text."""
    size = np.diff(offs)
    blocks = np.maximum(1, -(-size // UNIT))
    shapes = [shape_of(b) for b in blocks.tolist()]
    drawn = np.array([w * h for w, h in shapes], np.int64)
    ends = np.cumsum(drawn)
    grid = np.zeros(int(ends[-1]) * UNIT if len(ends) else 0, np.uint8)
    grid[np.repeat((ends - drawn) * UNIT - offs[:-1], size) + np.arange(len(data))] = data
    bits = np.zeros((len(grid), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(grid[:, None], axis=1)
    packed = np.packbits(bits.reshape(-1, UNIT * 9), axis=1)  # 72 bytes a block
    room = 1 + (packed == 0xFF)
    room[:, -1] += 2  # the marker after the block
    after = np.cumsum(room.ravel())
    out = np.zeros(int(after[-1]) if len(after) else 0, np.uint8)
    out[after - room.ravel()] = packed.ravel()
    close = after.reshape(-1, 72)[:, -1]
    number = np.arange(len(close)) - np.repeat(ends - drawn, drawn)
    out[close - 2] = 0xFF
    out[close - 1] = 0xD0 + number % 8
    out[close[ends - 1] - 1] = 0xD9
    scan, cut = out.tobytes(), np.r_[0, close[ends - 1]].tolist()
    return [
        b"\xff\xd8" + _segment(0xFE, struct.pack(">QQ", n, b * UNIT)) + _FIXED[0]
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * h, 8 * w, 1, 1, 0x11, 0)) + _FIXED[1] + scan[s:e]
        for n, b, (w, h), s, e in zip(size.tolist(), blocks.tolist(), shapes, cut, cut[1:])
    ]


@dataclass
class Scan:
    components: list[int]
    tables: tuple[tuple[bytes, bytes], ...]  # DC and AC of each component
    interval: int
    body: tuple[int, int]


@dataclass
class Image:
    width: int = 0
    height: int = 0
    quant: dict[int, list[int]] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    comment: bytes = b""
    scans: list[Scan] = field(default_factory=list)

    def mcus(self, scan: Scan) -> tuple[int, int, list[int]]:
        """Columns and rows of units in a scan, and the component of each block of a unit."""
        hm, vm = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(scan.components) > 1:
            unit = [i for i in scan.components for _ in range(self.components[i][1] * self.components[i][2])]
            return -(-self.width // (8 * hm)), -(-self.height // (8 * vm)), unit
        i = scan.components[0]
        _, h, v, _ = self.components[i]
        return -(-self.width * h // (8 * hm)), -(-self.height * v // (8 * vm)), [i]


def parse(b: bytes) -> Image:
    """Markers and where the entropy-coded data lie."""
    if b[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, huff, interval, at = Image(), {}, 0, 2
    while at < len(b):
        if b[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        n = int.from_bytes(b[at + 2 : at + 4])
        body, at = b[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quant[body[0] & 15] = [int.from_bytes(body[1 + wide * i : 1 + wide * (i + 1)]) for i in range(64)]
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                count = 17 + sum(body[1:17])
                huff[body[0]] = body[1:count]
                body = body[count:]
        elif marker == 0xDD:
            interval = int.from_bytes(body)
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("samples aren't of 8 bits")
            image.height, image.width = struct.unpack(">HH", body[1:5])
            image.components = [(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(body[5]))]
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDA:
            ids = [c[0] for c in image.components]
            parts = [body[1 + 2 * i : 3 + 2 * i] for i in range(body[0])]
            end = at
            while True:
                end = b.find(b"\xff", end)
                if end < 0 or end + 1 >= len(b):
                    end = len(b)
                    break
                if b[end + 1] == 0 or 0xD0 <= b[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            tables = tuple((huff[p[1] >> 4], huff[0x10 | p[1] & 15]) for p in parts)
            image.scans.append(Scan([ids.index(p[0]) for p in parts], tables, interval, (at, end)))
            at = end
    return image


@functools.lru_cache(maxsize=64)
def prefixes(table: bytes) -> np.ndarray:
    """For all 16-bit prefixes: code length * 256 + symbol, 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    code, at = 0, 16
    for size in range(1, 17):
        for _ in range(table[size - 1]):
            out[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode_segments(words: np.ndarray, start: np.ndarray, count: np.ndarray, unit: tuple[int, ...], tables: tuple[tuple[bytes, bytes], ...]) -> np.ndarray:
    """Coefficients in scan order of every block of the segments.

    words: the 32 bits that begin at every byte; start: first bytes; count: blocks of each
    segment; unit: place in tables of each block of a unit, which also says whose DC predicts."""
    lut = np.concatenate([prefixes(t) for pair in tables for t in pair])
    unit_of = np.array(unit, np.int64)
    first = np.cumsum(count) - count
    out = np.zeros((int(count.sum()), 64), np.int16)
    flat = out.reshape(-1)
    keep = np.flatnonzero(count > 0)
    bit, block, left = start[keep].astype(np.int64) * 8, first[keep].copy(), count[keep].copy()
    place, k = np.zeros(len(keep), np.int64), np.zeros(len(keep), np.int64)
    predict = np.zeros((len(keep), len(tables)), np.int64)
    while len(bit):
        own = unit_of[place]
        dc = k == 0
        code = words[bit >> 3].astype(np.int64) >> (16 - (bit & 7)) & 0xFFFF
        entry = lut[((own * 2 + (1 - dc)) << 16) + code]
        if not entry.all():
            raise ValueError("no Huffman code fits")
        bit += entry >> 8
        symbol = entry & 255
        size = symbol & 15
        value = words[bit >> 3].astype(np.int64) >> (32 - (bit & 7) - size) & ((1 << size) - 1)
        value -= np.where(value < (1 << size) >> 1, (1 << size) - 1, 0)
        bit += size
        if dc.any():
            at = np.flatnonzero(dc)
            predict[at, own[at]] += value[at]
            value[at] = predict[at, own[at]]
        run = np.where(dc, 0, symbol >> 4)
        to = k + run
        put = dc | (size > 0)
        if (to[put] > 63).any():
            raise ValueError("a run passes the end of its block")
        flat[block[put] * 64 + to[put]] = value[put]
        k = np.where(put, to + 1, np.where(symbol == 0xF0, k + 16, 64))
        over = k >= 64
        if over.any():
            block, left, place, k = block + over, left - over, np.where(over, (place + 1) % len(unit), place), np.where(over, 0, k)
            live = left > 0
            if not live.all():
                bit, block, left, place, k, predict = bit[live], block[live], left[live], place[live], k[live], predict[live]
    return out


def decode(files: list[bytes]) -> list[tuple[Image, list[np.ndarray]]]:
    """For each file: what the markers say and, for each component, coefficients (rows, columns, 64) in scan order."""
    images = [parse(b) for b in files]
    groups: dict[tuple, list[tuple[int, Scan]]] = {}
    for i, image in enumerate(images):
        for scan in image.scans:
            _, _, unit = image.mcus(scan)
            groups.setdefault((tuple(scan.components.index(c) for c in unit), scan.tables), []).append((i, scan))
    planes: list[list[np.ndarray]] = [[np.zeros((0, 0, 64), np.int16)] * len(m.components) for m in images]
    for (unit, tables), members in groups.items():
        raw = np.frombuffer(b"".join(files[i][slice(*scan.body)] for i, scan in members), np.uint8)
        ends = np.cumsum([scan.body[1] - scan.body[0] for _, scan in members])
        marks = np.flatnonzero(raw[:-1] == 0xFF)
        stuffed = marks[raw[marks + 1] == 0] + 1
        restarts = marks[(raw[marks + 1] & 0xF8) == 0xD0]
        drop = np.ones(len(raw), bool)
        drop[stuffed] = False
        drop[restarts] = drop[restarts + 1] = False
        kept = np.r_[0, np.cumsum(drop)]
        clean = np.r_[raw[drop], np.zeros(8, np.uint8)]
        words = np.ndarray((len(clean) - 3,), ">u4", clean.data, strides=(1,))
        begins = np.sort(np.r_[np.r_[0, ends[:-1]], restarts + 2])
        per_image = np.diff(np.searchsorted(begins, np.r_[0, ends]))
        count = []
        for (i, scan), n in zip(members, per_image.tolist()):
            wide, high, _ = images[i].mcus(scan)
            each = scan.interval or wide * high
            if n != -(-wide * high // each):
                raise ValueError("the number of restart segments is wrong")
            count += [each * len(unit)] * (n - 1) + [(wide * high - each * (n - 1)) * len(unit)]
        count = np.array(count, np.int64)
        got = decode_segments(words, kept[begins], count, unit, tables)
        cut = np.cumsum(count)[np.cumsum(per_image) - 1]
        for (i, scan), part in zip(members, np.split(got, cut[:-1])):
            wide, high, whole = images[i].mcus(scan)
            part = part.reshape(high, wide, len(whole), 64)
            for c in scan.components:
                _, h, v, _ = images[i].components[c] if len(scan.components) > 1 else (0, 1, 1, 0)
                own = part[:, :, [x == c for x in whole]].reshape(high, wide, v, h, 64)
                planes[i][c] = own.transpose(0, 2, 1, 3, 4).reshape(high * v, wide * h, 64)
    return list(zip(images, planes))


def thumbnail(image: Image, planes: list[np.ndarray]) -> np.ndarray:
    """Luminance of one pixel a block, from the DC terms of the first component."""
    q = image.quant[image.components[0][3]][0]
    return np.clip(np.floor(planes[0][:, :, 0].astype(np.int64) * q / 8 + 128.5), 0, 255).astype(np.uint8)


def difference_hash(thumb: np.ndarray) -> str:
    """64 signs of horizontal differences on a grid of 8 rows and 9 columns, as hex."""
    h, w = thumb.shape
    grid = thumb[np.arange(8) * h // 8][:, np.arange(9) * w // 9]
    return np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()


def payload(image: Image, planes: list[np.ndarray]) -> tuple[int, bytes]:
    """The text's size and the payload that to_jpegs stored."""
    n, size = struct.unpack(">QQ", image.comment)
    c = planes[0].reshape(-1)[:size]
    return n, np.where(c < 0, c + 255, c).astype(np.uint8).tobytes()


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """All other columns and the text's JPEG file."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    rows = docs.select(*others, F.col(text).cast("string").alias("_text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffer(batch.column(batch.num_columns - 1))
            for k, j in slabs(offs):
                files = pa.array(to_jpegs(data[offs[k] : offs[j]], offs[k : j + 1] - offs[k]), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(k, j - k).columns[:-1], files], names=[*others, media])

    return rows.mapInArrow(kernel, ", ".join([f"`{c}` {t}" for c, t in rows.dtypes[:-1]] + [f"`{media}` binary"]))


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """All other columns and FEATURES of the stored files, read back."""
    small_batches(df.sparkSession)
    others = [c for c in df.columns if c != media]
    rows = df.select(*others, media)
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes[:-1]] + [FEATURES])
    names = [*others, *[x.split()[0] for x in FEATURES.split(", ")]]

    def row(b: bytes, image: Image, planes: list[np.ndarray]) -> tuple:
        n, back = payload(image, planes)
        feature = f"{image.width}x{image.height}:{difference_hash(thumbnail(image, planes))}"
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(b), hashlib.sha256(b).hexdigest(), feature, image.width, image.height

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            files = batch.column(batch.num_columns - 1).to_pylist()
            offs = np.r_[0, np.cumsum([len(b or b"") for b in files])]
            for k, j in slabs(offs):
                there = [b for b in files[k:j] if b is not None]
                got = iter([row(b, *d) for b, d in zip(there, decode(there))])
                rows = [next(got) if b is not None else (None,) * len(kinds) for b in files[k:j]]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*batch.slice(k, j - k).columns[:-1], *cols], names=names)

    return rows.mapInArrow(kernel, schema)


def op3(docs: DataFrame) -> DataFrame:
    return media_features(with_media(docs.select("doc_id", "text")))
