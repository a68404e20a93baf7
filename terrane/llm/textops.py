"""Byte-level text kernels shared by the language-model operators.

Every kernel works on one Arrow batch at a time: the UTF-8 bytes of all its
texts lie in one buffer, ``offs`` holds where each text starts and ends, and a
null text is an empty one. Words are maximal runs of bytes other than space and
the controls 9 to 13; since those bytes never occur inside a multi-byte
character, byte-level splitting equals splitting by code point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U64 = np.uint64


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_binary():
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word, in order."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_WS[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    heads = offs[:-1][offs[:-1] < len(data)]
    begins[heads] = inside[heads]
    stops = inside[:-1].copy()
    stops[:-1] &= ~inside[1:-1]
    tails = offs[1:][offs[1:] > 0] - 1
    stops[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> _U64(32))
    h = h * _U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U64(32))
    h = h * _U64(0xD6E8FEB86659FD93)
    return h ^ (h >> _U64(32))


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at every place, with zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def first_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span, or all of a shorter one, as an integer."""
    return _words_at(data)[starts] & _KEEP[np.minimum(ends - starts, 8)]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a step for all spans at once."""
    at = _words_at(data)
    left = (ends - starts).astype(np.int64)
    h = mix64(left.astype(_U64) + _U64(0x9E3779B97F4A7C15))
    h = mix64(h ^ (at[starts] & _KEEP[np.minimum(left, 8)])) + _U64(0x9E3779B97F4A7C15)
    live = np.flatnonzero(left > 8)
    pos, left = starts[live].astype(np.int64) + 8, left[live] - 8
    while len(live):
        h[live] = mix64(h[live] ^ (at[pos] & _KEEP[np.minimum(left, 8)])) + _U64(0x9E3779B97F4A7C15)
        more = left > 8
        live, pos, left = live[more], pos[more] + 8, left[more] - 8
    return h


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words, one space after each, and where each starts and ends there."""
    size = ends - starts
    new_ends = np.cumsum(size + 1) - 1
    new_starts = new_ends - size
    out = np.full(int(new_ends[-1]) + 1 if len(size) else 0, 32, np.uint8)
    if len(size):
        shift = np.repeat(starts - new_starts, size)
        places = np.arange(len(shift)) + np.repeat(np.arange(len(size)), size)
        out[places] = data[places + shift]
    return out.tobytes(), new_starts, new_ends
