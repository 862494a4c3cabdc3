"""Words of many texts at once and their hashes, in numpy over UTF-8 bytes.

A word is a longest run of bytes other than space and 0x09 to 0x0D; in UTF-8 that is the same as for characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """First n powers of the base of rolling hashes, modulo 2**64, or of its inverse."""
    key = "inverse" if inverse else "base"
    if len(_POWERS.get(key, ())) < max(n, 1):
        row = np.full(max(n, 1 << 16), _INVERSE if inverse else _BASE)
        row[0] = 1
        _POWERS[key] = np.cumprod(row, dtype=np.uint64)
    return _POWERS[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (finalizer of MurmurHash3; fixed values)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """At [i]: the polynomial of the first i bytes; differences give hashes of substrings."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    return sums


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without nulls, without copying the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


@dataclass
class Words:
    """``first[d]`` to ``first[d + 1]`` are the words of text d; ``start`` and ``end`` are places in ``data``. ``hash`` and
    ``other`` are the halves of a 128-bit digest of each word's bytes."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    other: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """Number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


#: Bytes of text that numpy works on at a time; its arrays take some dozens of times as much.
PART_BYTES = 1 << 20


def parts_of(column: pa.Array):
    """(place of the first, texts): the texts in parts of about PART_BYTES."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(buffer_of(column)[1]).cumsum()
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART_BYTES, "right")))
        yield at, column.slice(at, upto - at)
        at = upto


def words_of(column: pa.Array) -> Words:
    data, offsets = buffer_of(column)
    inside = ~_SEPARATOR[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]
    edges = offsets[1:][np.diff(offsets) > 0] - 1
    ends[edges] = inside[edges]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    low, high = digests(data, start, end)
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), low, high)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of 64 bits of each word: of the two 8-byte halves of a word of up to 16 bytes and its length, each half
    scrambled into the other, and of a longer word those of a hash of 128 bits."""
    size = end - start
    few = size <= 16
    padded = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(16, np.uint8)]), 16)
    halves = (padded[start[few]] * (np.arange(16) < size[few, None]).astype(np.uint8)).view("<u8").astype(np.uint64)
    length = size[few].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    low, high = np.empty(len(size), np.uint64), np.empty(len(size), np.uint64)
    low[few] = mix(halves[:, 0] ^ mix(halves[:, 1] + length))
    high[few] = mix(halves[:, 1] ^ mix(halves[:, 0] ^ ~length))
    many = np.flatnonzero(~few)
    found = b"".join([xxhash.xxh3_128_digest(data[a:b].tobytes()) for a, b in zip(start[many].tolist(), end[many].tolist())])
    parts = np.frombuffer(found, ">u8").astype(np.uint64).reshape(-1, 2)
    low[many], high[many] = parts[:, 1], parts[:, 0]
    return low, high


def runs_of_words(values: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``length`` consecutive values; at [i] of those from i on."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = np.uint64((0xA0761D6478BD642F + 2 * seed * 0xE7037ED1A0B428DB) % (1 << 64) | 1)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total *= factor
        total += values[k : k + n]
    return mix(total ^ np.uint64((seed * 0x8EBC6AF09C88C6E3) % (1 << 64)))


def run_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the words at which a run of ``length`` words of one text starts."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    begins = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(begins, counts) + np.repeat(first[:-1], counts)


def join_kept(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): of every text the kept words, joined by one space."""
    data, keep = words.data.copy(), np.zeros(len(words.data) + 1, np.int8)
    at = np.flatnonzero(kept)
    np.add.at(keep, words.start[at], 1)
    np.add.at(keep, words.end[at], -1)
    keep = np.cumsum(keep[:-1]).astype(bool)
    text = words.text[at]
    gap = words.end[at[:-1][text[:-1] == text[1:]]]  # a separator follows every word but the last of its text
    data[gap] = 0x20
    keep[gap] = True
    sums = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], sums[words.offsets]


def as_binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A large_binary array over its bytes and offsets."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    )
