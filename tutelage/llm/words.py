"""Words and shingles of many texts at once, as numpy arrays over UTF-8 bytes.

A word is a longest run of bytes other than space and \\t\\n\\v\\f\\r, with A-Z lower-cased.
A shingle of ``k`` words is a 64-bit hash; a text with 1 to k-1 words has its whole word
sequence as its only shingle, a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

BLOCK_BYTES = 1 << 20

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[data]


#: Words of up to so many bytes are hashed together, eight bytes at a time; longer ones alone.
COLUMN_BYTES = 64
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of data[start:end] for each word, whatever its place.

    Eight bytes at a time are folded in by a full mix, so no two words collide by their form;
    equal words of another seed get an unrelated hash.
    """
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(seed))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= COLUMN_BYTES))
    at = 0
    while len(live):
        lane = eight[starts[live] + at]
        left = size[live] - at
        last = left < 8
        lane[last] &= _LOW_BYTES[left[last]]
        out[live] = mix(out[live] ^ lane)
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > COLUMN_BYTES).tolist():
        out[i] = xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes(), seed)
    return out


@dataclass
class Texts:
    """Words of a block of texts; text d has the words first[d] to first[d + 1]."""

    starts: np.ndarray   # byte of each word inside its text
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes in text order, and where each text's shingles begin."""
        count = np.diff(self.first)
        n = len(self.hashes)
        folded = self.hashes.copy()
        keep = np.ones(n, bool)
        last = np.repeat(self.first[1:], count)
        place = np.arange(n)
        for j in range(1, k):
            inside = place + j < last
            following = np.zeros(n, np.uint64)
            following[:max(n - j, 0)] = self.hashes[j:]
            folded = np.where(inside, mix(folded * np.uint64(_BASE) + following), folded)
            keep &= inside
        short = (count > 0) & (count < k)
        keep[self.first[:-1][short]] = True
        sizes = np.where(short, 1, np.maximum(count - k + 1, 0))
        return folded[keep], np.concatenate(([0], np.cumsum(sizes)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying; a null is an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` bytes; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def read_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _BLANK) -> Texts:
    """Words of the texts between consecutive offsets; ``between`` marks the bytes that part words."""
    low = int(offsets[0])
    data = lowered(data[low:int(offsets[-1])])
    edges = offsets - low
    blank = between[data]
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    before[edges[:-1][edges[:-1] < len(data)]] = True
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:]
    after[edges[1:][edges[1:] > 0] - 1] = True
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(~blank & after) + 1
    first = np.searchsorted(starts, edges)
    origin = np.repeat(edges[:-1], np.diff(first))
    return Texts(starts - origin, ends - origin, hash_words(data, starts, ends), first)


def each_block(batch: pa.RecordBatch | pa.Table, column: str,
               between: np.ndarray = _BLANK) -> Iterator[tuple[int, int, Texts]]:
    """(first row, past last row, words) for blocks of about a megabyte of a text column."""
    data, offsets = text_bytes(batch.column(column))
    for first, last in blocks(offsets):
        yield first, last, read_words(data, offsets[first:last + 1], between)
