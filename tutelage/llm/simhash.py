"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming lookup."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutelage.llm.setup import join_ids
from tutelage.llm.words import Texts, each_block, mix, read_words, text_bytes
from tutelage.llm.worker import free
from tutelage.session import stored

WORDS = 5        # in a shingle
BITS = 128       # of a fingerprint
RADIUS = 32      # 33 blocks of 3 or 4 bits: within the radius one block at least is equal
#: Bytes of benchmark text that one pass over the documents is held against.
PASS_BYTES = 8 << 20
_EDGES = np.linspace(0, BITS, RADIUS + 2).round().astype(int)
_FILTER = 1 << 22


def shingle_bits(shingles: np.ndarray) -> np.ndarray:
    """The 128 bits of each shingle as -1 and 1."""
    halves = np.stack([mix(shingles + np.uint64(5)), mix(shingles + np.uint64(77))], axis=1)
    return np.unpackbits(halves.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _blocks(bits: np.ndarray) -> np.ndarray:
    """The value of each Hamming block of fingerprints given as 0/1 rows."""
    return np.stack([bits[:, a:b] @ (1 << np.arange(b - a)) for a, b in zip(_EDGES, _EDGES[1:])], axis=1)


@dataclass
class SizeIndex:
    """Items of one size: their fingerprints and, per block and value, the items that have it."""

    items: np.ndarray
    prints: np.ndarray
    posting: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        values = _blocks(self.prints)
        self.posting = values.T[:, None, :] == np.arange(16)[None, :, None]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) within the radius; the blocks find all of them."""
        values = _blocks(prints)
        hit = np.zeros((len(prints), len(self.items)), bool)
        for b in range(values.shape[1]):
            hit |= self.posting[b, values[:, b]]
        window, item = np.nonzero(hit)
        near = (prints[window] != self.prints[item]).sum(axis=1) <= RADIUS
        return window[near], item[near]


@dataclass
class Benchmark:
    """Shingles and fingerprints of a bounded set of items; size is in shingles."""

    ids: list[int]
    shingles: list[np.ndarray]
    sizes: np.ndarray = field(init=False)
    by_size: dict[int, SizeIndex] = field(init=False)

    def __post_init__(self) -> None:
        self.sizes = np.array([len(s) for s in self.shingles])
        prints = np.array([(shingle_bits(s).sum(axis=0, dtype=np.int64) >= 0) for s in self.shingles]).reshape(-1, BITS)
        self.by_size = {int(m): SizeIndex(np.flatnonzero(self.sizes == m), prints[self.sizes == m].astype(np.int64))
                        for m in np.unique(self.sizes)}
        pairs = sorted({(int(x), int(m)) for s, m in zip(self.shingles, self.sizes) for x in s})
        self.keys = np.array([x for x, _ in pairs], np.uint64)
        self.key_size = np.array([m for _, m in pairs], np.int64)
        self.known = np.zeros(_FILTER, bool)
        self.known[(self.keys & np.uint64(_FILTER - 1)).astype(np.int64)] = True

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item size) of every shingle that an item of that size has."""
        place = np.flatnonzero(self.known[(shingles & np.uint64(_FILTER - 1)).astype(np.int64)])
        low = np.searchsorted(self.keys, shingles[place], "left")
        count = np.searchsorted(self.keys, shingles[place], "right") - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(place, count), self.key_size[at]

    def matches(self, texts: Texts, similarity: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item, first shingle, shingles, similarity) of the best window of each pair."""
        shingles, first = texts.shingles(WORDS)
        place, size = self.hits(shingles)
        text = np.searchsorted(first, place, "right") - 1
        groups: dict[tuple[int, int], list[int]] = defaultdict(list)
        for d, m, p in zip(text.tolist(), size.tolist(), place.tolist()):
            groups[d, m].append(p - int(first[d]))
        for (d, m), hit in groups.items():
            own = shingles[first[d]:first[d + 1]]
            length = min(m, len(own))
            near = np.unique(np.concatenate([np.arange(p - length + 1, p + 1) for p in hit]))
            starts = near[(near >= 0) & (near <= len(own) - length)]
            yield from ((d, *found) for found in self._windows(own, starts, length, m, similarity))

    def _windows(self, own: np.ndarray, starts: np.ndarray, length: int, size: int,
                 similarity: float) -> Iterator[tuple[int, int, int, float]]:
        low, high = int(starts[0]), int(starts[-1]) + length
        part, starts = own[low:high], starts - low
        sums = np.zeros((len(part) + 1, BITS), np.int32)
        np.cumsum(shingle_bits(part), axis=0, out=sums[1:])
        index = self.by_size[size]
        prints = (sums[starts + length] - sums[starts] >= 0).astype(np.int64)
        window, item = index.candidates(prints)
        for k in np.unique(item):
            kinds, counts = np.unique(self.shingles[index.items[k]], return_counts=True)
            at = np.minimum(np.searchsorted(kinds, part), len(kinds) - 1)
            seen = np.zeros((len(part) + 1, len(kinds)), np.int32)
            seen[1:][np.arange(len(part)), at] = kinds[at] == part
            np.cumsum(seen, axis=0, out=seen)
            begin = starts[window[item == k]]
            shared = np.minimum(seen[begin + length] - seen[begin], counts).sum(axis=1)
            like = shared / (length + size - shared)
            best = int(like.argmax())
            if like[best] >= similarity:
                yield int(index.items[k]), low + int(begin[best]), length, float(like[best])


def contaminated(docs: DataFrame, items: DataFrame, *, similarity: float = 0.8, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start_word, n_words, similarity.

    A document holds an item when one of its windows of the item's length in words has a weighted
    Jaccard similarity (five-word shingles with their counts) of at least ``similarity``; the
    row has the best window, the first of equals.  Windows that hold some shingle of an item of
    their size (others have similarity 0) get a 128-bit SimHash; a lookup by 33 blocks of
    its bits finds all items of that size within Hamming distance 32 (a pair at 0.8 lies within
    it with probability 0.999), and exact similarity decides.

    A document shorter than an item is one window.  A text of one to four words has its
    word sequence as only shingle, so an item that short is found in equal texts only.
    Null, blank and empty texts hold nothing and are found nowhere.  Rows that repeat an id
    give a row each; other columns are not used.

    The items are read to the driver in parts of about 8 MB of text, each of which is held against
    all documents in one pass without a shuffle.
    """
    parts = []
    bench = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where(
        "text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(-(-total // PASS_BYTES), 1)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for k in range(passes):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).distinct().collect()
        parts.append(_one_pass(own, [(r["item_id"], r["text"]) for r in rows], similarity))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _one_pass(docs: DataFrame, rows: list[tuple[int, str]], similarity: float) -> DataFrame:
    shingles: list[np.ndarray] = []
    if rows:
        flat, first = read_words(*text_bytes(pa.array([t for _, t in rows], pa.string()))).shingles(WORDS)
        shingles = [flat[a:b] for a, b in zip(first, first[1:])]
    full = [(i, s) for (i, _), s in zip(rows, shingles, strict=True) if len(s)]
    frozen = docs.sparkSession.sparkContext.broadcast(Benchmark([i for i, _ in full], [s for _, s in full]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        bench = frozen.value
        for batch in batches:
            found = []
            for at, _, texts in each_block(batch, "text"):
                words = np.diff(texts.first)
                for d, item, start, length, like in bench.matches(texts, similarity):
                    n = min(length + WORDS - 1, int(words[d]))
                    found.append((at + d, bench.ids[item], start, n, like))
            if found:
                row, item, start, n, like = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64()), pa.array(start, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(like, pa.float64())],
                    ["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return docs.mapInArrow(run, "doc_id long, item_id long, start_word long, n_words long, similarity double")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns stay as they are.

    A row with a null id cannot be told from others of its kind and stays.
    """
    found = stored(contaminated(docs, items, **options).select("doc_id").distinct(), "contaminated")
    return join_ids(docs, found, "left_anti").select(*docs.columns)
