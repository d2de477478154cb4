"""Token ids of whole texts by the tokenizers library, which meets each distinct piece once.

Texts are cut into pieces where a byte-level tokenizer always starts a new pre-token, the
distinct pieces that are not yet known are encoded by the library, and the ids of a text are put
together with numpy from those of its pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutelage.llm.words import hash_words, text_bytes
from tutelage.llm.worker import kept
from tutelage.session import stored

#: Distinct pieces whose ids a worker process keeps before it starts anew; a single block of
#: text has fewer than the table has places.
KEPT_PIECES = 1_500_000
TABLE = 1 << 23
#: Bytes of text that are cut at a time; a longer text is cut alone.
BLOCK = 2 << 20
#: Rows of a token table that are put together at a time.
ROWS = 1000

_B = np.arange(256)
_BLANK = (_B == 32) | ((_B >= 9) & (_B <= 13))
_LETTER = ((_B | 32) >= 97) & ((_B | 32) <= 122) & (_B < 128)
_PUNCT = (_B > 32) & (_B < 127) & ~_LETTER & ~((_B >= 48) & (_B <= 57))
_ODD = (_B >= 28) & (_B <= 31)  # blanks for some libraries only
_THREE = (_B == 0x80) | (_B == 0x81) | (_B == 0x9A)  # middle bytes of longer blanks


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class PieceTokenizer:
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    For byte-level BPE without normaliser and with the usual pre-token pattern, whose only
    look-ahead is in runs of blanks.  Cuts are made before a run of blanks and between an ASCII
    letter and ASCII punctuation; a text that holds the string of a special token is encoded
    whole.  Pieces are known by two independent 64-bit hashes.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.line = self._ids(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        self.table = np.full(TABLE, -1, np.int32)   # open addressing: hash -> number of a piece
        self.keys = np.zeros((0, 2), np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype)
                for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each known piece (a row of two hashes), -1 for others."""
        out = np.full(len(hashes), -1, np.int64)
        rest = np.arange(len(hashes))
        at = (hashes[:, 0] & np.uint64(TABLE - 1)).astype(np.int64)
        while len(rest):
            number = self.table[at]
            taken = number >= 0
            rest, at, number = rest[taken], at[taken], number[taken]
            right = (self.keys[number] == hashes[rest]).all(axis=1)
            out[rest[right]] = number[right]
            rest, at = rest[~right], (at[~right] + 1) & (TABLE - 1)
        return out

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        number = np.arange(len(self.keys), len(self.keys) + len(hashes), dtype=np.int32)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids])
        self.keys = np.concatenate([self.keys, hashes])
        at = (hashes[:, 0] & np.uint64(TABLE - 1)).astype(np.int64)
        while len(number):
            free = self.table[at] < 0
            self.table[at[free]] = number[free]
            left = self.table[at] != number
            number, at = number[left], (at[left] + 1) & (TABLE - 1)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has.

        Pieces without blanks but a leading space are encoded many at a time, a line each: a
        line end after such a piece is always a token of its own.
        """
        sizes = ends - starts
        at = _ragged(starts, sizes + 1)
        lines = np.where(at < len(data), data[np.minimum(at, len(data) - 1)], 10).astype(np.uint8)
        stops = np.cumsum(sizes + 1)
        lines[stops - 1] = 10
        odd = (_BLANK | _ODD | _THREE)[lines] | (lines == 0xC2)
        odd[stops - 1] = False
        odd[(stops - sizes - 1)[lines[stops - sizes - 1] == 32]] = False
        plain = (np.add.reduceat(odd, stops - sizes - 1) == 0) & ((sizes > 1) | (data[starts] != 32))
        counts = np.zeros(len(sizes), np.int64)
        parts: list[np.ndarray] = []
        order: list[np.ndarray] = []
        easy = np.flatnonzero(plain)
        if len(easy) and len(self.line) == 1:
            text = lines[_ragged((stops - sizes - 1)[easy], sizes[easy] + 1)].tobytes()
            cuts = np.concatenate([[0], np.cumsum(sizes[easy] + 1)])[[*range(0, len(easy), 200), len(easy)]].tolist()
            ids = np.concatenate(self._ids([text[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]))
            ends_at = np.flatnonzero(ids == self.line[0])
            if len(ends_at) == len(easy):
                counts[easy] = np.diff(ends_at, prepend=-1) - 1
                parts.append(np.delete(ids, ends_at))
                order.append(easy)
            else:
                plain[:] = False
        hard = np.flatnonzero(~plain)
        if len(hard):
            raw = data.tobytes()
            own = self._ids([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[hard].tolist(), ends[hard].tolist())])
            counts[hard] = list(map(len, own))
            parts += own
            order.append(hard)
        order_ = np.concatenate(order)
        flat = np.concatenate(parts)
        begin = np.zeros(len(sizes), np.int64)
        begin[order_] = np.cumsum(counts[order_]) - counts[order_]
        return flat[_ragged(begin, counts)], counts

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each piece; unknown ones are encoded and kept."""
        hashes = np.stack([hash_words(data, starts, ends), hash_words(data, starts, ends, seed=1)], axis=1)
        found = self._find(hashes)
        missing = np.flatnonzero(found < 0)
        while len(missing):
            kinds, first = np.unique(hashes[missing, 0], return_index=True)
            if len(self.keys) and len(self.keys) + len(kinds) > KEPT_PIECES:
                self._forget()
                return self._places(data, starts, ends)
            first = missing[first]
            self._keep(hashes[first], *self._encode(data, starts[first], ends[first]))
            found[missing] = self._find(hashes[missing])
            missing = missing[found[missing] < 0]  # other pieces of the same first hash
        return found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin; a null is an empty text."""
        data, offsets = text_bytes(column)
        parts, counts = [], []
        first, n = 0, len(offsets) - 1
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1
            last = min(max(last, first + 1), n)
            low = int(offsets[first])
            ids, count = self._block(data[low:int(offsets[last])], offsets[first:last + 1] - low)
            parts.append(ids)
            counts.append(count)
            first = last
        return (np.concatenate([*parts, np.zeros(0, self.dtype)]),
                np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.zeros(0, np.int64)]))]))

    def _block(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(data)
        cut = np.zeros(size, bool)
        if size > 1:
            now, before = data[1:], data[:-1]
            earlier = np.concatenate([[0], data[:-2]])
            blank_before = (_BLANK | _ODD)[before] | ((before >= 0x80) & (_THREE[earlier] | (earlier == 0xC2)))
            cut[1:] = (_BLANK[now] & ~blank_before) | (_PUNCT[now] & _LETTER[before])
        raw = data.tobytes()
        whole = sorted({int(np.searchsorted(edges, m, "right")) - 1 for s in self.special for m in _found(raw, s)})
        for d in whole:
            cut[edges[d]:edges[d + 1]] = False
        cut[edges[:-1][edges[:-1] < size]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], size)
        places = self._places(data, starts, ends)
        sizes = self.size[places]
        pieces = np.searchsorted(starts, edges)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[_ragged(self.at[places], sizes)], np.diff(total[pieces])


def _found(raw: bytes, part: bytes) -> list[int]:
    out, at = [], raw.find(part)
    while at >= 0:
        out.append(at)
        at = raw.find(part, at + 1)
    return out


def tokenizer(path: str) -> PieceTokenizer:
    """The tokenizer of this worker process, loaded once."""
    return kept(("tokenizer", path), lambda: PieceTokenizer(path))


def token_table(docs: DataFrame, path: str, *, end_id: int = 0) -> DataFrame:
    """(part, doc_id, before, n_tokens, ids) of ``docs`` (doc_id, text), row by row in order.

    ``ids`` are the text's ids and the end id, little-endian, 2 bytes each if the vocabulary fits
    in that, else 4.  ``part`` is the partition and ``before`` the ids of its earlier rows: with
    the totals of the parts they give global offsets.  Write the result before using it twice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder = tokenizer(path)
        before = 0
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                own = batch.slice(at, ROWS)
                ids, first = coder.encode(own.column("text"))
                size = np.diff(first) + 1
                ends = np.cumsum(size)
                full = np.full(ends[-1], end_id, coder.dtype)
                inside = np.ones(len(full), bool)
                inside[ends - 1] = False
                full[inside] = ids
                edges = np.concatenate([[0], ends * coder.dtype.itemsize])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(own), part, np.int64)), own.column("doc_id"),
                    pa.array(before + ends - size), pa.array(size),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [
                        None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(full)]).cast(pa.binary()),
                ], ["part", "doc_id", "before", "n_tokens", "ids"])
                before += int(ends[-1])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "part long, doc_id long, before long, n_tokens long, ids binary")


def with_offsets(table: DataFrame) -> DataFrame:
    """A written token table with ``start``: the ids of all rows before, over all parts.

    Second pass of the prefix sums: one total a part, summed in order of the parts.  The totals
    are written, so Spark sees how small they are before it chooses the join.
    """
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = stored(totals.selectExpr("part", "sum(total) over (order by part) - total as base"), "totals")
    return table.join(base, "part").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def flat_ids(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of id bytes in a row, and where each row's begin."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    own = data[edges[0]:edges[-1]]
    return np.frombuffer(own.tobytes(), f"<u{width}"), (edges - edges[0]) // width
