"""Token ids in compressed blocks: a static range asymmetric numeral system.

One frequency table, counted over the whole corpus, serves all blocks.  A block holds whole
documents and is coded by 64 interleaved lanes; id j belongs to lane j % 64.  Blocks do not
depend on each other: each starts with the state of its lanes (a checkpoint from which it can be
decoded) and carries the CRC-32 of its ids.

Bytes of a block, little-endian: magic ``RNS1``, ids (u32), words (u32), CRC-32 of the ids as
u32 (u32), states of the lanes (64 x u64), words (u32 each) in the order the decoder takes them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutelage.llm.tokens import flat_ids, token_table, tokenizer, with_offsets
from tutelage.session import discard, shared_dir, stored

LANES = 64
BITS = 20            # frequencies add up to 2**BITS
BLOCK_IDS = 1 << 16  # a block ends with the document that reaches this
GROUP = 48           # blocks that are coded side by side
MAGIC = b"RNS1"
_HEAD = struct.Struct("<4sIII")
_LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
_WORD = np.uint64(32)
_M = np.uint64(BITS)


@dataclass
class Frequencies:
    """Shares of the ids in 2**BITS; the padding id 0 always has one."""

    share: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, counts: dict[int, int]) -> Frequencies:
        seen = dict(counts)
        seen[0] = max(seen.get(0, 0), 1)
        ids = np.array(sorted(seen))
        if len(ids) > 1 << BITS:
            raise ValueError(f"more than 2**{BITS} different ids")
        total, room = sum(seen.values()), (1 << BITS) - len(ids)
        share = np.zeros(int(ids[-1]) + 1, np.uint64)
        share[ids] = [1 + seen[i] * room // total for i in ids.tolist()]
        share[share.argmax()] += np.uint64((1 << BITS) - int(share.sum()))
        return cls(share, np.cumsum(share) - share)

    def symbols(self) -> np.ndarray:
        """The id of each of the 2**BITS slots."""
        return np.repeat(np.arange(len(self.share), dtype=np.uint32), self.share.astype(np.int64))


def _order(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks by falling length, their steps, and how many are still active in each step."""
    order = np.argsort(-sizes, kind="stable")
    steps = -(-sizes[order] // LANES)
    active = np.searchsorted(-steps, -np.arange(steps[0] if len(steps) else 0), "left")
    return order, steps, active


def encode_blocks(blocks: list[np.ndarray], table: Frequencies) -> list[bytes]:
    """The bytes of each block of ids."""
    sizes = np.array([len(b) for b in blocks], np.int64)
    order, steps, active = _order(sizes)
    rows, width = len(active), len(blocks) * LANES
    ids = np.zeros((rows, width), np.uint32)
    for g, b in enumerate(order):
        padded = np.zeros(steps[g] * LANES, np.uint32)
        padded[:sizes[b]] = blocks[b]
        ids[:steps[g], g * LANES:(g + 1) * LANES] = padded.reshape(-1, LANES)
    state = np.full(width, _LOW)
    words = np.zeros((rows, width), np.uint32)
    given = np.zeros((rows, width), bool)
    for t in range(rows - 1, -1, -1):
        n = active[t] * LANES
        x, share = state[:n], table.share[ids[t, :n]]
        full = x >= share << np.uint64(63 - BITS)
        words[t, :n] = x
        given[t, :n] = full
        x = np.where(full, x >> _WORD, x)
        whole = x // share
        state[:n] = (whole << _M) + (x - whole * share) + table.before[ids[t, :n]]
    out: list[bytes] = [b""] * len(blocks)
    for g, b in enumerate(order):
        lanes = slice(g * LANES, (g + 1) * LANES)
        own = words[:, lanes][given[:, lanes]]
        crc = zlib.crc32(blocks[b].astype("<u4"))
        out[b] = (_HEAD.pack(MAGIC, sizes[b], len(own), crc) + state[lanes].astype("<u8").tobytes()
                  + own.astype("<u4").tobytes())
    return out


def decode_blocks(payloads: list[bytes], table: Frequencies, symbols: np.ndarray) -> list[np.ndarray]:
    """The ids of each block; raises where the magic or the checksum does not fit."""
    heads = [_HEAD.unpack_from(p) for p in payloads]
    if any(h[0] != MAGIC for h in heads):
        raise ValueError("not a block of this format")
    sizes = np.array([h[1] for h in heads], np.int64)
    order, steps, active = _order(sizes)
    body = _HEAD.size + 8 * LANES
    state = np.concatenate([np.frombuffer(payloads[b], "<u8", LANES, _HEAD.size) for b in order]).astype(np.uint64)
    words = np.concatenate([*(np.frombuffer(payloads[b], "<u4", heads[b][2], body) for b in order),
                            np.zeros(1, np.uint32)]).astype(np.uint64)
    counts = np.array([heads[b][2] for b in order], np.int64)
    at = np.cumsum(counts) - counts
    ids = np.zeros((len(active), len(payloads) * LANES), np.uint32)
    mask = np.uint64((1 << BITS) - 1)
    for t, blocks in enumerate(active):
        n = blocks * LANES
        x = state[:n]
        slot = x & mask
        s = symbols[slot]
        ids[t, :n] = s
        x = table.share[s] * (x >> _M) + slot - table.before[s]
        short = (x < _LOW).reshape(blocks, LANES)
        rank = np.cumsum(short, axis=1)
        place = (at[:blocks, None] + rank - 1)[short]
        x[short.ravel()] = (x[short.ravel()] << _WORD) | words[place]
        at[:blocks] += rank[:, -1]
        state[:n] = x
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(payloads)
    for g, b in enumerate(order):
        own = ids[:steps[g], g * LANES:(g + 1) * LANES].ravel()[:sizes[b]]
        ended = state[g * LANES:(g + 1) * LANES] == _LOW
        if not ended.all() or zlib.crc32(own.astype("<u4")) != heads[b][3]:
            raise ValueError("the words of a block do not fit its checksum and first states")
        out[b] = own
    return out


def count_ids(table: DataFrame, tokenizer_path: str) -> dict[int, int]:
    """How often each id occurs in a token table; at most a vocabulary of rows comes back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(tokenizer_path)
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            found = np.bincount(flat_ids(batch.column("ids"), coder.dtype.itemsize)[0])
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[:len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    rows = table.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = 0,
              id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents in ascending id order as ``folder``/blocks and /shares.

    ``blocks`` (Parquet, one row a block): first_id, the ids of all blocks before; n_ids;
    doc_ids and doc_tokens of its documents in order; payload, the block's bytes.  ``shares``: id and
    share of the frequency table.  Spark commits each task's file as a whole, so a lost executor
    costs the repetition of its tasks.

    The texts are dealt by ranges of id (a hash of the text splits an id that repeats without
    bound) and sorted, encoded once and their ids written; counts and offsets come from that
    table, which is deleted at the end.  Null texts are empty; null ids come first.
    """
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("salt", F.xxhash64("text"))
        .repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt"))
    table = stored(token_table(ordered, tokenizer_path, end_id=end_id), "tokens", compression="zstd")
    shares = Frequencies.of(count_ids(table, tokenizer_path))
    spark = docs.sparkSession
    frozen = spark.sparkContext.broadcast(shares)  # one number an id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = tokenizer(tokenizer_path).dtype.itemsize
        waiting: list[tuple[int, list[int | None], list[int], np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            coded = encode_blocks([w[3] for w in waiting], frozen.value)
            return pa.RecordBatch.from_arrays([
                pa.array([w[0] for w in waiting], pa.int64()), pa.array([len(w[3]) for w in waiting], pa.int64()),
                pa.array([w[1] for w in waiting], pa.list_(pa.int64())),
                pa.array([w[2] for w in waiting], pa.list_(pa.int64())), pa.array(coded, pa.binary()),
            ], ["first_id", "n_ids", "doc_ids", "doc_tokens", "payload"])

        for batch in batches:
            ids, edges = flat_ids(batch.column("ids"), width)
            start, names = batch.column("start").to_numpy(), batch.column("doc_id").to_pylist()
            size = np.diff(edges)
            at = 0
            while at < len(size):
                # to the document that fills the block, or to where the line of ids breaks off
                last = int(np.searchsorted(edges, edges[at] + BLOCK_IDS, "left"))
                gap = np.flatnonzero(start[at + 1:last] != (start + size)[at:last - 1][:len(start[at + 1:last])])
                last = min(at + 1 + int(gap[0]) if len(gap) else max(last, at + 1), len(size))
                waiting.append((int(start[at]), names[at:last], size[at:last].tolist(), ids[edges[at]:edges[last]]))
                at = last
                if len(waiting) == GROUP:
                    yield flush()
                    waiting = []
            if waiting:
                yield flush()
                waiting = []

    with_offsets(table).select("doc_id", "start", "ids").mapInArrow(
        run, "first_id long, n_ids long, doc_ids array<long>, doc_tokens array<long>, payload binary",
    ).write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(shares.share) if f], "id long, share long").coalesce(
        1).write.parquet(f"{folder}/shares")
    discard(table)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in files of ``write_ids``.

    ``start`` is the ids of all documents before, ``ids`` are little-endian unsigned 32 bit.  Each
    block is decoded and checked on its own, so blocks may be read by any tasks in any order.
    """
    rows = spark.read.parquet(f"{folder}/shares").collect()  # at most a vocabulary
    share = np.zeros(max(r["id"] for r in rows) + 1, np.uint64)
    for r in rows:
        share[r["id"]] = r["share"]
    frozen = spark.sparkContext.broadcast(Frequencies(share, np.cumsum(share) - share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = frozen.value.symbols()
        for batch in batches:
            for at in range(0, len(batch), GROUP):
                own = batch.slice(at, GROUP)
                ids = np.concatenate(decode_blocks(own.column("payload").to_pylist(), frozen.value, symbols))
                size = own.column("doc_tokens").flatten().to_numpy()
                per = own.column("doc_tokens").value_lengths().to_numpy()
                total = np.cumsum(size) - size
                opening = np.cumsum(per) - per
                start = total + np.repeat(own.column("first_id").to_numpy() - total[opening], per)
                edges = np.concatenate([[0], np.cumsum(size) * 4]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    own.column("doc_ids").flatten(), pa.array(start), pa.array(size),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [
                        None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])

    return spark.read.parquet(f"{folder}/blocks").select("first_id", "doc_ids", "doc_tokens", "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, *, folder: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` into a folder (a fresh shared one) and read them back."""
    folder = folder or shared_dir(docs.sparkSession, "ids")
    write_ids(docs, folder, tokenizer_path)
    return read_ids(docs.sparkSession, folder)
