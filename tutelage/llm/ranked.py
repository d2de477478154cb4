"""Ranked lexical search: one term after another, rarest first, with limited accumulators.

A first pass over the texts writes, for every document, the part of an index that a set of items
needs: its number of terms and the counts of those terms that some item has.  The corpus
statistics follow from that table.  In the second pass every task inverts the rows it reads and
goes through the terms of each item, rarest first.  A document gets an accumulator when a term
meets it, until what the remaining terms could add at most is below the k-th best partial score;
from then on no accumulator is made, and those that can still reach the k-th score are brought
up to date exactly.  The k-th score of earlier rows of the task is carried along, so later rows
start with a high bar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutelage.llm.words import each_block, read_words, text_bytes
from tutelage.session import discard, stored

#: Bytes of item text that one pass over the documents answers.
PASS_BYTES = 4 << 20

_B = np.arange(256)
#: Bytes that part terms: ASCII other than digits and letters (fixed value).
_BETWEEN = (_B < 128) & ~((_B >= 48) & (_B <= 57)) & ~(((_B | 32) >= 97) & ((_B | 32) <= 122))


@dataclass
class Query:
    """An item: its distinct terms, rarest first, and what one unit of impact of each is worth."""

    item: int
    item_id: int | None
    terms: np.ndarray
    gain: np.ndarray


@dataclass
class Block:
    """Some documents inverted: the postings of term t lie from edges[t] to edges[t + 1]."""

    docs: np.ndarray
    impact: np.ndarray
    edges: np.ndarray
    most: np.ndarray
    n_docs: int

    @classmethod
    def of(cls, terms: np.ndarray, tf: np.ndarray, doc: np.ndarray, m: np.ndarray, n_terms: int) -> Block:
        """From postings in document order; ``m`` is the length norm of each document."""
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        order = np.argsort(terms, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=n_terms))])
        most = np.zeros(n_terms, np.int64)
        full = np.flatnonzero(np.diff(edges))
        if len(full):
            most[full] = np.maximum.reduceat(impact[order], edges[full])
        return cls(doc[order], impact[order], edges, most, len(m))


@dataclass
class Best:
    """The k best documents of an item so far, best first; a null id comes after all others."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    doc_id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    nameless: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def bar(self) -> int:
        """A document below this score cannot be among the k best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc_id: np.ndarray, nameless: np.ndarray) -> None:
        score, doc_id, nameless = (np.concatenate(x) for x in (
            (self.score, score), (self.doc_id, doc_id), (self.nameless, nameless)))
        order = np.lexsort((doc_id, nameless, -score))[:self.k]
        self.score, self.doc_id, self.nameless = score[order], doc_id[order], nameless[order]


def candidates(block: Block, query: Query, k: int, bar: int, sums: np.ndarray,
               made: np.ndarray) -> np.ndarray:
    """Documents of the block that hold an accumulator at the end, their exact scores in ``sums``.

    All documents with a score of at least ``bar`` that are among the block's k best, equal
    scores included, are in it.  ``sums`` and ``made`` are zero before; the caller clears them.
    """
    here = np.flatnonzero((block.edges[query.terms + 1] > block.edges[query.terms]) & (query.gain > 0))
    bounds = query.gain[here] * block.most[query.terms[here]]
    rest = np.cumsum(bounds[::-1])[::-1] - bounds
    creating = True
    for j, q in enumerate(here.tolist()):
        t, gain = query.terms[q], query.gain[q]
        low, high = block.edges[t], block.edges[t + 1]
        docs, add = block.docs[low:high], gain * block.impact[low:high]
        if not creating:
            known = made[docs]
            sums[docs[known]] += add[known]
            continue
        sums[docs] += add
        made[docs] = True
        live = np.flatnonzero(made)
        kth = bar
        if len(live) >= k:
            kth = max(bar, int(np.partition(sums[live], len(live) - k)[len(live) - k]))
        if rest[j] < kth:
            creating = False
            lost = live[sums[live] + rest[j] < kth]
            sums[lost] = 0
            made[lost] = False
    return np.flatnonzero(made)


def _index(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tf): a document's number of terms and its counts of the known ones.

    ``keys`` are the sorted hashes of the known terms; a term is its place among them.
    """
    frozen = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozen.value
        for batch in batches:
            for first, last, texts in each_block(batch, "text", _BETWEEN):
                size = np.diff(texts.first)
                at = np.searchsorted(known, texts.hashes)
                hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == texts.hashes) if len(known) else np.zeros(0, int)
                doc = np.repeat(np.arange(len(texts)), size)[hit]
                pairs, tf = np.unique(doc * max(len(known), 1) + at[hit], return_counts=True)
                doc, term = np.divmod(pairs, max(len(known), 1))
                edges = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, last - first), pa.array(size.astype(np.int64)),
                    pa.ListArray.from_arrays(edges, pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(edges, pa.array(tf.astype(np.int32))),
                ], ["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and edges of a list column."""
    edges = column.offsets.to_numpy()
    return column.values.to_numpy()[edges[0]:edges[-1]].astype(np.int64), edges - edges[0]


def _top(index: DataFrame, queries: list[Query], n_terms: int, n_docs: int, length: int, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): the k best documents of each item in each task's rows."""
    frozen = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = frozen.value
        best = [Best(k) for _ in asked]
        for batch in batches:
            terms, edges = _flat(batch.column("terms"))
            tf, _ = _flat(batch.column("tf"))
            doc = np.repeat(np.arange(len(batch)), np.diff(edges))
            m = 75 + (25 * batch.column("n").to_numpy() * n_docs) // length
            nameless = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            block = Block.of(terms, tf, doc, m, n_terms)
            sums, made = np.zeros(len(batch), np.int64), np.zeros(len(batch), bool)
            for query, own in zip(asked, best, strict=True):
                found = candidates(block, query, k, own.bar(), sums, made)
                good = found[sums[found] >= own.bar()]
                if len(good):
                    own.add(sums[good], ids[good], nameless[good])
                sums[found] = 0
                made[found] = False
        sizes = [len(b.score) for b in best]
        of = np.repeat(np.arange(len(asked)), sizes)
        if len(of):
            yield pa.RecordBatch.from_arrays([
                pa.array([q.item for q in asked], pa.int64()).take(pa.array(of)),
                pa.array([q.item_id for q in asked], pa.int64()).take(pa.array(of)),
                pa.array(np.concatenate([b.doc_id for b in best]), pa.int64(),
                         mask=np.concatenate([b.nameless for b in best])),
                pa.array(np.concatenate([b.score for b in best]), pa.int64()),
            ], ["item", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def _one_pass(docs: DataFrame, items: list[tuple[int, int | None, str]], k: int) -> DataFrame:
    words = read_words(*text_bytes(pa.array([t for _, _, t in items], pa.string())), _BETWEEN)
    keys, term = np.unique(words.hashes, return_inverse=True)
    index = stored(_index(docs, keys), "index")
    total = index.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    n_docs, length = total["n"], max(total["length"], 1)
    # at most one row a term of this pass
    held = index.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    weight = np.zeros(len(keys), np.int64)
    rarity = np.zeros(len(keys), np.int64)
    for t, df in held:
        weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        rarity[t] = df
    queries = []
    for i, (item, item_id, _) in enumerate(items):
        own, times = np.unique(term[words.first[i]:words.first[i + 1]], return_counts=True)
        order = np.lexsort((own, rarity[own]))
        queries.append(Query(item, item_id, own[order], (times * weight[own])[order]))
    best = stored(_top(index, queries, len(keys), n_docs, length, k), "best")
    discard(index)
    return best


def search(docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` best documents of each item, scores above 0.

    Terms are runs of digits, ASCII letters (A-Z lower-cased) and all characters beyond ASCII in
    whole texts.  A null, empty or term-less text has none: such a document counts nowhere and is
    found by nothing, such an item has no rows; with empty tables there are no rows.  Rows that
    repeat an id, of a document or an item, stand for themselves.  Equal scores go by ascending
    doc_id; a document with a null id comes after the others of its score.  Further columns are
    not used.

    Items are answered in passes of about 4 MB of item text: only one pass's items are on the
    driver and with the tasks, whatever the size of ``items``.  Documents are never shuffled; each
    task hands on at most ``k`` rows an item.  Terms are told apart by a 64-bit hash.
    """
    asked = stored(items.select(
        F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"),
    ).withColumn("item", F.monotonically_increasing_id()).withColumn("spread", F.rand(1)), "items")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(-(-total // PASS_BYTES), 1)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    best = None
    for p in range(passes):
        rows = asked.where(F.floor(F.col("spread") * passes) == p).select("item", "item_id", "text").collect()
        found = _one_pass(own, [tuple(r) for r in rows], k)
        best = found if best is None else best.union(found)
    return best.selectExpr(
        "item_id", "row_number() over (partition by item order by score desc, doc_id asc nulls last) as rank",
        "doc_id", "score").where(F.col("rank") <= k)
