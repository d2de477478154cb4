"""Language of a text by prediction by partial matching over bytes, A-Z lower-cased.

For each language a context tree holds the bytes seen after every context of up to ORDER
bytes.  A byte seen c times in a context of total t with q different bytes costs
-log2(c / (t + q)) bits, an unseen one costs the escape -log2(q / (t + q)) and is coded in the
next shorter context among the bytes not yet ruled out, at last evenly among all 256.
The statistics are frozen after training, so the costs of all (context, byte) pairs are
worked out once and a text's exact code length is a sum of table entries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutelage.llm.setup import join_ids
from tutelage.llm.words import lowered, text_bytes
from tutelage.llm.worker import kept
from tutelage.session import discard, stored

ORDER = 4
#: The classifier is fitted on at most so many labelled rows of each language, whole texts.
TRAIN_ROWS = 400
#: Contexts seen less often than this in every language stay leaves of a shorter one.
MIN_CONTEXT = 24
#: Contexts whose costs are worked out together.
NODES_AT_ONCE = 2048
#: Bytes of text that are coded at a time.
STEP_BYTES = 1 << 18
#: More labels than this are taken for a wrong column.
MAX_LANGS = 500
UNKNOWN = "und"


@dataclass
class Model:
    """Context trees of all languages over one set of nodes.

    ``child[node, byte]`` is the node of the context longer by that earlier byte, 0 if none;
    ``cost[node, byte]`` the bits of a byte in it, per language.
    """

    langs: list[str]
    child: np.ndarray
    cost: np.ndarray

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text (rows) under each language (columns)."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        order = ORDER
        for first, last in _ranges(offsets):
            low, high = int(offsets[first]), int(offsets[last])
            for at in range(low, high, STEP_BYTES):  # a longer text in several steps
                stop = min(at + STEP_BYTES, high)
                edges = np.clip(offsets[first:last + 1], at, stop)
                back = max(low, at - order)
                part = lowered(data[back:stop]).astype(np.int32)
                room = (np.arange(at, stop) - np.repeat(offsets[first:last], np.diff(edges)))
                node = np.zeros(stop - at, np.int32)
                alive = np.ones(stop - at, bool)
                for k in range(1, order + 1):
                    earlier = np.zeros(stop - at, np.int32)
                    reach = at - back - k
                    if reach >= 0:
                        earlier = part[reach:len(part) - k]
                    else:
                        earlier[-reach:] = part[:max(len(part) - k, 0)]
                    step = self.child[node, earlier]
                    alive &= (room >= k) & (step > 0)
                    node = np.where(alive, step, node)
                costs = self.cost[node, part[at - back:]]
                full = np.flatnonzero(np.diff(edges))
                if len(full):
                    out[first + full] += np.add.reduceat(costs, edges[full] - at, axis=0, dtype=np.float64)
        return out


def _ranges(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + STEP_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def context_counts(texts: DataFrame) -> DataFrame:
    """(lang, k, gram, c): counts of each byte after each context of k bytes.

    ``gram`` packs the context and the byte, earliest first.  Counted per batch with numpy,
    then summed by Spark.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            data, offsets = text_bytes(batch.column("text"))
            for lang in sorted(set(langs)):
                rows = np.flatnonzero(langs == lang)
                for k in range(ORDER + 1):
                    parts = []
                    for d in rows:
                        own = lowered(data[offsets[d]:offsets[d + 1]]).astype(np.int64)
                        gram = np.zeros(len(own) - k if len(own) > k else 0, np.int64)
                        if not len(gram):
                            continue
                        for j in range(k + 1):
                            gram = (gram << 8) | own[j:len(own) - k + j]
                        parts.append(gram)
                    gram, c = np.unique(np.concatenate([*parts, np.zeros(0, np.int64)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), k)),
                         pa.array(gram), pa.array(c.astype(np.int64))], ["lang", "k", "gram", "c"])

    return (texts.mapInArrow(run, "lang string, k long, gram long, c long")
            .groupBy("lang", "k", "gram").agg(F.sum("c").alias("c")))


def training_rows(docs: DataFrame, most: int) -> DataFrame:
    """(lang, text) of at most ``most`` rows of each language, spread evenly by a hash of id.

    A first pass over ids and labels only counts the languages and draws about twice as many
    as needed; the ranks are taken among those.
    """
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = docs.groupBy("lang").agg(F.count("*").alias("total"))
    if counts.limit(MAX_LANGS + 1).count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} language labels")
    ids = docs.select("doc_id", "lang").join(F.broadcast(counts), "lang").where(
        drawn * F.col("total") < 2 * most).select("doc_id", "lang")
    ranked = ids.selectExpr(
        "doc_id", "lang", "row_number() over (partition by lang order by xxhash64(doc_id), doc_id) as r")
    # both hints hold at most MAX_LANGS rows, the second ``most`` ids for each
    chosen = ranked.where(F.col("r") <= most).select("doc_id").distinct()
    return docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> pa.Table:
    """Frozen statistics (lang, k, gram, c) of ``docs`` (doc_id, text, lang; labelled rows only).

    Spark counts and leaves out what follows a context that no language saw often.  A shorter context is seen at least as often as a longer one, so
    what an escape needs is never left out.
    """
    grams = stored(context_counts(training_rows(docs, most)), "grams")
    context = F.shiftright("gram", 8)
    seen = grams.groupBy("lang", "k", context.alias("context")).agg(F.sum("c").alias("n"))
    often = seen.groupBy("k", "context").agg(F.max("n").alias("n")).where(
        (F.col("k") == 0) | (F.col("n") >= MIN_CONTEXT)).select("k", "context")
    rows = grams.withColumn("context", context).join(often, ["k", "context"]).select("lang", "k", "gram", "c").toArrow()
    discard(grams)
    spoken = rows.column("lang").combine_chunks().dictionary_encode()
    return rows.set_column(0, "lang", spoken).combine_chunks()


def _model(rows: pa.Table) -> Model:
    """Trees and costs from the counts (lang, k, gram, c) of the kept contexts."""
    spoken = rows.column("lang").combine_chunks()
    if isinstance(spoken, pa.ChunkedArray):
        spoken = spoken.combine_chunks()
    names = spoken.dictionary.to_pylist()
    langs = sorted(names)
    tongue = np.array([langs.index(x) for x in names], np.int64)[spoken.indices.to_numpy()] if names else np.zeros(0, np.int64)
    k, gram, c = (rows.column(x).to_numpy() for x in ("k", "gram", "c"))
    # one number for a context and its length: at most ORDER bytes below the length
    name = (k << (8 * ORDER)) | (gram >> 8)
    nodes = np.unique(np.append(name, 0))
    at = np.searchsorted(nodes, name)
    length, packed = nodes >> (8 * ORDER), nodes & ((1 << (8 * ORDER)) - 1)
    # the parent lacks the earliest byte, which is the upper one of the packed context
    top = 8 * np.maximum(length - 1, 0)
    parent = np.searchsorted(nodes, (np.maximum(length - 1, 0) << (8 * ORDER)) | (packed & ((1 << top) - 1)))
    child = np.zeros((len(nodes), 256), np.int32)
    deep = np.flatnonzero(length)
    child[parent[deep], packed[deep] >> top[deep]] = deep
    cost = np.empty((len(nodes), 256, len(langs)), np.float32)
    for j in range(len(langs)):
        own = tongue == j
        counts = np.zeros((len(nodes), 256), np.float32)
        counts[at[own], gram[own] & 255] = c[own]
        for low in range(0, len(nodes), NODES_AT_ONCE):
            some = np.arange(low, min(low + NODES_AT_ONCE, len(nodes)))
            cost[some, :, j] = _costs(counts, some, length, parent)
    return Model(langs, child, cost)


def _costs(counts: np.ndarray, nodes: np.ndarray, length: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Bits of each byte in some contexts, by escapes down to the empty one, with exclusion."""
    out = np.zeros((len(nodes), 256))
    coded = np.zeros((len(nodes), 256), bool)
    spent = np.zeros(len(nodes))
    rows = np.arange(len(nodes))  # those that have not yet left the empty context
    here = nodes
    while len(rows):
        c = np.where(coded[rows], 0.0, counts[here])
        kinds, total = (c > 0).sum(axis=1), c.sum(axis=1, dtype=np.float64)
        both = np.maximum(total + kinds, 1)
        place, byte = np.nonzero(c)
        out[rows[place], byte] = spent[rows[place]] - np.log2(c[place, byte] / both[place])
        coded[rows[place], byte] = True
        spent[rows] -= np.log2(np.where(kinds > 0, kinds / both, 1.0))
        further = length[here] > 0
        rows, here = rows[further], parent[here[further]]
    left = 256 - coded.sum(axis=1)
    rest = spent + np.log2(np.maximum(left, 1))
    return np.where(coded, out, rest[:, None])


def identify(docs: DataFrame, *, held_out: str = "crc32(cast(doc_id as string)) % 3 = 1",
             most: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits_per_byte.

    Learns from text and lang of rows where ``held_out`` is false and both are given, at most
    ``most`` rows a language (whole texts); predicts every whole text from its bytes alone.
    ``score`` is the share of the predicted language in 2**-bits over all languages;
    equal code lengths go to the first language in alphabetical order.  A text that is null
    or has no letter is ``und`` with score 0; so is every text when nothing could be learned.
    A null doc_id counts as not held out and is not learned from.  Further columns of
    ``docs`` are not returned; rows that repeat an id are predicted one by one.
    """
    spark = docs.sparkSession
    rows = train(docs.where(f"not ({held_out})").where("text is not null and lang is not null")
                 .select("doc_id", "text", "lang"), most)
    frozen = spark.sparkContext.broadcast(rows)  # bounded: they follow from the bounded sample
    mark = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the counts are sent, a twentieth of the model's size
        trees = kept(("language", mark), lambda: _model(frozen.value))
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            known = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            size = np.diff(offsets)
            if trees.langs:
                bits = trees.bits(data, offsets)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1, initial=np.inf)
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                pred = np.array([*trees.langs, UNKNOWN], object)[np.where(known, best, len(trees.langs))]
            else:
                least = np.zeros(len(size))
                share, pred = np.zeros(len(size)), np.full(len(size), UNKNOWN, object)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()),
                pa.array(np.where(known, share, 0.0)),
                pa.array(np.where(known, least / np.maximum(size, 1), 0.0)),
            ], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    ).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def with_language(docs: DataFrame, *, shortest: int = 100, **options) -> DataFrame:
    """``docs`` without the documents whose language cannot be told; all columns stay.

    Rejected are texts that are null or have no letter, and texts of ``shortest`` bytes or more
    that no learned language codes below the 8 bits a byte that they take as they are.
    """
    hopeless = stored(
        identify(docs, **options).where((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") >= 8))
        .select("doc_id").distinct(), "rejected")
    tried = docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    long = tried.where(F.octet_length("text") >= shortest).transform(join_ids, hopeless, "left_anti")
    return long.union(tried.where(F.octet_length("text") < shortest).select(*long.columns)).select(*docs.columns)
