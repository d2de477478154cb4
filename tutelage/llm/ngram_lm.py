"""Cross-entropy difference: two matched bigram models over one vocabulary score each document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutelage.llm.setup import join_ids
from tutelage.llm.words import each_block
from tutelage.session import stored

#: A word is known if it makes at least this share of all words, which at most 200,000 can; all
#: others are one unknown word.
WORD_SHARE = 5e-6
#: Word pairs of at least this share (at most 2,000,000) are sent to the tasks; the losses of all
#: rarer ones are joined.
PAIR_SHARE = 5e-7
DISCOUNT = 0.75
#: Losses are summed as whole multiples of this many bits, so their order does not matter.
UNIT = 2.0 ** -20


@dataclass
class Bigrams:
    """Interpolated bigram model with absolute discounting, one column per corpus.

    p(w | v) = (c(v, w) - D) / c(v) for a pair that was seen, plus what all seen pairs of v leave
    over times p(w); p(w) is add-one smoothed.  Both sum to one over the vocabulary and ``unknown``.
    """

    words: np.ndarray     # sorted hashes; a word's number is its place, unknown comes last
    single: np.ndarray    # p(w)
    context: np.ndarray   # c(v): how often v is followed
    left: np.ndarray      # what v leaves to p(w)
    pairs: np.ndarray     # sorted v * (len(words) + 1) + w of the frequent pairs
    losses: np.ndarray    # of those, in units

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray, context: np.ndarray, kinds: np.ndarray) -> Bigrams:
        """From word counts (unknown last), how often v is followed and by how many words."""
        single = (counts + 1) / (counts.sum(axis=0) + len(words) + 1)
        left = np.where(context > 0, DISCOUNT * kinds / np.maximum(context, 1), 1.0)
        return cls(words, single, context, left, np.zeros(0, np.int64), np.zeros((0, 2), np.int64))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, hashes)
        inside = at < len(self.words)
        found = np.zeros(len(hashes), bool)
        found[inside] = self.words[at[inside]] == hashes[inside]
        return np.where(found, at, len(self.words))

    def of_pairs(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Loss of the second word of each pair, from the pair's counts, in units."""
        before, now = np.divmod(keys, len(self.words) + 1)
        direct = np.maximum(counts - DISCOUNT, 0) / np.maximum(self.context[before], 1)
        return _units(direct + self.left[before] * self.single[now])

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key among the frequent pairs, and whether it is one of them."""
        at = np.searchsorted(self.pairs, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == keys[inside]
        return at, known


def _units(p: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(p) / UNIT).astype(np.int64)


def _opening(first: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[first[:-1][first[:-1] < n]] = True
    return out


def _sums(key: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
    kinds, back = np.unique(key, return_inverse=True)
    t = np.bincount(back, target, len(kinds)).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds.view(np.int64)), pa.array(t), pa.array(np.bincount(back, minlength=len(kinds)) - t)],
        ["key", "t", "b"])


def word_counts(marked: DataFrame) -> DataFrame:
    """(key, t, b): how often each word (its hash) occurs in target and in background."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("target").to_numpy(zero_copy_only=False)
            parts = [(x.hashes, np.repeat(own[a:b], np.diff(x.first))) for a, b, x in each_block(batch, "text")]
            yield _sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    return marked.mapInArrow(run, "key long, t long, b long").groupBy("key").agg(
        F.sum("t").alias("t"), F.sum("b").alias("b"))


def pair_counts(marked: DataFrame, words: np.ndarray) -> DataFrame:
    """(key, t, b) for each pair of following words of the vocabulary or unknown."""
    frozen = marked.sparkSession.sparkContext.broadcast(words)  # at most 1 / WORD_SHARE hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Bigrams(frozen.value, *[np.zeros(0)] * 5)
        n = len(frozen.value) + 1
        for batch in batches:
            own = batch.column("target").to_numpy(zero_copy_only=False)
            keys, marks = [], []
            for a, b, x in each_block(batch, "text"):
                number = model.numbers(x.hashes)
                place = np.flatnonzero(~_opening(x.first, len(number)))
                keys.append(number[place - 1] * n + number[place])
                marks.append(np.repeat(own[a:b], np.diff(x.first))[place])
            yield _sums(np.concatenate(keys).astype(np.int64), np.concatenate(marks))

    return marked.mapInArrow(run, "key long, t long, b long").groupBy("key").agg(
        F.sum("t").alias("t"), F.sum("b").alias("b"))


def _two(table: pa.Table, a: str = "t", b: str = "b") -> np.ndarray:
    return np.stack([table.column(x).to_numpy() for x in (a, b)], axis=1)


def fit(marked: DataFrame) -> tuple[Bigrams, DataFrame]:
    """Both models from all rows of ``marked`` (text, target), and the losses (key, t, b) of the
    pairs that are too rare to be sent to all tasks."""
    singles = stored(word_counts(marked), "words")
    totals = np.array([x or 0 for x in singles.agg(F.sum("t"), F.sum("b")).first()], np.int64)
    both = F.col("t") + F.col("b")
    known = singles.where(both >= F.lit(WORD_SHARE * float(totals.sum()))).toArrow()
    words = known.column("key").to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, counts = words[order], _two(known)[order]
    n = len(words) + 1
    pairs = stored(pair_counts(marked, words), "pairs")
    followed = pairs.groupBy(F.expr(f"key div {n}").alias("v")).agg(
        F.sum("t").alias("t"), F.sum("b").alias("b"), F.count_if(F.col("t") > 0).alias("kt"),
        F.count_if(F.col("b") > 0).alias("kb")).toArrow()
    context, kinds = np.zeros((n, 2)), np.zeros((n, 2))
    v = followed.column("v").to_numpy()
    context[v], kinds[v] = _two(followed), _two(followed, "kt", "kb")
    model = Bigrams.of(words, np.vstack([counts, totals - counts.sum(axis=0)]), context, kinds)

    least = F.lit(PAIR_SHARE * float(totals.sum()))
    frequent = pairs.where(both >= least).toArrow()
    keys = frequent.column("key").to_numpy()
    order = np.argsort(keys)
    losses = model.of_pairs(keys, _two(frequent))[order]
    frozen = marked.sparkSession.sparkContext.broadcast(model)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = frozen.value.of_pairs(batch.column("key").to_numpy(), _two(batch))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, own.T.copy())], ["key", "t", "b"])

    return replace(model, pairs=keys[order], losses=losses), pairs.where(both < least).mapInArrow(
        rare, "key long, t long, b long")


def _split(model: Bigrams, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text the losses that the tasks know, and (key, times) of its other pairs with their
    ends.  A word that opens a text has no context."""
    texts = len(first) - 1
    number = model.numbers(hashes)
    opening = _opening(first, len(number))
    units = np.zeros((len(number), 2), np.int64)
    units[opening] = _units(model.single[number[opening]])
    place = np.flatnonzero(~opening)
    keys = number[place - 1] * (len(model.words) + 1) + number[place]
    at, known = model.places(keys)
    units[place[known]] = model.losses[at[known]]
    sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(units, axis=0)])
    text = np.repeat(np.arange(texts), np.diff(first))[place[~known]]
    keys = keys[~known]
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(head)
    times = np.diff(np.append(begin, len(keys)))
    ends = np.searchsorted(text[begin], np.arange(texts + 1))
    return sums[first[1:]] - sums[first[:-1]], keys[begin], times, ends


def score(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, target_bits, background_bits, score.

    ``target`` (doc_id) names the documents of the target corpus; all others are background.  Both
    models have the same order, smoothing and vocabulary, counted over all documents, and keep
    every word pair.  The bits are mean losses per word, ``score`` their difference: the lower,
    the more a document is like the target.  Null, empty and blank texts have 0 words and null
    bits.  Rows that repeat an id are scored one by one; a null id is background.  With no
    target at all its model is uniform.  Other columns are not returned.

    The losses of frequent pairs are looked up where the text is read; a text's rare pairs are
    joined with the table of losses, in which no key has more than ``PAIR_SHARE`` of all rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    wanted = stored(wanted.withColumn("hit", F.lit(True)), "target")
    marked = join_ids(own, wanted, "left").select(
        "text", F.coalesce("hit", F.lit(False)).alias("target"))
    model, rare = fit(marked)
    frozen = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the shares above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in each_block(batch, "text"):
                units, keys, times, ends = _split(frozen.value, x.hashes, x.first)
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v.astype(np.int64)))
                         for v in (keys, times)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ("row", "doc_id")), pa.array(np.diff(x.first)),
                     *map(pa.array, units.T.copy()), *lists],
                    ["row", "doc_id", "n_words", "t", "b", "keys", "times"])

    read = stored(own.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        run, "row long, doc_id long, n_words long, t long, b long, keys array<long>, times array<long>"),
        "read", compression="zstd")
    joined = (
        read.select("row", F.explode(F.arrays_zip("keys", "times")).alias("p"))
        .select("row", F.col("p.keys").alias("key"), F.col("p.times").alias("times"))
        .join(rare, "key").select(
            "row", F.lit(None).cast("long"), F.lit(None).cast("long"), F.col("times") * F.col("t"),
            F.col("times") * F.col("b")))
    sums = read.select("row", "doc_id", "n_words", "t", "b").union(joined).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    mean = lambda c: F.when(F.col("n_words") > 0, F.col(c) * F.lit(UNIT) / F.col("n_words"))
    return sums.select("doc_id", "n_words", mean("t").alias("target_bits"), mean("b").alias("background_bits")).withColumn(
        "score", F.col("target_bits") - F.col("background_bits"))
