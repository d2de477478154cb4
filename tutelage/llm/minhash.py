"""Near-duplicate texts: one-permutation min-hashes, banded buckets, star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutelage.llm.components import connected_components
from tutelage.llm.setup import join_ids
from tutelage.llm.words import each_block, mix
from tutelage.llm.worker import free
from tutelage.session import discard, stored

BINS = 256      # of the one permutation; a power of two
ROWS = 6        # bins in a band: 42 bands, a pair at 0.8 is missed with probability 3e-6
SMALL = 8       # members of a bucket that are compared with each other, not with a centre
PART = 1 << 18  # shingles on each side of a comparison inside one task
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_DONORS: dict[int, np.ndarray] = {}


def _donors(bins: int) -> np.ndarray:
    """For each bin an order in which it tries the others for a value (row = attempt)."""
    if bins not in _DONORS:
        rank = mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(1 << 40))
        _DONORS[bins] = np.argsort(rank.reshape(bins, bins), axis=0)
    return _DONORS[bins]


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` min-hashes for each sorted set of 64-bit hashes.

    The upper bits of a hash choose its bin, so the first member of each bin is its
    minimum.  An empty bin takes the value of the first filled bin in an order of its own
    (optimal densification): two sets agree in a bin with probability equal to their Jaccard
    similarity, filled or not.
    """
    shift = np.uint64(64 - (bins.bit_length() - 1))
    out = np.full((len(sets), bins), _EMPTY)
    for row, values in zip(out, sets, strict=True):
        at = (values >> shift).astype(np.int64)
        head = np.ones(len(at), bool)
        head[1:] = at[1:] != at[:-1]
        row[at[head]] = values[head]
    filled = out.copy()
    doc, place = np.nonzero(out == _EMPTY)
    some = np.array([len(s) > 0 for s in sets], bool)
    doc, place = doc[some[doc]], place[some[doc]]
    for attempt in _donors(bins):
        if not len(doc):
            break
        value = filled[doc, attempt[place]]
        out[doc, place] = value
        missing = value == _EMPTY
        doc, place = doc[missing], place[missing]
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` bins; the band is part of the key."""
    bands = signature.shape[1] // rows
    parts = signature[:, :bands * rows].reshape(-1, bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for j in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return keys


def _sets(batch: pa.RecordBatch, text_col: str, words: int) -> Iterator[list[np.ndarray]]:
    for _, _, texts in each_block(batch, text_col):
        hashes, first = texts.shingles(words)
        yield [np.unique(hashes[a:b]) for a, b in zip(first, first[1:])]


def _longs(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, bins: int = BINS,
             rows: int = ROWS) -> DataFrame:
    """(doc_id, n, h1, h2, keys): set size, a 128-bit mark of the whole set, band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        for batch in batches:
            at = 0
            for sets in _sets(batch, "text", words):
                keys = list(band_keys(signatures(sets, bins), rows))
                marks = [[np.bitwise_xor.reduce(f) if len(f) else np.uint64(0)
                          for f in (mix(s + np.uint64(salt)) for s in sets)] for salt in (3, 11)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array(np.array(m, np.uint64).view(np.int64)) for m in marks),
                    _longs([k if len(s) else k[:0] for k, s in zip(keys, sets, strict=True)]),
                ], ["doc_id", "n", "h1", "h2", "keys"])
                at += len(sets)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n long, h1 long, h2 long, keys array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, members): the whole distinct shingle set of each text, as sorted hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        for batch in batches:
            at = 0
            for sets in _sets(batch, "text", words):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(sets)), _longs(sets)], ["doc_id", "members"])
                at += len(sets)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, members array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) whose full sets have 100 * intersection >= percent * union."""
    left = sets.toDF("u", "a")
    right = sets.toDF("v", "b")
    return (
        pairs.join(left, "u").join(right, "v")
        .withColumn("both", F.size(F.array_intersect("a", "b")))
        .where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("a") + F.size("b") - F.col("both")))
        .select("u", "v")
    )


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    words: int = 5, percent: int = 80, bins: int = BINS,
                    rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two texts are linked when the Jaccard similarity of their shingle sets is at least
    ``percent`` hundredths; ``component_id`` is the smallest id reachable over links and
    ``kept`` says whether that is the document itself.

    Texts with the same set form one class and go on as one row, so a text copied a million
    times costs one sketch.  Classes that share a band bucket are compared with one
    centre of that bucket, its member with most company over all its buckets (in a group of
    edited copies, the original).  Centre pairs are verified on full sets, and the
    components of the links are found.  Buckets that still hold more than one component are
    looked at again: small ones whole, larger ones around another centre.  What is open after
    that is compared inside tasks (``_settled``), members outside a bucket's largest component
    with all others, and only links between components come out.  Rows that leave a task so stay in
    proportion to bucket members, however large a group is, and a link is lost only if its
    ends are in no common bucket and in no other way connected.
    A pair whose sizes alone rule the similarity out is never verified.

    Nulls, empty and blank texts have no shingles: n_shingles 0, linked with nothing, kept.
    A null id is linked with nothing and has a null component.  Rows that repeat an id keep
    one row each and share the component.  Other columns are not returned.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = stored(sketches(docs, "doc_id", "text", words, bins, rows), "sketches")
    classes = stored(
        sketch.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n")
        .agg(F.min(F.struct("doc_id", "keys")).alias("least"))
        .select("h1", "h2", "n", F.col("least.doc_id").alias("rep"), F.col("least.keys").alias("keys")),
        "classes")
    entries = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(entries.join(shared, "key"), "members")

    company = members.groupBy("rep").agg(F.sum("size").alias("company"))
    centre = (
        members.join(company, "rep").groupBy("key")
        .agg(F.max(F.struct("company", -F.col("rep"), "n")).alias("c"))
        .select("key", (-F.col("c.col2")).alias("centre"), F.col("c.n").alias("centre_n"))
    )
    stars = stored(
        members.join(centre, "key").where("rep <> centre").where(_sizes_fit("n", "centre_n", percent))
        .select(F.least("rep", "centre").alias("u"), F.greatest("rep", "centre").alias("v")).distinct(),
        "stars")

    wanted = stored(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    sets = stored(shingle_sets(join_ids(docs, wanted, "left_semi"), words), "sets")
    links = stored(_linked(stars, sets, percent).distinct(), "links")
    found = connected_components(links)

    pairs = stored(_unsettled(members, found, percent), "rest")
    for more in (lambda: _linked(pairs, sets, percent), lambda: _settled(members, found, sets, percent)):
        new = stored(more(), "new-links")
        if not new.isEmpty():
            links = stored(links.union(new), "links")
            found = connected_components(links)

    known = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", "n", F.coalesce("component", "rep").alias("component_id"))
    single = sketch.where("n = 0 or doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    grouped = sketch.where("n > 0 and doc_id is not null").drop("keys").join(known, ["h1", "h2", "n"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    discard(members, stars, pairs, sets)
    return grouped.union(single).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sizes_fit(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets with more than one component, with theirs and the bucket's largest."""
    placed = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", "n", "size", F.coalesce("component", "rep").alias("comp"))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    largest = parts.groupBy("key").agg(
        F.count("*").alias("comps"), F.max(F.struct("m", -F.col("comp"))).alias("top")).where("comps > 1").select(
        "key", (-F.col("top.col2")).alias("top"))
    return placed.join(largest, "key")


def _unsettled(members: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in the buckets that still hold more than one.

    All of them in buckets of at most ``SMALL`` members; in larger ones one of the members
    outside the bucket's largest component with all others.
    """
    open_ = _open(members, found)
    outside = open_.where("comp <> top").select("key", "rep", "n", "comp", "size")
    centre = outside.where(F.col("size") > SMALL).groupBy("key").agg(
        F.min(F.struct(F.xxhash64("rep"), "rep", "n", "comp")).alias("o")).select(
        "key", "o.rep", "o.n", "o.comp")
    ends = outside.where(F.col("size") <= SMALL).drop("size").union(centre).toDF("key", "o", "o_n", "o_comp")
    return (
        ends.join(open_, "key").where("comp <> o_comp").where(_sizes_fit("n", "o_n", percent))
        .select(F.least("rep", "o").alias("u"), F.greatest("rep", "o").alias("v")).distinct()
    )


def _settled(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between components, out of the larger buckets that are still open.

    Open buckets with the same largest component are one family.  Its ends (members outside
    that component) meet all of the family: both sides are dealt into parts of about ``PART``
    shingles, and every two parts meet in one task.
    """
    family = stored(
        _open(members, found).where(F.col("size") > SMALL).groupBy("top", "rep")
        .agg(F.min("n").alias("n"), F.min("comp").alias("comp")), "families")
    end = F.col("comp") != F.col("top")
    parts = family.groupBy("top").agg(
        F.ceil(F.sum("n") / PART).alias("parts"), F.ceil(F.sum(F.when(end, F.col("n"))) / PART).alias("end_parts"))
    dealt = family.join(parts, "top")

    def place(count: str):
        return F.pmod(F.xxhash64("rep"), F.col(count))

    def every(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    ends = dealt.where(end).select("top", "rep", "comp", F.lit(True).alias("end"), place("end_parts").alias("a"),
                                   every("parts").alias("b"))
    others = dealt.select("top", "rep", "comp", F.lit(False).alias("end"), every("end_parts").alias("a"),
                          place("parts").alias("b"))
    return (
        ends.union(others).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
        .groupBy("top", "a", "b").applyInArrow(_between(percent), "u long, v long").distinct()
    )


def _between(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Each component of a group with the smallest one it is connected to inside the group."""
        comp = table.column("comp").to_numpy()
        end = table.column("end").to_numpy()
        lists = table.column("members").combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        values, ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        edges = np.cumsum([0, *sizes])
        other = np.flatnonzero(~end)
        theirs = ids[np.repeat(~end, sizes)]
        starts = np.cumsum(sizes[other]) - sizes[other]
        names, node = np.unique(comp, return_inverse=True)
        least = np.arange(len(names))
        pairs = [np.zeros((0, 2), np.int64)]
        mine = np.zeros(len(values), np.int64)
        for e in np.flatnonzero(end) if len(other) else ():
            own = ids[edges[e]:edges[e + 1]]
            mine[own] = 1
            both = np.add.reduceat(mine[theirs], starts)
            mine[own] = 0
            near = 100 * both >= percent * (sizes[e] + sizes[other] - both)
            to = np.unique(node[other[near]])
            pairs.append(np.stack([np.full(len(to), node[e]), to], axis=1))
        u, v = np.unique(np.concatenate(pairs), axis=0).T
        while True:
            before = least.copy()
            np.minimum.at(least, u, least[v])
            np.minimum.at(least, v, least[u])
            if (before == least).all():
                break
        some = least < np.arange(len(names))
        return pa.table({"u": names[some], "v": names[least[some]]})

    return run


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one of smallest id.

    Rows that repeat an id are one document, of which the row with the smallest text stays.
    Documents without words and rows with a null id stay.  All columns stay as they are.
    """
    found = near_duplicates(docs, **options)
    dropped = stored(found.where("not kept").select("doc_id").distinct(), "dropped")
    repeated = stored(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    rest = join_ids(docs, dropped, "left_anti")
    one = join_ids(rest, repeated, "left_semi").groupBy("doc_id").agg(
        F.min_by(F.struct(*docs.columns), F.struct("text")).alias("row")).select("row.*")
    return join_ids(rest, repeated, "left_anti").select(*docs.columns).union(one)
