"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutelage.llm.components import connected_components
from tutelage.llm.words import mix
from tutelage.session import stored

#: At cosine 0.98 two vectors share a key of 18 signs with probability 0.30 and one of 32
#: tables with 0.99999.
TABLES = 32
SIGNS = 18
#: Rows of a bucket that meet as one side of a comparison; larger buckets are cut into parts of
#: about so many rows, and every two parts meet in a group of their own.
PART_ROWS = 512
_SEED = 20240229


def _planes(dims: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dims]).standard_normal((TABLES * SIGNS, dims))


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors in double precision) for each length of vector in a column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    for dims in np.unique(sizes):
        rows = np.flatnonzero(sizes == dims)
        yield rows, flat[(ends[rows] - dims)[:, None] + np.arange(dims)]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each vector its key in every table; label, length and table are part of the key."""
    weights = np.uint64(1) << np.arange(SIGNS, dtype=np.uint64)
    for batch in batches:
        keys = np.zeros((len(batch), TABLES), np.uint64)
        labels = batch.column("label").to_numpy().astype(np.int64).view(np.uint64)
        for rows, vectors in _matrix(batch.column("vector")):
            signs = (vectors @ _planes(vectors.shape[1]).T >= 0).reshape(len(rows), TABLES, SIGNS)
            bits = signs @ weights + (np.arange(TABLES, dtype=np.uint64) << np.uint64(SIGNS))
            own = mix(mix(labels[rows]) + np.uint64(vectors.shape[1]))
            keys[rows] = mix(bits + own[:, None] * np.uint64(0x9E3779B97F4A7C15))
        ends = np.arange(len(batch) + 1, dtype=np.int32) * TABLES
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("rep", "weight", "vector")),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))],
            ["rep", "weight", "vector", "keys"])


def _compare(threshold: float):
    """Links inside groups of rows (key, a, b, part, rep, weight, vector, keys).

    Rows arrive sorted by group.  A pair counts in the first table in which both have the same
    key, so it is found once whatever number of buckets it shares.  Per group and vector the
    result has the weight of its linked partners and one edge to the smallest row it is
    connected with inside the group.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            marks = np.stack([table.column(c).to_numpy() for c in ("key", "a", "b")])
            change = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            last = int(change[-1]) if len(change) else 0
            if last:
                yield from links(table.slice(0, last).combine_chunks(), np.concatenate([[0], change]))
            rest = table.slice(last)
        if rest is not None and len(rest):
            yield from links(rest.combine_chunks(), np.array([0, len(rest)]))

    def links(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        batch = table.to_batches()[0]
        key, a, b = (batch.column(c).to_numpy() for c in ("key", "a", "b"))
        part, rep, weight = (batch.column(c).to_numpy() for c in ("part", "rep", "weight"))
        sizes = batch.column("vector").value_lengths().to_numpy()
        flat = batch.column("vector").flatten().to_numpy().astype(np.float64)
        tables = batch.column("keys").flatten().to_numpy().reshape(len(batch), -1)
        ends = np.cumsum(sizes)
        for low, high in zip(edges, edges[1:]):
            dims = sizes[low]
            unit = flat[ends[low] - dims:ends[high - 1]].reshape(high - low, dims)
            unit = unit / np.abs(unit).max(axis=1, keepdims=True)
            unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            close = np.triu(unit @ unit.T >= threshold, 1)
            if a[low] != b[low]:  # two parts of a bucket: only pairs across them
                own = part[low:high]
                close &= own[:, None] != own[None, :]
            i, j = np.nonzero(close)
            same = tables[low + i] == tables[low + j]
            mine = tables[low + i, same.argmax(axis=1)] == key[low]
            i, j = low + i[mine], low + j[mine]
            if not len(i):
                continue
            total = np.zeros(high - low, np.int64)
            np.add.at(total, i - low, weight[j])
            np.add.at(total, j - low, weight[i])
            least = rep[low:high].copy()
            while True:
                before = least.copy()
                np.minimum.at(least, i - low, least[j - low])
                np.minimum.at(least, j - low, least[i - low])
                if (before == least).all():
                    break
            some = total > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[low:high][some]), pa.array(least[some]), pa.array(total[some])], ["rep", "least", "n"])

    return run


def near_vectors(vectors: DataFrame, *, threshold: float = 0.98, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal non-null label and length are linked when their cosine in double precision is
    at least ``threshold``; ``n_links`` counts the other rows linked directly, ``component_id`` is
    the smallest id reachable, ``kept`` says whether that is the row itself.

    Equal vectors of a label form one class with a weight.  Classes that share the signs of one
    table are compared exactly; a large bucket is compared part by part, and of a
    comparison only sums and one edge a row leave the task, never its pairs.  A vector
    that is null, empty, zero, or holds a null or non-finite component links with nothing, nor
    does a null label or id; such rows have n_links 0 and their own id.  Rows that repeat an id
    count as rows of their own.  Other columns are not returned.
    """
    vector, label = F.col(vector_col), F.col(label_col).cast("long")
    usable = (
        F.col(id_col).isNotNull() & label.isNotNull() & vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), vector.alias("vector"),
        F.coalesce(usable, F.lit(False)).alias("usable"), F.xxhash64(label, vector).alias("h1"),
        F.xxhash64(F.lit(7), vector, label).alias("h2"))
    good = rows.where("usable")
    classes = good.groupBy("h1", "h2").agg(
        F.min(F.struct("vec_id", "label", "vector")).alias("m"), F.count("*").alias("weight"))
    classes = stored(classes.select(
        "h1", "h2", F.col("m.vec_id").alias("rep"), F.col("m.label").alias("label"), "weight",
        F.col("m.vector").alias("vector")), "vector-classes")
    keyed = stored(classes.select("rep", "label", "weight", "vector").mapInArrow(
        _keys, f"rep long, weight long, vector {vectors.schema[vector_col].dataType.simpleString()}, keys array<long>"),
        "keyed")
    entries = keyed.select("rep", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    parts = F.ceil(F.col("m") / PART_ROWS)
    member = (
        entries.join(buckets, "key").withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("rep", "key"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("rep", "key", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")))
    grouped = member.join(keyed, "rep").select("key", "a", "b", "part", "rep", "weight", "vector", "keys")
    found = stored(
        grouped.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
        .mapInArrow(_compare(threshold), "rep long, least long, n long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = connected_components(found.select(F.col("rep").alias("u"), F.col("least").alias("v")))
    known = classes.join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    out = good.join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id").union(
        rows.where("not usable").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
