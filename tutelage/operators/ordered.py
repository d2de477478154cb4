"""Places, running sums and neighbours in ordered groups of any size, exactly.

Rows are dealt into parts by range of (key, whole order), so a key that holds a third of all
rows lies over a third of the parts, and written once.  Windows run inside (key, part).  What the
earlier parts of a key hand on is worked out from one row per key and part.  Only the key that a
part begins with can have earlier parts, so the table of what is handed on has at most one row a
part, whatever the keys are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutelage.session import stored

PART = "_part"


def in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df``, written, with the number of each row's part along (``keys``, ``order``).

    Rows that are equal in both share a part; part numbers ascend with the order.
    """
    return stored(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "parts")


def inside(keys: Sequence[str], order: Sequence[str | Column]) -> Window:
    """The window of a key's rows within one part."""
    return Window.partitionBy(*keys, PART).orderBy(*order)


def so_far(keys: Sequence[str], order: Sequence[str | Column]) -> Window:
    return inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def joined(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` joined on keys that may be null; a written ``small`` is sent whole where its size allows."""
    named = small.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in small.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    return rows.join(named, same, how).drop(*(f"_k{i}" for i in range(len(keys))))


def split_keys(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys whose rows lie in more than one part, written: fewer than there are parts.

    Such a key is the first or the last one of each of its parts.
    """
    key = F.struct(*keys)
    ends = parts.groupBy(PART).agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("k"))
    return stored(ends.select(F.explode("k").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k.*"),
                  "split-keys")


def of_split_keys(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return joined(parts, split_keys(parts, keys), keys, "left_semi")


def handed_on(per_part: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    """(keys, part, values) for the parts of a key after its first, written.

    ``per_part`` has one row per key and part; ``values`` are aggregates or ``lag`` over the earlier ones.
    """
    along = Window.partitionBy(*keys).orderBy(PART)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    return stored(per_part.select(
        *keys, PART, F.count(F.lit(1)).over(before).alias("_earlier"),
        *(v.over(before).alias(n) for n, v in values.items())).where("_earlier > 0").drop("_earlier"), "handed-on")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], **values: Column) -> DataFrame:
    """``df`` with the inclusive running sums of ``values`` per key along ``order``."""
    parts = in_parts(df, keys, order)
    sums = of_split_keys(parts, keys).groupBy(*keys, PART).agg(*(F.sum(v).alias(n) for n, v in values.items()))
    carry = handed_on(sums, keys, **{f"_{n}": F.sum(n) for n in values})
    local = parts.select("*", *(F.sum(v).over(so_far(keys, order)).alias(n) for n, v in values.items()))
    out = joined(local, carry, [*keys, PART])
    return out.select(*df.columns, *((F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in values))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, alias: str) -> DataFrame:
    """Inclusive running sum of ``value`` per key along ``order``."""
    return running_sums(df, keys, order, **{alias: value})


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], alias: str = "pos") -> DataFrame:
    """Dense 1-based position of each row inside its key."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), alias)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, alias: str) -> DataFrame:
    """``df`` with ``value`` of the row before in the key, null for its first row."""
    parts = in_parts(df, keys, order)
    last = of_split_keys(parts, keys).groupBy(*keys, PART).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carry = handed_on(last, keys, _carried=F.last("_last"))
    local = parts.withColumn(alias, F.lag(value).over(inside(keys, order)))
    return joined(local, carry, [*keys, PART]).withColumn(alias, F.coalesce(alias, "_carried")).select(*df.columns, alias)
