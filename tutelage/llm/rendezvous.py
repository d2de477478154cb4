"""Shards by rendezvous hashing: each record goes to the shard that bids most for its key.

Shard s of weight w bids w / -ln(u), where u in (0, 1) is drawn from an MD5 of the key and s.
A bid depends on the key and that shard alone, so a further shard takes only the records
for which it bids most, and a shard that goes hands on only its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutelage.session import stored

#: Rows of a shard that are numbered by one task, about.
SLICE_ROWS = 50_000


def bids(key: Column, weights: Sequence[float]) -> list[Column]:
    """The bid of each shard for a key (string)."""
    out = []
    for s, weight in enumerate(weights):
        digits = F.substring(F.md5(F.concat(key, F.lit(f":{s}"))), 1, 12)
        drawn = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
        out.append(F.lit(float(weight)) / -F.log(drawn))
    return out


def shard_of(offered: Sequence[Column]) -> Column:
    """Number of the highest bid, the lower number on equal bids."""
    top = F.greatest(*offered) if len(offered) > 1 else offered[0]
    out = F.lit(len(offered) - 1)
    for s in range(len(offered) - 2, -1, -1):
        out = F.when(offered[s] == top, F.lit(s)).otherwise(out)
    return out.cast("int")


def assign_shards(records: DataFrame, key: Column | str, weights: Sequence[float], *,
                  shard_col: str = "shard", grown_col: str | None = None,
                  grown_weight: float = 1.0) -> DataFrame:
    """``records`` with their shard, and on request the one they had with one more shard.

    Works row by row without a shuffle.  A null key has the shard of the empty string.
    A column that already has a result's name is replaced.
    """
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    wide = records.withColumn("_bids", F.array(*bids(text, [*weights, grown_weight])))
    offered = [F.col("_bids")[s] for s in range(len(weights) + 1)]
    wide = wide.withColumn(shard_col, shard_of(offered[:-1]))
    if grown_col:
        top = F.array_max(F.slice("_bids", 1, len(weights)))
        wide = wide.withColumn(grown_col, F.when(
            offered[-1] > top, F.lit(len(weights))).otherwise(F.col(shard_col)).cast("int"))
    return wide.drop("_bids")


def number_slots(records: DataFrame, order: Sequence[str], *, shard_col: str = "shard") -> DataFrame:
    """``records`` with ``slot``: 0, 1, ... without gaps in each shard.

    A shard is cut into slices by a hash of all columns in ``order``; a row's slot is the rows of
    earlier slices plus its place in its slice.  The number of slices follows the number of
    rows, so no task holds a shard.  Rows equal in ``order`` travel as one row with a count
    until they have their slots, so they are no hot key either; such a row keeps the
    first value of each other column, which its ``order`` columns are meant to decide.
    """
    others = [c for c in records.columns if c not in (shard_col, *order)]
    kinds = stored(records.groupBy(shard_col, *order).agg(
        F.count("*").alias("_rows"), *(F.first(c).alias(c) for c in others)), "records")
    slices = max(kinds.count() // SLICE_ROWS, 1)
    cut = kinds.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    sizes = cut.groupBy(shard_col, "_slice").agg(F.sum("_rows").alias("_n"))
    before = sizes.selectExpr(
        shard_col, "_slice",
        f"sum(_n) over (partition by {shard_col} order by _slice) - _n as _base")
    names = ", ".join(order)
    placed = cut.join(before, [shard_col, "_slice"]).withColumn("_first", F.expr(
        f"_base + sum(_rows) over (partition by {shard_col}, _slice order by {names}) - _rows"))
    # two steps, so that a row with very many copies is no long array
    step = 10_000
    return (
        placed.withColumn("_part", F.explode(F.sequence(
            F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / step))))
        .withColumn("_at", F.explode(F.sequence(
            F.col("_part") * step, F.least(F.col("_rows"), (F.col("_part") + 1) * step) - 1)))
        .withColumn("slot", F.col("_first") + F.col("_at"))
        .drop("_rows", "_slice", "_base", "_first", "_part", "_at")
    )


def shard_documents(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: id and shard count decide the shard, and ``grown_shard`` is the one with
    one shard more, either the same or the new one.  ``size`` is the UTF-8 bytes of the text
    plus 1; a null text has size 1 and crc 0, as an empty one.  A null id is hashed as the empty
    string.  Slots go by id, size and crc inside hashed slices; repeated rows get slots of their
    own.  Other columns are not returned.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign_shards(rows, "doc_id", [1.0] * shards, grown_col="grown_shard")
    return number_slots(rows, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
