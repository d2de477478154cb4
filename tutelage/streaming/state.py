"""Item state kept up to date by a stream of attempts, late and repeated ones included.

An item's past is cut into slots of time, each kept as the associative summary of
``study.summaries``.  A batch recomputes the summaries of the slots it touches from the log, which
is laid out by slot, so an attempt that comes late is simply put in its place; the summaries of an
item are merged when its state is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutelage.operators.study import ATTEMPT, KEY, merged, slot, summaries
from tutelage.session import discard, stored
from tutelage.sources.keyed import KeyedTable

#: What makes two log rows the same attempt.
ATTEMPT_ID = [*KEY, "ts", "seq"]


def slots_of(spark: SparkSession, root: str) -> KeyedTable:
    return KeyedTable(spark, f"{root}/slots", KEY)


def take_in(batch: DataFrame, number: int, root: str) -> None:
    """Put a micro-batch of attempts into the log and its items' summaries under ``root``.

    Reads of the log are those slots that the batch has attempts in.  The batch's own folder is
    replaced as a whole, so taking it in again after a failure changes nothing.
    """
    spark = batch.sparkSession
    log = f"{root}/log"
    batch.select(*ATTEMPT, slot(F.col("ts")).alias("slot")).repartition("slot").write.mode("overwrite").partitionBy(
        "slot").parquet(f"{log}/batch={number}")
    fresh = spark.read.option("basePath", log).parquet(f"{log}/batch={number}")
    if fresh.isEmpty():
        return
    # as many numbers as there are slots in the calendar
    slots = [r.slot for r in fresh.select("slot").distinct().collect()]
    rows = (
        spark.read.parquet(log).where((F.col("batch") <= number) & F.col("slot").isin(slots))
        .join(fresh.select(*KEY, "slot").distinct(), [*KEY, "slot"], "left_semi").dropDuplicates(ATTEMPT_ID)
    )
    fresh_slots = stored(summaries(rows), "slots")
    slots_of(spark, root).upsert(fresh_slots, number, [*KEY, "slot"])
    discard(fresh_slots)


def current_state(spark: SparkSession, root: str) -> DataFrame | None:
    """State per item from all batches so far: the rows of ``study.item_state`` over the log's attempts."""
    slots = slots_of(spark, root).read()
    return None if slots is None else merged(slots)
