"""Streaming jobs that write tables: state, digests, annotation.

Every micro-batch writes its own folder, named by the batch number and replaced as
a whole, so a batch run again after a failure leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutelage.operators import study
from tutelage.operators.study import KEY
from tutelage.session import discard, stored
from tutelage.sources.keyed import KeyedTable, without
from tutelage.streaming.state import ATTEMPT_ID, take_in

DIGEST_EVERY = 5   # fixed value: attempts between two digests of a learner
COUNTERS = ("n", "tracked", "mastered", "due", "blindspots")


def _drain(rows: DataFrame, each: Callable[[DataFrame, int], None], root: str) -> None:
    """Take in everything available and stop."""
    rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()


def run_item_state(attempts: DataFrame, root: str) -> None:
    """Fold everything available into the item state under ``root`` and stop."""
    _drain(attempts, lambda batch, number: take_in(batch, number, root), root)


def digests(batch: DataFrame, items: DataFrame, learners: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What a batch of attempts does to a learner's counters, and to its items.

    Returns the counters right after every attempt of the batch (learner_id, n, tracked, mastered,
    due, blindspots) and the items' last rows.  An attempt changes the standing of its item only, so
    counters are running sums of changes on top of those before the batch.  The windows hold what one
    batch has of an item or a learner, and batches are bounded.
    """
    after = study.history_after(batch, items)
    flags = {
        "mastered": F.col("mastered"), "due": ~F.col("mastered") & (F.col("due") <= now),
        "blindspots": ~F.col("mastered") & (F.col("calibration") == "blindspot")}
    along = Window.partitionBy(*KEY).orderBy("ts", "seq")
    standing = after.select(*KEY, "ts", "seq", "attempts", "reps", "streak", "lapses", "mastered",
                            *(f.cast("int").alias(f"is_{n}") for n, f in flags.items()), F.lit(1).alias("is_tracked"))
    told = items.select(*KEY, *(F.col(f"is_{n}").alias(f"was_{n}") for n in COUNTERS[1:]))
    changes = standing.join(told, KEY, "left").select("*", *(
        (F.col(f"is_{n}") - F.coalesce(F.lag(f"is_{n}").over(along), f"was_{n}", F.lit(0))).alias(f"change_{n}")
        for n in COUNTERS[1:]))
    upto = Window.partitionBy("learner_id").orderBy("ts", "seq", "topic").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    base = learners.select("learner_id", *(F.col(n).alias(f"base_{n}") for n in COUNTERS))
    counted = changes.join(base, "learner_id", "left").select("learner_id", *(
        (F.coalesce(f"base_{n}", F.lit(0)) + (F.count(F.lit(1)) if n == "n" else F.sum(f"change_{n}")).over(upto)).alias(n)
        for n in COUNTERS))
    last = standing.groupBy(*KEY).agg(F.max_by(F.struct(*(c for c in standing.columns if c not in KEY)), "attempts").alias("s"))
    return counted, last.select(*KEY, "s.*")


_ITEM = ("learner_id long, topic string, ts timestamp_ntz, seq long, attempts int, reps int, streak int, lapses int, mastered boolean, "
         "is_mastered int, is_due int, is_blindspots int, is_tracked int")
_LEARNER = f"learner_id long, {', '.join(f'{n} long' for n in COUNTERS)}"


def run_digests(attempts: DataFrame, root: str, now: Column) -> None:
    """Publish a learner's digest after every fifth attempt, with the counters as of that attempt, and
    once more at the end for attempts that no digest covers yet.

    A digest is named by (learner_id, n).  The n-th attempt is the n-th to arrive, by time within a
    batch; one delivered twice, in a batch or later with nothing newer of its item in between, counts
    once.  The counters of learners and the last rows of items are kept in tables of their own, and only
    the buckets of a batch's learners and items are read and written: the log is never read again.
    """
    spark = attempts.sparkSession
    items, learners = KeyedTable(spark, f"{root}/items", KEY), KeyedTable(spark, f"{root}/learners", ["learner_id"])
    out = f"{root}/digests"

    def before(table: KeyedTable, batch: DataFrame, number: int, schema: str) -> DataFrame:
        old = table.read(number, table.touched(batch))
        return spark.createDataFrame([], schema) if old is None else old

    def each(batch: DataFrame, number: int) -> None:
        fresh = batch.select(*study.ATTEMPT).dropDuplicates(ATTEMPT_ID)
        own = before(items, fresh, number, _ITEM)
        fresh = stored(without(fresh, own, ATTEMPT_ID), "fresh")
        counted, last = digests(fresh, own, before(learners, fresh, number, _LEARNER), now)
        counted, last = stored(counted, "counted"), stored(last, "last")
        counted.where(F.col("n") % DIGEST_EVERY == 0).write.mode("overwrite").parquet(f"{out}/batch={number}")
        learners.upsert(counted.groupBy("learner_id").agg(F.max_by(F.struct(*COUNTERS), "n").alias("s")).select(
            "learner_id", "s.*"), number, ["learner_id"])
        items.upsert(last, number, KEY)
        discard(fresh, counted, last)

    _drain(attempts, each, root)
    standing = learners.read()
    if standing is not None:
        standing.where(F.col("n") % DIGEST_EVERY != 0).write.mode("overwrite").parquet(f"{out}/batch=-1")


def run_resume(chunks: DataFrame, root: str,
               annotate: Callable[[DataFrame], DataFrame], parallelism: int | None = None) -> None:
    """Annotate new and changed chunks only.

    A chunk is done when the done-set has its id and the hash of its text, so a restart or a second
    delivery of the same chunks does no model work again.  The done-set is kept in buckets by id:
    a batch reads and writes those of its own chunks, however much was annotated before.  With
    ``parallelism``, ``annotate`` gets its rows in so many partitions and need not deal them again.
    """
    spark = chunks.sparkSession
    done = KeyedTable(spark, f"{root}/done", ["id"])
    out = f"{root}/annotated"
    # the hash (64 characters, or as many blanks) travels inside the id, so two texts of one id stay apart
    packed = F.concat(F.coalesce("text_hash", F.repeat(F.lit(" "), F.lit(64))),
                      F.when(F.col("id").isNull(), "-").otherwise(F.concat(F.lit("+"), "id")))

    def each(batch: DataFrame, number: int) -> None:
        # one key that is never null: what is dealt by it for one step lies right for the next
        todo = batch.withColumn("text_hash", F.sha2("text", 256)).withColumn("id", packed).drop("text_hash")
        seen = done.read(number, done.touched(batch))
        if seen is not None:
            todo = todo.join(seen.select(packed.alias("id")), "id", "left_anti")
        if parallelism:
            todo = todo.repartition(parallelism, "id")
        annotate(todo.dropDuplicates(["id"])).withColumn(
            "text_hash", F.nullif(F.substring("id", 1, 64), F.repeat(F.lit(" "), F.lit(64)))).withColumn(
            "id", F.when(F.substring("id", 65, 1) == "+", F.expr("substring(id, 66)"))).write.mode(
            "overwrite").parquet(f"{out}/batch={number}")
        fresh = spark.read.parquet(f"{out}/batch={number}").select("id", "text_hash")
        done.upsert(fresh, number, ["id", "text_hash"])

    _drain(chunks, each, root)
