"""The attempt log folded into per-item study state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutelage.functions import scoring as S
from tutelage.operators.ordered import PART, handed_on, in_parts, joined, of_split_keys, running_sum, so_far

KEY = ["learner_id", "topic"]
ATTEMPT = ["learner_id", "topic", "ts", "seq", "quality", "confidence", "note"]


#: Width of the stretches of time whose summaries are merged into an item's state.
SLOT_DAYS = 30


def slot(ts: Column) -> Column:
    """Number of the stretch of time that a moment lies in; never falling with time."""
    return F.floor(F.unix_date(ts.cast("date")) / SLOT_DAYS).cast("int")


def summaries(attempts: DataFrame) -> DataFrame:
    """One row per (item, slot) that stands for all its attempts: an associative summary.

    ``tail`` counts the hits after the last miss (all, where ``missed`` is false), ``first_hit`` and
    ``sure_hit`` are the places of the first and of the last sure one of them.  Two aggregations
    that combine before the shuffle: what is there up to the last miss, then what follows it.  An
    item with very many attempts is spread over its slots.
    """
    by = [*KEY, "slot"]
    log = attempts.select(*ATTEMPT, slot(F.col("ts")).alias("slot"))
    place = F.struct("ts", "seq")
    hit = F.coalesce(S.is_correct(F.col("quality")), F.lit(False))
    whole = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(hit).alias("reps"),
        F.count_if(F.col("quality") < S.LAPSE_BELOW).alias("lapses"), F.min("ts").alias("created"),
        F.max(F.when(~hit, place)).alias("last_miss"),
        F.max(F.struct("ts", "seq", "quality", "confidence", "note")).alias("last"))
    hits = log.where(hit).select(*by, place.alias("at"), S.is_sure(F.col("confidence")).alias("sure"))
    after = (F.col("last_miss").isNull() | (F.col("at") > F.col("last_miss"))) & F.col("at").isNotNull()
    return (
        whole.join(hits, by, "left").groupBy(*by).agg(
            *(F.any_value(c).alias(c) for c in ("attempts", "reps", "lapses", "created", "last")),
            F.any_value(F.col("last_miss").isNotNull()).alias("missed"),
            F.count_if(after).alias("tail"), F.min(F.when(after, F.col("at"))).alias("first_hit"),
            F.max(F.when(after & F.col("sure"), F.col("at"))).alias("sure_hit"))
    )


def merged(slots: DataFrame) -> DataFrame:
    """Current state per item from the summaries of its slots, in any number and order of arrival.

    An item has as many summaries as its attempts span slots, so they are gathered and folded.
    """
    parts = ["attempts", "reps", "lapses", "created", "last", "missed", "tail", "first_hit", "sure_hit"]

    def add(a: Column, b: Column) -> Column:
        return F.when(a["attempts"].isNull(), b).otherwise(F.struct(
            b["slot"].alias("slot"), *((a[c] + b[c]).alias(c) for c in ("attempts", "reps", "lapses")),
            a["created"].alias("created"), b["last"].alias("last"), (a["missed"] | b["missed"]).alias("missed"),
            F.when(b["missed"], b["tail"]).otherwise(a["tail"] + b["tail"]).alias("tail"),
            F.when(b["missed"], b["first_hit"]).otherwise(F.coalesce(a["first_hit"], b["first_hit"])).alias("first_hit"),
            F.when(b["missed"], b["sure_hit"]).otherwise(F.coalesce(b["sure_hit"], a["sure_hit"])).alias("sure_hit")))

    rows = slots.select(*KEY, F.struct("slot", *parts).alias("s"))
    kind = rows.schema["s"].dataType.simpleString()
    folded = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list("s")).alias("all")).select(
        *KEY, F.aggregate("all", F.lit(None).cast(kind), add).alias("s")).select(*KEY, "s.*", "s.last.*")
    streak = F.col("tail").cast("int")
    # a sure hit that is not the first of the run; the run's first one is there whenever one is
    mastered = F.coalesce(F.col("sure_hit") > F.col("first_hit"), F.lit(False))
    return folded.select(
        *KEY, F.col("attempts").cast("int"), F.col("reps").cast("int"), streak.alias("streak"),
        F.col("lapses").cast("int"), mastered.alias("mastered"),
        S.add_minutes(F.col("ts"), S.due_minutes(mastered, streak, F.col("quality"), F.col("confidence"))).alias("due"),
        "created", F.col("ts").alias("last_reviewed"), F.col("quality").alias("last_quality"),
        F.col("confidence").alias("last_confidence"), "note")


def item_state(attempts: DataFrame) -> DataFrame:
    """Current state per (learner, topic)."""
    return merged(summaries(attempts))


def _running(parts: DataFrame) -> DataFrame:
    """Per attempt, inside its (item, part): row number and where the last miss, the last sure
    hit and the last mastering hit happened."""
    upto = so_far(KEY, ["ts", "seq"])
    hit = S.is_correct(F.col("quality"))
    sure_hit = hit & S.is_sure(F.col("confidence"))
    return (
        parts.withColumn("rn", F.count(F.lit(1)).over(upto))
        .withColumn("miss_at", F.coalesce(F.max(F.when(~hit, F.col("rn"))).over(upto), F.lit(0)))
        .withColumn("run", F.col("rn") - F.col("miss_at"))
        .withColumn("sure_at", F.coalesce(F.max(F.when(sure_hit, F.col("rn"))).over(upto), F.lit(0)))
        .withColumn("master_at", F.coalesce(F.max(F.when(
            sure_hit & (F.col("run") >= S.STREAK_TO_MASTER), F.col("rn"))).over(upto), F.lit(0)))
        .withColumn("reps", F.sum(hit.cast("int")).over(upto))
        .withColumn("lapses", F.sum((F.col("quality") < S.LAPSE_BELOW).cast("int")).over(upto))
    )


def _carry(parts: DataFrame) -> DataFrame:
    """What each part of an item is handed by the parts before it; at most one row a part."""
    ends = _running(of_split_keys(parts, KEY)).groupBy(*KEY, PART).agg(F.max_by(F.struct(
        "rn", "miss_at", "run", "sure_at", "master_at", "reps", "lapses"), "rn").alias("e")).select(*KEY, PART, "e.*")
    along = Window.partitionBy(*KEY).orderBy(PART)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a stretch is a row of parts since the last one that had a miss
    ends = ends.withColumn("stretch", F.sum((F.col("miss_at") > 0).cast("int")).over(upto))
    within = Window.partitionBy(*KEY, "stretch").orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("streak_end", F.sum("run").over(within))
    mastering = (F.col("master_at") > F.col("miss_at")) | (
        (F.col("sure_at") > F.col("miss_at")) & (F.col("streak_end") > F.col("run")))
    ends = ends.withColumn("mastered_end", F.max(mastering).over(within))
    return handed_on(ends, KEY, c_streak=F.last("streak_end"), c_mastered=F.last("mastered_end"), c_reps=F.sum("reps"),
                     c_lapses=F.sum("lapses"), c_rows=F.sum("rn"))


def _settle(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Apply carried-in state and derive streak, mastery and due time."""
    zero = F.lit(0)
    open_run = F.col("miss_at") == 0
    c_streak = F.coalesce("c_streak", zero)
    streak = F.col("run") + F.when(open_run, c_streak).otherwise(0)
    mastered = (F.col("master_at") > F.col("miss_at")) | (open_run & (
        F.coalesce("c_mastered", F.lit(False))
        | ((c_streak >= 1) & (F.col("sure_at") > F.col("miss_at")))))
    return (
        joined(rows, carry, keys).withColumn("streak", streak.cast("int")).withColumn("mastered", mastered)
        .withColumn("reps", (F.col("reps") + F.coalesce("c_reps", zero)).cast("int"))
        .withColumn("lapses", (F.col("lapses") + F.coalesce("c_lapses", zero)).cast("int"))
        .withColumn("attempts", (F.col("rn") + F.coalesce("c_rows", zero)).cast("int"))
        .withColumn("due", S.add_minutes(F.col("ts"), S.due_minutes(
            F.col("mastered"), F.col("streak"), F.col("quality"), F.col("confidence"))))
    )


def _history(settled: DataFrame) -> DataFrame:
    calib = S.calibration(F.col("quality"), F.col("confidence"), F.col("ts"))
    return settled.select(
        *KEY, "ts", "seq", "attempts", "quality", "confidence", "reps", "streak", "lapses",
        "mastered", "due", calib.alias("calibration"),
        S.outcome(F.col("mastered"), calib, F.col("topic"), F.col("due")).alias("message"))


def attempt_history(attempts: DataFrame) -> DataFrame:
    """State right after every attempt, with the message shown to the learner."""
    parts = in_parts(attempts.select(*ATTEMPT), KEY, ["ts", "seq"])
    return _history(_settle(_running(parts), _carry(parts), [*KEY, PART]))


def history_after(attempts: DataFrame, before: DataFrame) -> DataFrame:
    """``attempt_history`` of further attempts, given the items' last rows of it (KEY, attempts, reps,
    streak, lapses, mastered).  For one batch: an item's rows of it are folded in one task."""
    carry = before.select(
        *KEY, F.col("streak").alias("c_streak"), F.col("mastered").alias("c_mastered"), F.col("reps").alias("c_reps"),
        F.col("lapses").alias("c_lapses"), F.col("attempts").alias("c_rows"))
    return _history(_settle(_running(attempts.select(*ATTEMPT, F.lit(0).alias(PART))), carry, KEY))


def due_schedule(attempts: DataFrame) -> DataFrame:
    """Due time after every attempt and the wait that led to it."""
    h = attempt_history(attempts)
    wait = S.due_minutes(F.col("mastered"), F.col("streak"), F.col("quality"), F.col("confidence"))
    return h.select(*KEY, "ts", "seq", "streak", "mastered",
                    wait.cast("int").alias("wait_minutes"), "due")


def calibrate(state: DataFrame) -> DataFrame:
    return state.withColumn("calibration", S.calibration(
        F.col("last_quality"), F.col("last_confidence"), F.col("last_reviewed")))


def risk_score(state: DataFrame) -> DataFrame:
    return calibrate(state).withColumn("risk", S.risk(
        F.col("calibration"), F.col("last_quality"), F.col("lapses"), F.col("streak"),
        F.col("last_reviewed")))


def emit_points(attempts: DataFrame, every: int = 5) -> DataFrame:
    """Attempts at which a learner's digest is published: each ``every``-th one
    and the last when it closes a partial batch."""
    log = attempts.select("learner_id", "topic", "ts", "seq")
    numbered = running_sum(log, ["learner_id"], ["ts", "seq", "topic"],
                           F.lit(1).cast("bigint"), "n")
    totals = log.groupBy("learner_id").agg(F.count(F.lit(1)).alias("total"))
    # The last row is found by count, so no second ordered pass is needed.
    return (
        numbered.join(totals, "learner_id")
        .where((F.col("n") % every == 0) | (F.col("n") == F.col("total")))
        .select("learner_id", "topic", "ts", "seq", "n",
                (F.col("n") % every != 0).alias("trailing"))
    )


def with_meta(state: DataFrame, bank: DataFrame) -> DataFrame:
    """Attach module, unit and kind from the bank; unknown topics are freeform."""
    meta = bank.select(
        F.col("id").alias("topic"), "module", F.col("unit_topic").alias("unit"), "kind")
    return (
        state.join(meta, "topic", "left")
        .withColumn("kind", F.coalesce("kind", F.lit("freeform")))
    )


def in_module(df: DataFrame, module: str | None) -> DataFrame:
    return df if not module else df.where(F.col("module") == module)


def in_flow(kind: Column, focus: str | None) -> Column:
    """The regular flow hides the focus kinds; a focus flow shows only its own."""
    if focus:
        return kind == focus
    return ~F.coalesce(kind, F.lit("")).isin(*S.FOCUS_KINDS)
