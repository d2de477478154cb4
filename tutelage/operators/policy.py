"""What each learner should do next, and what is still uncovered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutelage.functions import scoring as S
from tutelage.operators.ordered import position, with_previous
from tutelage.operators.study import calibrate, in_flow, in_module, risk_score
from tutelage.session import stored

TIERS = ("short", "progressive", "long")


def gaps(items: DataFrame, n: int, module: str | None = None) -> DataFrame:
    """Non-mastered items by risk; the top ``n`` per learner, or all when n <= 0.

    The rank filter is pushed below the shuffle by the engine, so a learner with
    very many items sends only n rows per task.
    """
    open_items = risk_score(in_module(items, module)).where(~F.col("mastered"))
    cols = ["learner_id", "topic", "module", "unit", "calibration", "last_quality",
            "streak", "lapses", "note", "risk"]
    if n <= 0:
        return open_items.select(*cols)
    order = Window.partitionBy("learner_id").orderBy(F.desc("risk"), "topic")
    return (
        open_items.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n).select("rank", *cols)
    )


def _due(items: DataFrame, now: Column, module: str | None) -> DataFrame:
    return calibrate(in_module(items, module)).where(F.col("due") <= now)


def next_due(items: DataFrame, now: Column, focus: str | None = None,
             module: str | None = None) -> DataFrame:
    """The due, non-mastered item each learner should see first."""
    pick = F.struct(
        (F.col("calibration") != "blindspot").alias("calm"), "streak", "due", "topic",
        "module", "unit", "kind", "calibration", "lapses", "last_quality", "last_confidence")
    return (
        _due(items, now, module)
        .where(~F.col("mastered") & in_flow(F.col("kind"), focus))
        .groupBy("learner_id").agg(F.min(pick).alias("p"))
        .select("learner_id", "p.topic", "p.module", "p.unit", "p.kind", "p.calibration",
                "p.streak", "p.lapses", "p.last_quality", "p.last_confidence", "p.due")
    )


def next_mastered(items: DataFrame, now: Column, module: str | None = None) -> DataFrame:
    """The mastered item whose re-verification has waited longest."""
    return (
        _due(items, now, module)
        .where(F.col("mastered") & in_flow(F.col("kind"), None))
        .groupBy("learner_id")
        .agg(F.min(F.struct("due", "topic", "module", "unit", "streak")).alias("p"))
        .select("learner_id", "p.topic", "p.module", "p.unit", "p.streak", "p.due")
    )


def answered(bank: DataFrame) -> DataFrame:
    """Questions of the main flow that carry an official answer."""
    return bank.where(F.col("answer").rlike(r"\S") & in_flow(F.col("kind"), None))


def _tier(difficulty: Column) -> Column:
    rank = F.lit(0)
    for i, name in enumerate(TIERS):
        rank = F.when(difficulty == name, i).otherwise(rank)
    return rank


def _ranked(bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions numbered inside their unit, and units numbered by unit key.

    Both are stored: they are the size of the bank and read several times.
    """
    unit_key = F.concat_ws("|", "course", "module", "unit_topic")
    questions = answered(bank).withColumn("unit_key", unit_key).withColumn(
        "tier", _tier(F.col("difficulty")))
    questions = stored(position(
        questions, ["unit_key"],
        [F.col("tier").cast("bigint") * 2**31 + F.col("num"), F.col("id")], "q_rank"), "ranks")
    sizes = questions.groupBy("unit_key").agg(F.count(F.lit(1)).alias("size"))
    units = stored(position(
        sizes.withColumn("_all", F.lit(0)), ["_all"],
        ["unit_key"], "u_rank").drop("_all"), "units")
    return questions, units


def next_question(bank: DataFrame, state: DataFrame) -> DataFrame:
    """The unseen answered question for each learner: least attempted unit, then
    unit key, tier, number.

    No learner-by-question pairs are built.  Questions are numbered within a unit
    and units within the bank; the first unseen number is one more than the
    length of the unbroken prefix of seen numbers.  Group sizes are bounded by a
    unit's questions and by the number of units.
    """
    questions, units = _ranked(bank)
    where = questions.select(F.col("id").alias("topic"), "unit_key", "q_rank")
    seen = state.select("learner_id", "topic").join(where, "topic").join(units, "unit_key")
    in_unit = Window.partitionBy("learner_id", "u_rank").orderBy("q_rank")
    touched = (
        seen.withColumn("rn", F.row_number().over(in_unit))
        .groupBy("learner_id", "u_rank", "size")
        .agg(F.count(F.lit(1)).alias("tried"),
             F.sum((F.col("rn") == F.col("q_rank")).cast("int")).alias("prefix"))
    )
    by_unit = Window.partitionBy("learner_id").orderBy("u_rank")
    touched = touched.withColumn("rn", F.row_number().over(by_unit))
    best_touched = touched.groupBy("learner_id").agg(
        F.min(F.when(F.col("prefix") < F.col("size"), F.struct(
            "tried", "u_rank", (F.col("prefix") + 1).alias("q_rank")))).alias("again"),
        F.sum((F.col("rn") == F.col("u_rank")).cast("int")).alias("u_prefix"))
    n_units = units.agg(F.count(F.lit(1))).scalar()
    first_free = F.coalesce("u_prefix", F.lit(0)) + 1
    fresh = F.when(first_free <= n_units, F.struct(
        F.lit(0).cast("bigint").alias("tried"), first_free.cast("bigint").alias("u_rank"),
        F.lit(1).cast("bigint").alias("q_rank")))
    picked = (
        state.select("learner_id").distinct().join(best_touched, "learner_id", "left")
        .select("learner_id", F.coalesce(fresh, F.col("again")).alias("p"))
        .where(F.col("p").isNotNull())
        .select("learner_id", F.col("p.tried").alias("unit_attempted"), "p.u_rank", "p.q_rank")
    )
    return (
        picked.join(units.select("unit_key", "u_rank"), "u_rank")
        .join(questions.select("unit_key", "q_rank", "id", "module", "unit_topic", "difficulty",
                               "num", "prompt"), ["unit_key", "q_rank"])
        .select("learner_id", "id", "module", F.col("unit_topic").alias("unit"), "difficulty",
                "num", "prompt", "unit_attempted")
    )


def unseen_questions(bank: DataFrame, state: DataFrame) -> DataFrame:
    """Answered questions of a learner's courses that the learner never attempted, as intervals.

    Questions are numbered within their course (``numbered_questions``).  A row (learner_id, course,
    from_pos, to_pos, first_id, last_id, n_questions) stands for all questions between two places, so
    there are at most as many rows as attempted questions, and one more for each course.
    """
    numbered = numbered_questions(bank)
    key = ["learner_id", "course"]
    seen = stored(state.select("learner_id", "topic").join(
        numbered.select(F.col("id").alias("topic"), "course", "pos"), "topic"), "seen")
    sizes = numbered.groupBy("course").agg(F.max("pos").alias("size"))
    before = with_previous(seen, key, ["pos"], F.col("pos"), "earlier").select(
        *key, (F.coalesce("earlier", F.lit(0)) + 1).alias("from_pos"), (F.col("pos") - 1).alias("to_pos"))
    after = seen.groupBy(*key).agg((F.max("pos") + 1).alias("from_pos")).join(sizes, "course").select(
        *key, "from_pos", F.col("size").alias("to_pos"))
    holes = before.unionByName(after).where("from_pos <= to_pos")
    first = numbered.select("course", F.col("pos").alias("from_pos"), F.col("id").alias("first_id"))
    last = numbered.select("course", F.col("pos").alias("to_pos"), F.col("id").alias("last_id"))
    return holes.join(first, ["course", "from_pos"]).join(last, ["course", "to_pos"]).select(
        *key, "from_pos", "to_pos", "first_id", "last_id", (F.col("to_pos") - F.col("from_pos") + 1).alias("n_questions"))


def unseen_list(bank: DataFrame, state: DataFrame) -> DataFrame:
    """Every answered question of a learner's courses that the learner never attempted, a row each.

    The rows are those of ``unseen_questions`` spelled out.  Courses of a learner are few and met with
    the questions before those seen are taken out, by (learner, question), which no key outweighs.
    """
    questions = answered(bank)
    seen = state.select("learner_id", F.col("topic").alias("id"))
    active = stored(seen.join(questions.select("id", "course"), "id").select("learner_id", "course").distinct(), "active")
    return questions.join(active, "course").join(seen, ["learner_id", "id"], "left_anti").select(
        "learner_id", "course", "id", "module", "unit_topic", "num", "difficulty")


def numbered_questions(bank: DataFrame) -> DataFrame:
    """The answered questions with their place in their course, by id."""
    return stored(position(answered(bank), ["course"], ["id"], "pos"), "numbered")


def counts(items: DataFrame, now: Column) -> DataFrame:
    """Tracked, mastered, due and blindspot totals per learner."""
    open_item = ~F.col("mastered")
    return calibrate(items).groupBy("learner_id").agg(
        F.count(F.lit(1)).alias("tracked"),
        F.count_if("mastered").alias("mastered"),
        F.count_if(open_item & (F.col("due") <= now)).alias("due"),
        F.count_if(open_item & (F.col("calibration") == "blindspot")).alias("blindspots"),
    )


def next_action(bank: DataFrame, items: DataFrame, now: Column,
                module: str | None = None) -> DataFrame:
    """One verdict per learner: due blindspot, new question, due item,
    re-verification, or nothing left with the five weakest topics."""
    due = next_due(items, now, None, module).select(
        "learner_id", F.col("topic").alias("due_topic"), F.col("calibration").alias("due_calib"))
    fresh = next_question(in_module(bank, module), items).select(
        "learner_id", F.col("id").alias("new_topic"))
    again = next_mastered(items, now, module).select(
        "learner_id", F.col("topic").alias("again_topic"))
    weak = gaps(items, 5, module).groupBy("learner_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))),
                                 lambda x: x.topic), ",").alias("weak"))
    action = (
        F.when(F.col("due_calib") == "blindspot", "review")
        .when(F.col("new_topic").isNotNull(), "quiz_new")
        .when(F.col("due_topic").isNotNull(), "review")
        .when(F.col("again_topic").isNotNull(), "reverify")
        .otherwise("introduce_new")
    )
    topic = (
        F.when(F.col("action") == "review", F.col("due_topic"))
        .when(F.col("action") == "quiz_new", F.col("new_topic"))
        .when(F.col("action") == "reverify", F.col("again_topic"))
    )
    return (
        counts(items, now)
        .join(due, "learner_id", "left").join(fresh, "learner_id", "left")
        .join(again, "learner_id", "left").join(weak, "learner_id", "left")
        .withColumn("action", action)
        .select("learner_id", "action", topic.alias("topic"), "tracked", "mastered", "due",
                "blindspots",
                F.when(F.col("action") == "introduce_new", F.coalesce("weak", F.lit("")))
                .alias("weak_topics"))
    )


def reattach_keys(items: DataFrame, bank: DataFrame, now: Column) -> DataFrame:
    """Due items with the bank's own prompt, key and citation; freeform items stay."""
    keys = bank.select(
        F.col("id").alias("topic"), "prompt", F.col("answer").alias("grading_key"),
        "difficulty", "citation")
    return (
        calibrate(items).where((F.col("due") <= now) & ~F.col("mastered"))
        .join(keys, "topic", "left")
        .select("learner_id", "topic", "module", "unit", "kind", "calibration", "streak",
                "lapses", "due", F.coalesce("prompt", F.lit("")).alias("question"),
                "grading_key", "difficulty", "citation")
    )


def enrich_attempts(attempts: DataFrame, bank: DataFrame) -> DataFrame:
    """Attempts with the official description of their question, else freeform."""
    meta = bank.where(in_flow(F.col("kind"), None)).select(
        F.col("id").alias("topic"), "module", "unit", "difficulty",
        F.col("prompt").alias("question"), F.lit("official").alias("kind"))
    return attempts.join(meta, "topic", "left").withColumn(
        "kind", F.coalesce("kind", F.lit("freeform")))
