"""Standing reports per learner and course."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutelage.functions import scoring as S
from tutelage.operators.policy import counts, gaps
from tutelage.operators.ordered import position
from tutelage.operators.study import in_flow, in_module, risk_score
from tutelage.session import stored

WEAK_UNITS = 5
BLINDSPOTS_SHOWN = 3
# A part of a digest's list of blindspots holds at most this many.
BLINDSPOTS_PER_PART = 1000
COURSE = ["learner_id", "course"]


def percent(part: Column, whole: Column) -> Column:
    """Truncated percentage, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(part * 100 / whole)).cast("int")


def study_report(items: DataFrame, bank: DataFrame, now: Column,
                 module: str | None = None) -> DataFrame:
    """Progress per learner with the eight weakest topics.

    Counts cover everything the learner has; only the bank size follows ``module``.
    The strong list may be long, so it is a table of its own (``strong_topics``).
    """
    soonest = items.where(~F.col("mastered")).groupBy("learner_id").agg(
        F.min("due").alias("next_due"))
    weak = gaps(items, S.WEAK_SHOWN).groupBy("learner_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))),
                                 lambda x: x.topic), ",").alias("weak"))
    size = in_module(bank, module).where(in_flow(F.col("kind"), None)).agg(
        F.count(F.lit(1))).scalar()
    return (
        counts(items, now).join(soonest, "learner_id", "left").join(weak, "learner_id", "left")
        .withColumn("bank_questions", size)
    )


def strong_topics(items: DataFrame) -> DataFrame:
    """Mastered topics of each learner, alphabetical."""
    return items.where("mastered").select("learner_id", "topic").orderBy("learner_id", "topic")


def _units(bank: DataFrame, module: str | None = None) -> DataFrame:
    """The units of each course with their number of questions."""
    questions = in_module(bank, module).where(in_flow(F.col("kind"), None))
    return questions.groupBy("course", "module", F.col("unit_topic").alias("unit")).agg(F.count(F.lit(1)).alias("questions"))


def _touched(bank: DataFrame, state: DataFrame, units: DataFrame, module: str | None = None) -> DataFrame:
    """Tallies of the units that a learner has attempted questions of, joined to ``units``."""
    questions = in_module(bank, module).where(in_flow(F.col("kind"), None))
    return (
        state.select("learner_id", "topic", F.col("mastered").cast("long").alias("m"))
        .join(questions.select(F.col("id").alias("topic"), "course", "module", F.col("unit_topic").alias("unit")), "topic")
        .groupBy("learner_id", "course", "module", "unit")
        .agg(F.count(F.lit(1)).alias("attempted"), F.sum("m").alias("mastered"))
        .join(units, ["course", "module", "unit"])
    )


def coverage(bank: DataFrame, state: DataFrame, module: str | None = None) -> DataFrame:
    """Tallies of every unit of the courses a learner works in, untouched ones with zeros, and one
    overall row for each of these courses.

    Attempts are reduced to one row per learner and unit before they meet the list of units.
    """
    units = stored(_units(bank, module), "units")
    touched = stored(_touched(bank, state, units, module).drop("questions"), "touched")
    tallies = ["questions", "attempted", "mastered"]
    per_unit = touched.select(*COURSE).distinct().join(units, "course").join(
        touched, [*COURSE, "module", "unit"], "left").fillna(0, tallies).select(*COURSE, "module", "unit", *tallies)
    overall = per_unit.groupBy(*COURSE).agg(
        F.lit("").alias("module"), F.lit("(overall)").alias("unit"), *[F.sum(c).alias(c) for c in tallies])
    return per_unit.unionByName(overall).withColumn("mastered_pct", percent(F.col("mastered"), F.col("questions")))


def _placed(items: DataFrame, bank: DataFrame) -> DataFrame:
    """Items with the course, kind and prompt of their question; '' is the course of those without one."""
    known = bank.select(F.col("id").alias("topic"), "course", F.col("kind").alias("bank_kind"), "prompt")
    return items.join(known, "topic", "left").withColumn("course", F.coalesce("course", F.lit("")))


def _blindspots(items: DataFrame, bank: DataFrame) -> DataFrame:
    """Outstanding blindspots of a learner's course in risk order, with the prompt a person recognises."""
    spots = risk_score(_placed(items, bank)).where(
        ~F.col("mastered") & (F.col("calibration") == "blindspot")
    ).select(*COURSE, "topic", "prompt", "note", (-F.col("risk")).alias("calm"))
    ranked = stored(position(spots, COURSE, ["calm", "topic"], "rank"), "spots")
    return ranked.select(*COURSE, "rank", F.coalesce("prompt", "topic").alias("topic"), F.coalesce("note", F.lit("")).alias("note"))


def _totals(bank: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    sizes = bank.where(in_flow(F.col("kind"), None)).groupBy("course").agg(F.count(F.lit(1)).alias("questions"))
    official = F.col("bank_kind").isNotNull() & in_flow(F.col("bank_kind"), None)
    return (
        _placed(items, bank).groupBy(*COURSE).agg(
            F.count_if(~F.col("mastered") & (F.col("due") <= now)).alias("due"),
            F.count_if(official).alias("attempted"), F.count_if(official & F.col("mastered")).alias("mastered"))
        .join(sizes, "course", "left").fillna(0, ["questions"])
        .withColumn("mastered_pct", percent(F.col("mastered"), F.col("questions")))
    )


def _weak_units(bank: DataFrame, items: DataFrame) -> DataFrame:
    """Up to five least mastered units of a learner's course, as an ordered array.

    Units are numbered within their course.  Of those that the learner never touched only the first
    five can be among the weakest; they lie in the gaps between the touched ones.
    """
    units = stored(position(_units(bank), ["course"], ["module", "unit"], "pos"), "unit-list")
    touched = stored(_touched(bank, items, units), "touched")
    along = Window.partitionBy(*COURSE).orderBy("pos")
    gaps_before = touched.select(
        *COURSE, (F.lag("pos", 1, 0).over(along) + 1).alias("lo"), (F.col("pos") - 1).alias("hi"), F.row_number().over(along).alias("r"))
    sizes = units.groupBy("course").agg(F.max("pos").alias("hi"))
    gap_after = touched.groupBy(*COURSE).agg((F.max("pos") + 1).alias("lo"), (F.count(F.lit(1)) + 1).alias("r")).join(sizes, "course")
    # the x-th unit of a course, with r - 1 touched ones before, is the (x - r + 1)-th untouched one
    last = F.least(F.col("hi"), F.col("r") + WEAK_UNITS - 1)
    untouched = (
        gaps_before.unionByName(gap_after).where(F.col("lo") <= last)
        .select(*COURSE, F.explode(F.sequence(F.col("lo"), last)).alias("pos")).join(units, ["course", "pos"])
        .select(*COURSE, "module", "unit", F.lit(0).alias("mastered_pct"))
    )
    tried = touched.select(*COURSE, "module", "unit", percent(F.col("mastered"), F.col("questions")).alias("mastered_pct")).where(
        "mastered_pct < 100")
    order = Window.partitionBy(*COURSE).orderBy("mastered_pct", "module", "unit")
    label = F.concat(F.col("module"), F.lit(" · "), F.col("unit"))
    return (
        tried.unionByName(untouched).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= WEAK_UNITS)
        .groupBy(*COURSE).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", label.alias("unit"), "mastered_pct"))),
            lambda x: F.struct(x.unit.alias("unit"), x.mastered_pct.alias("mastered_pct"))
        ).alias("weak_units"))
    )


def mastery_digest(bank: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """The mastery document of a learner's course as JSON (learner_id, course, part, digest).

    Part 0 holds the figures and the weakest units; blindspots, in order, are in the parts from 1 on,
    1000 to a part, however many there are.
    """
    spots = _blindspots(items, bank)
    lists = (
        spots.withColumn("part", (F.floor((F.col("rank") - 1) / BLINDSPOTS_PER_PART) + 1).cast("int"))
        .groupBy(*COURSE, "part").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "topic", "note"))),
            lambda x: F.struct(x.topic.alias("topic"), x.note.alias("note"))).alias("spots"))
        .select(*COURSE, "part", F.to_json(F.struct(
            F.col("course").alias("course_slug"), F.col("spots").alias("blindspots"))).alias("digest"))
    )
    no_units = F.from_json(F.lit("[]"), "array<struct<unit:string,mastered_pct:int>>")
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = (
        _totals(bank, items, now)
        .join(_weak_units(bank, items), COURSE, "left")
        .join(spots.groupBy(*COURSE).agg(F.count(F.lit(1)).alias("n")), COURSE, "left")
        .select(*COURSE, F.lit(0).alias("part"), F.to_json(F.struct(
            F.col("course").alias("course_slug"), stamp.alias("updated"),
            F.struct("questions", "attempted", "mastered", "mastered_pct").alias("coverage"),
            F.col("due"), F.coalesce("n", F.lit(0)).alias("blindspots"),
            F.coalesce("weak_units", no_units).alias("weak_units"))).alias("digest"))
    )
    return head.unionByName(lists)


def _short(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))
                  ).otherwise(text)


def mastery_summary(bank: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """The digest as at most three lines of text for each course of a learner."""
    spots = (
        _blindspots(items, bank).groupBy(*COURSE).agg(
            F.count(F.lit(1)).alias("n_spots"),
            *[F.max(F.when(F.col("rank") == i + 1, _short(F.col("topic"), 60))).alias(f"s{i}")
              for i in range(BLINDSPOTS_SHOWN)])
    )
    totals = _totals(bank, items, now).join(spots, COURSE, "left").join(
        _weak_units(bank, items), COURSE, "left")
    first = F.concat(
        F.lit("Tried "), "attempted", F.lit(" of "), "questions",
        F.lit(" questions; "), "mastered", F.lit(" mastered ("), "mastered_pct",
        F.lit("%), "), "due", F.lit(" to repeat"))
    second = F.when(F.col("n_spots").isNull(), F.lit("No blindspots")).otherwise(
        F.concat(F.lit("Blindspots ("), "n_spots", F.lit("): "),
                 F.concat_ws("; ", *[f"s{i}" for i in range(BLINDSPOTS_SHOWN)]), F.lit(".")))
    third = F.when(F.size("weak_units") > 0, F.concat(
        F.lit("Least mastered: "), F.array_join(F.transform("weak_units", lambda u: F.concat(
            _short(u.unit, 40), F.lit(" ("), u.mastered_pct, F.lit("%)"))), ", "), F.lit(".")))
    return totals.select(*COURSE, F.concat_ws("\n", first, second, third).alias("summary"))
