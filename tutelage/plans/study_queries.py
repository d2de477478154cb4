"""Study state, policy and report queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutelage.operators import policy, reports, study
from tutelage.plans import fixtures as fx
from tutelage.session import stored
from tutelage.sources.attempts import attempt_log


def _raw_attempts(spark, sf):
    bad = (F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 2 == 0)
    quality = (F.col("l_quantity").cast("int") % 8 - 1).cast("string")
    confidence = ((F.col("l_orderkey") + F.col("l_linenumber")) % 6 - 1).cast("string")
    return fx.table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("learner_id"),
        F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit("\t")).alias("topic"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit('"'), quality, F.lit('"')))
        .otherwise(quality).alias("quality"),
        F.when(bad, "2.5").otherwise(confidence).alias("confidence"),
        F.lit("").alias("note"),
    )


def _state(spark, sf):
    return study.item_state(fx.attempts(spark, sf))


def _items(spark, sf):
    return study.with_meta(_state(spark, sf), fx.bank(spark, sf))


def _state_table(s, d):
    """Item state written once, for queries that read it several times."""
    return stored(_state(s, d), "state")


def _item_table(s, d):
    return stored(_items(s, d), "items")


QUERIES = {
    "attempt_log": lambda s, d: attempt_log(_raw_attempts(s, d)).select(
        "learner_id", "topic", "ts", "quality", "confidence", "reject"),
    "item_state": _state,
    "attempt_history": lambda s, d: study.attempt_history(fx.attempts(s, d)),
    "due_schedule": lambda s, d: study.due_schedule(fx.attempts(s, d)),
    "calibrate": lambda s, d: study.calibrate(_state(s, d)).select(
        "learner_id", "topic", "last_quality", "last_confidence", "calibration"),
    "risk_score": lambda s, d: study.risk_score(_state(s, d)).select(
        "learner_id", "topic", "calibration", "lapses", "streak", "risk"),
    "emit_points": lambda s, d: study.emit_points(fx.attempts(s, d)),
    "counts": lambda s, d: policy.counts(_items(s, d), fx.now()),
    "study_report": lambda s, d: reports.study_report(_item_table(s, d), fx.bank(s, d), fx.now()),
    "strong_topics": lambda s, d: reports.strong_topics(_state(s, d)),
    "gaps": lambda s, d: policy.gaps(_items(s, d), 10),
    "next_due": lambda s, d: policy.next_due(_items(s, d), fx.now()),
    "next_numbers": lambda s, d: policy.next_due(_items(s, d), fx.now(), "number"),
    "next_math": lambda s, d: policy.next_due(_items(s, d), fx.now(), "math"),
    "next_mastered": lambda s, d: policy.next_mastered(_items(s, d), fx.now()),
    "next_question": lambda s, d: policy.next_question(fx.bank(s, d), _state_table(s, d)),
    "next_action": lambda s, d: policy.next_action(fx.bank(s, d), _item_table(s, d), fx.now()),
    "unseen_questions": lambda s, d: policy.unseen_list(fx.bank(s, d), _state_table(s, d)),
    "coverage": lambda s, d: reports.coverage(fx.bank(s, d), _state_table(s, d)),
    "reattach_keys": lambda s, d: policy.reattach_keys(_items(s, d), fx.bank(s, d), fx.now()),
    "enrich_attempts": lambda s, d: policy.enrich_attempts(fx.attempts(s, d), fx.bank(s, d)),
    "mastery_digest": lambda s, d: reports.mastery_digest(
        fx.bank(s, d), _item_table(s, d), fx.now()),
    "mastery_summary": lambda s, d: reports.mastery_summary(
        fx.bank(s, d), _item_table(s, d), fx.now()),
}
