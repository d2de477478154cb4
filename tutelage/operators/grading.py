"""Grader requests, verdicts and grader qualification; batch model scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tutelage import schemas
from tutelage.operators.bank import points_of

# Pass thresholds of a grader and the retry limit of a model call.
EXACT_MIN = 0.50
WITHIN_ONE_MIN = 0.90
SIGNED_ERROR_MAX = 0.50
TRIES = 3

_LONG_NOTE = "\nThe answer should cover the topic as a whole; judge coverage and order.\n"


def resolve_golden(golden: DataFrame, bank: DataFrame) -> DataFrame:
    """Golden rows with their bank question; ``reject`` names ids the bank lacks."""
    known = bank.select(
        F.col("id").alias("question_id"), "prompt", "answer", "difficulty",
        F.lit(True).alias("known"))
    return golden.join(known, "question_id", "left").withColumn("reject", F.when(
        F.col("known").isNull(), F.concat(F.lit('question_id "'), "question_id", F.lit(
            '" not found in the question bank')))).drop("known")


def grading_requests(resolved: DataFrame) -> DataFrame:
    """The request text a grader receives for every resolved answer."""
    points = F.array_join(F.transform(points_of(F.col("answer")), lambda p: F.concat(
        F.lit("- "), p, F.lit("\n"))), "")
    text = F.concat(
        F.lit("Question:\n"), "prompt", F.lit("\n\nKey, not to be shown:\n"), "answer",
        F.lit("\n"),
        F.when(points != "", F.concat(F.lit("\nPoints to be named:\n"), points)).otherwise(""),
        F.when(F.col("difficulty") == "long", _LONG_NOTE).otherwise(""),
        F.lit("\nAnswer given:\n"), "learner_answer", F.lit("\n"))
    return resolved.where(F.col("reject").isNull()).withColumn("request", text)


def parse_verdicts(raw: DataFrame) -> DataFrame:
    """Verdicts from free text: the block from the first brace to the last one.

    Quality is clamped to 0-5 and a missing one is 0; unreadable rows get a reason.
    """
    body = F.regexp_extract("raw", r"(?s)\{.*\}", 0)
    v = F.from_json(body, schemas.VERDICT)
    given = F.get_json_object(body, "$.quality")
    reject = (
        F.when(body == "", "no JSON object")
        .when(F.try_parse_json(body).isNull() | (given.isNotNull() & v.quality.isNull()),
              "not valid JSON")
    )
    rows = raw.withColumn("reject", reject).withColumn("v", F.when(reject.isNull(), v))
    quality = F.when(F.col("reject").isNull(), F.greatest(F.lit(0), F.least(
        F.lit(5), F.coalesce("v.quality", F.lit(0)))))
    return rows.select(
        *[c for c in raw.columns if c != "raw"], quality.alias("quality"), "v.hits", "v.misses",
        F.col("v.explanation").alias("explanation"), "reject")


def verdict_rejects(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("grader").agg(
        F.count(F.lit(1)).alias("verdicts"), F.count("reject").alias("rejected"),
        (F.count("reject") / F.count(F.lit(1))).alias("reject_rate"))


def eval_summary(graded: DataFrame) -> DataFrame:
    """Agreement of each grader with the golden grades; positive error is leniency."""
    delta = F.col("actual") - F.col("expected")
    n = F.count(F.lit(1))
    s = graded.groupBy("grader").agg(
        n.alias("count"), F.count_if(delta == 0).alias("exact_matches"),
        F.count_if(F.abs(delta) <= 1).alias("within_one"), F.sum(delta).alias("_signed"))
    return (
        s.withColumn("exact_rate", F.col("exact_matches") / F.col("count"))
        .withColumn("within_one_rate", F.col("within_one") / F.col("count"))
        .withColumn("mean_signed_error", F.col("_signed") / F.col("count"))
        .withColumn("passed", (F.col("exact_rate") >= EXACT_MIN)
                    & (F.col("within_one_rate") >= WITHIN_ONE_MIN)
                    & (F.col("mean_signed_error") <= SIGNED_ERROR_MAX))
        .drop("_signed")
    )


class TransportError(Exception):
    """The model service cannot be reached; trying again will not help."""


def annotate(rows: DataFrame, key: str, text: str,
             make_client: Callable[[], Callable[[str, int], str | None]],
             parallelism: int | None, done: Column | None = None) -> DataFrame:
    """Score a text column with a user's model, as (key, output, tries, status).

    ``make_client`` runs once per partition and returns ``score(text, attempt)``,
    which gives the output or None for an unusable answer; unusable answers are
    asked again up to three times.  A TransportError fails the task at once.
    Rows for which ``done`` holds are left out.  ``parallelism`` caps concurrent
    clients, because it is the number of partitions; None leaves the rows as they are dealt.
    """
    schema = T.StructType([rows.schema[key], T.StructField("output", T.StringType()),
                           T.StructField("tries", T.IntegerType()),
                           T.StructField("status", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        score = make_client()
        for batch in batches:
            outputs, tries = [], []
            for value in batch[text]:
                output = None
                for attempt in range(1, TRIES + 1):
                    output = score(value, attempt)
                    if output is not None:
                        break
                outputs.append(output)
                tries.append(attempt)
            yield batch[[key]].assign(
                output=outputs, tries=tries,
                status=["failed" if o is None else "ok" for o in outputs])

    todo = rows if done is None else rows.where(~done)
    todo = todo.select(key, text)
    return (todo.repartition(parallelism) if parallelism else todo).mapInPandas(run, schema)
