"""The append-only attempt log, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tutelage.functions import scoring as S
from tutelage.functions import text as X

# Models send scores as numbers or quoted numbers, so they arrive as text.
RAW_ATTEMPT = T.StructType([
    T.StructField("learner_id", T.LongType()),
    T.StructField("topic", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("quality", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("note", T.StringType()),
])


# A micro-batch reads at most this much, which bounds what one busy item can bring to
# the task that folds it.
BATCH_BYTES = 256 * 1024 * 1024


def read_attempts(spark: SparkSession, path: str, stream: bool = False,
                  batch_bytes: int = BATCH_BYTES) -> DataFrame:
    if stream:
        return spark.readStream.schema(RAW_ATTEMPT).option(
            "maxBytesPerTrigger", batch_bytes).parquet(path)
    return spark.read.schema(RAW_ATTEMPT).parquet(path)


def attempt_log(raw: DataFrame) -> DataFrame:
    """Scores coerced and clamped, topic normalised, bad rows kept with a reason."""
    quality, bad_q = S.whole_number(F.col("quality"), -(2**30), 2**30)
    confidence, bad_c = S.whole_number(F.col("confidence"), -(2**30), 2**30)
    topic = X.squash(F.col("topic"))
    return raw.select(
        "learner_id", topic.alias("topic"), "ts", "seq",
        S.clamp(quality, 0, 5).alias("quality"), S.clamp(confidence, 0, 3).alias("confidence"),
        X.strip(F.col("note")).alias("note"),
        F.when(topic == "", "topic is required")
        .when(bad_q.isNotNull(), F.concat(F.lit("quality: "), bad_q))
        .when(bad_c.isNotNull(), F.concat(F.lit("confidence: "), bad_c)).alias("reject"),
    )


def accepted(log: DataFrame) -> DataFrame:
    return log.where(F.col("reject").isNull()).drop("reject")


def rejected(log: DataFrame) -> DataFrame:
    return log.where(F.col("reject").isNotNull())
