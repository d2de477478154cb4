"""What a session needs before it runs these operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutelage.session import ship_package

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def prepare(spark: SparkSession) -> None:
    """The tasks need this package, and batches that stay small where texts are long."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids that a broadcast may hold (about 32 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def join_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` joined on doc_id with a written table of distinct ids, without moving texts
    where the ids, counted first, are few enough to be sent to all tasks."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)
