"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tutelage.llm import (
    hyperplane,
    langid,
    minhash,
    ngram_lm,
    oracles,
    packing,
    passages,
    personal,
    ranked,
    rans,
    rendezvous,
    repair,
    secrets,
    simhash,
)
from tutelage.llm.setup import TOKENIZER, prepare, table

def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = rans.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplane.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_copied", "n_live")


def op8_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return ngram_lm.score(table(spark, sf_dir, "documents"), labels.where("quality = 1 and toxic = 0"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find(table(spark, sf_dir, "documents"))


def op12_repaired_talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {f.__name__: _shipped(f) for f in (
    op1_language, op2_near_duplicates, op3_repeated_passages, op4_packing, op5_token_files, op6_near_vectors,
    op7_secrets, op8_cross_entropy, op9_shards, op10_decontaminate, op11_personal_data, op12_repaired_talks,
    op13_ranked_search)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {"op2_near_duplicates": oracles.NEAR_DUPLICATES, "op6_near_vectors": oracles.VECTORS,
           "op13_ranked_search": oracles.SEARCH}
