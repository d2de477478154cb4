"""Retrieval chunks: cutting lessons, carrying finished work over, checking vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tutelage import schemas
from tutelage.functions import text as X
from tutelage.session import discard, stored
from tutelage.sources.keyed import KeyedTable

# Byte budgets.
CHUNK_BYTES = 1600
EMBED_BYTES = 1800
EMBED_FLOOR = 256
EMBED_RETRIES = 6


def pack_paragraphs(text: Column, budget: int = CHUNK_BYTES, sep: str = "\n\n") -> Column:
    """Array of chunks: whole paragraphs packed until the byte budget would break.

    A paragraph above the budget stands alone.
    """
    paragraphs = F.filter(F.transform(F.split(X.strip(text), sep), X.strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, para: Column) -> Column:
        full = (F.octet_length(acc.open) > 0) & (
            F.octet_length(acc.open) + F.octet_length(para) + 2 > budget)
        return F.struct(
            F.when(full, F.concat(acc.done, F.array(acc.open))).otherwise(acc.done).alias("done"),
            F.when(full | (acc.open == ""), para)
            .otherwise(F.concat(acc.open, F.lit("\n\n"), para)).alias("open"))

    return F.aggregate(paragraphs, start, add, lambda acc: F.when(
        acc.open == "", acc.done).otherwise(F.concat(acc.done, F.array(acc.open))))


def chunk_paragraphs(texts: DataFrame, budget: int = CHUNK_BYTES, sep: str = "\n\n") -> DataFrame:
    return texts.select(
        *[c for c in texts.columns if c != "text"],
        F.posexplode(pack_paragraphs(F.col("text"), budget, sep)).alias("idx", "text"))


def chunk_lessons(lessons: DataFrame, budget: int = CHUNK_BYTES, sep: str = "\n\n") -> DataFrame:
    """All chunk rows of every lesson: prose, definitions, key numbers, processes.

    One pass and one explode per lesson.  Ids depend only on module, lesson
    position, type and position within the type.
    """
    def piece(kind: str, i: Column, text: Column, term: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), i.cast("int").alias("idx"),
                        text.alias("text"), term.alias("term"))

    none = F.lit(None).cast("string")

    def plain(kind: str, texts: Column) -> Column:
        return F.transform(texts, lambda t, i: piece(kind, i, t, none))

    def termed(kind: str, name: str) -> Column:
        terms = F.array_sort(F.map_keys(name))
        return F.transform(terms, lambda k, i: piece(
            kind, i, F.concat(k, F.lit(": "), F.element_at(name, k)), k))

    empty = F.expr("cast(array() as array<struct<type:string,idx:int,text:string,term:string>>)")
    pieces = F.concat(*[F.coalesce(p, empty) for p in (
        plain("prose", pack_paragraphs(F.col("lecture_content"), budget, sep)),
        termed("definition", "definitions"), termed("key_number", "key_numbers"),
        plain("process", F.col("processes")))])
    return lessons.select(
        "module", "lesson_index", F.col("lesson").alias("lesson_title"),
        F.inline(pieces),
    ).select(
        F.format_string("%s_l%03d_%s_%d", "module", "lesson_index", "type", "idx").alias("id"),
        "*")


def speech_chunks(segments: DataFrame, low: int = 200, high: int = 700) -> DataFrame:
    """Sentences packed into spoken chunks of ``low`` to ``high`` characters.

    Only whole sentences are joined, words and punctuation stay as they are, and
    a short last chunk joins its predecessor when both fit.
    """
    marked = F.regexp_replace("text", r"([.!?]+)\s+", "$1\u0001")
    sentences = F.filter(F.split(marked, "\u0001"), lambda s: s.rlike(r"\S"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        longer = F.length(acc.open) + 1 + F.length(s)
        close = (acc.open != "") & ((longer > high) & (F.length(acc.open) >= 1))
        return F.struct(
            F.when(close, F.concat(acc.done, F.array(acc.open))).otherwise(acc.done).alias("done"),
            F.when(close | (acc.open == ""), s).otherwise(F.concat(acc.open, F.lit(" "), s))
            .alias("open"))

    def finish(acc: Column) -> Column:
        last = F.element_at(F.concat(F.array(F.lit("")), acc.done), -1)
        joins = (F.size(acc.done) > 0) & (F.length(acc.open) < low) & (
            F.length(last) + 1 + F.length(acc.open) <= high)
        return F.when(acc.open == "", acc.done).when(joins, F.concat(
            F.slice(acc.done, 1, F.greatest(F.size(acc.done) - 1, F.lit(0))),
            F.array(F.concat(last, F.lit(" "), acc.open)))
        ).otherwise(F.concat(acc.done, F.array(acc.open)))

    return segments.select(
        *[c for c in segments.columns if c != "text"],
        F.posexplode(F.aggregate(sentences, start, add, finish)).alias("idx", "text"))


def flatten_items(parents: DataFrame, keys: list[str], items: str = "items") -> DataFrame:
    """Items of every parent as rows stamped with the parent's keys and the position."""
    return parents.select(*keys, F.posexplode(items).alias("item_idx", "item"))


def chunk_stats(chunks: DataFrame, lessons: DataFrame) -> DataFrame:
    """Export manifest row per module.  Lessons are counted from the lesson table."""
    by_type = chunks.groupBy("module").agg(
        F.count(F.lit(1)).alias("num_chunks"),
        *[F.count_if(F.col("type") == t).alias(n) for t, n in (
            ("prose", "num_prose"), ("definition", "num_definitions"),
            ("key_number", "num_key_numbers"), ("process", "num_processes"))])
    counted = lessons.groupBy("module").agg(F.count(F.lit(1)).alias("num_lessons"))
    return counted.join(by_type, "module", "left").na.fill(0)


def embedding_dims(vectors: DataFrame, group: str, expected: str) -> DataFrame:
    """Dimension check per export: rows without a vector are skipped; mixed, missing
    or unexpected dimensions fail, naming the first offending row.

    ``expected`` is the dimension a former export recorded (0: no check).
    """
    size = F.coalesce(F.size("embedding"), F.lit(0))
    per_dim = (
        vectors.where(size > 0).groupBy(group, size.alias("dim"))
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    )
    first = per_dim.groupBy(group).agg(
        F.min(F.struct("first_id", "dim")).alias("f"), F.sum("n").alias("embedded"),
        F.count(F.lit(1)).alias("n_dims"))
    other = (
        per_dim.join(first.select(group, "f"), group).where(F.col("dim") != F.col("f.dim"))
        .groupBy(group).agg(F.min(F.struct("first_id", "dim")).alias("o"))
    )
    totals = vectors.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), F.max(expected).alias("expected"))
    dim = F.col("f.dim")
    status = (
        F.when(F.col("embedded").isNull(), "no vectors")
        .when(F.col("n_dims") > 1, F.concat(
            F.lit("mixed: row "), "o.first_id", F.lit(" has "), "o.dim", F.lit(", others "), dim))
        .when((F.col("expected") > 0) & (dim != F.col("expected")), F.concat(
            F.lit("expected "), "expected", F.lit(", got "), dim))
        .otherwise("ok")
    )
    return (
        totals.join(first, group, "left").join(other, group, "left")
        .select(group, "rows", F.coalesce("embedded", F.lit(0)).alias("embedded"), status.alias("status"))
        .withColumn("ok", F.col("status") == "ok")
    )


def _mark(text: Column) -> Column:
    """A text's 128-bit mark; a null text has one of its own."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def resume_carry(fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """Finished work carried over where id and text are unchanged.

    Marks of the texts are compared first, so no text is shuffled to find what stays, and only the
    payloads of chunks that stay are moved.  A null text equals a null one.
    """
    mark, same = _mark(F.col("text")), ["id", "mark"]
    marked = fresh.withColumn("mark", mark)
    stays = stored(marked.select(*same).join(prior.select("id", mark.alias("mark")), same, "left_semi").distinct(), "stays")
    payload = prior.select(
        "id", mark.alias("mark"), F.col("enrichment").alias("old_enrichment"),
        F.when(F.size("embedding") > 0, F.col("embedding")).alias("old_embedding")).join(stays, same, "left_semi")
    return (
        marked.join(payload, same, "left").withColumn("enrichment", F.col("old_enrichment"))
        .withColumn("embedding", F.col("old_embedding")).drop("mark", "old_enrichment", "old_embedding")
    )


def carry_counts(carried: DataFrame) -> DataFrame:
    return carried.groupBy("module").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count("enrichment").alias("carried_enrichment"),
        F.count("embedding").alias("carried_embedding"))


def parse_enrichment(raw: DataFrame) -> DataFrame:
    """Model output as a nested column; rows that do not parse keep it null and are
    marked for the retry pass."""
    body = X.strip_fence(F.col("raw"))
    # a corrupt-record field would hide which field broke; the object test is enough
    is_object = body.rlike(r"(?s)\A\{.*\}\z") & F.try_parse_json(body).isNotNull()
    return raw.withColumn("enrichment", F.when(
        is_object, F.from_json(body, schemas.ENRICHMENT))).withColumn(
        "status", F.when(F.col("enrichment").isNull(), "retry").otherwise("ok"))


def embed_input(text: Column) -> Column:
    """What the embedder is sent first: at most 1800 bytes, characters kept whole."""
    return X.cut_bytes(text, EMBED_BYTES)


def shrink_ladder(text: Column) -> Column:
    """The inputs tried in turn when the embedder reports an overflow: each half as
    long in bytes as the one before, none below 256 bytes."""
    def halve(rungs: Column, _: Column) -> Column:
        last = F.element_at(rungs, -1)
        half = F.floor(F.octet_length(last) / 2).cast("int")
        return F.when(half >= EMBED_FLOOR, F.concat(
            rungs, F.array(X.cut_bytes_at(last, half)))).otherwise(rungs)

    return F.aggregate(F.sequence(F.lit(1), F.lit(EMBED_RETRIES)),
                       F.array(embed_input(text)), halve)


def new_documents(documents: DataFrame, present: DataFrame) -> DataFrame:
    """Lesson documents whose file name the target does not have yet."""
    named = documents.withColumn("file_name", F.format_string(
        "%s_lesson_%03d.md", "module", "lesson_index"))
    return named.join(present.select("file_name"), "file_name", "left_anti")


VECTOR = ["id", "text", "embedding", "module", "lesson_index", "lesson_title", "type", "term"]


def vector_table(spark: SparkSession, path: str, buckets: int = 32) -> KeyedTable:
    """The stored vectors, in buckets by a hash of their id."""
    return KeyedTable(spark, path, ["id"], buckets)


def latest_vectors(incoming: DataFrame) -> DataFrame:
    """A batch's last row (by ``row``) per id, of those that have a vector."""
    return (
        incoming.where(F.size("embedding") > 0)
        .groupBy("id").agg(F.max_by(F.struct(*VECTOR[1:]), "row").alias("r")).select("id", "r.*")
    )


def upsert_vectors(table: KeyedTable, incoming: DataFrame, number: int) -> list[int]:
    """Write batch ``number`` into the stored vectors: rows with vectors replace those of the same id,
    rows without are skipped.

    Only the buckets that the batch's ids fall into are read and written anew; they are returned.
    A batch that is written again after a failure replaces what it had begun.
    """
    batch = stored(latest_vectors(incoming), "vectors")
    written = table.upsert(batch, number, ["id"])
    discard(batch)
    return written
