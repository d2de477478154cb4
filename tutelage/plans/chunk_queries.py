"""Chunk and study-aid queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutelage.operators import aids as A
from tutelage.operators import chunks as C
from tutelage.operators.ordered import position
from tutelage.plans import fixtures as fx
from tutelage.session import shared_dir, stored


def _docs(s, d):
    return fx.table(s, d, "documents").select("doc_id", "text")


def _md5(name):
    return F.md5(F.encode(name, "UTF-8"))


def _vectors(s, d):
    v, n = F.col("vec_id"), F.col("label")
    none = F.array().cast("array<float>")
    return fx.table(s, d, "embeddings").select(
        v.alias("id"), n.alias("export"),
        F.when((v % 10 == 3) | (n == 5), none)
        .when((n == 3) & (v % 4 == 1), F.slice("embedding", 1, 32))
        .otherwise(F.col("embedding")).alias("embedding"),
        F.when(n == 6, 128).when(n == 7, 0).otherwise(64).alias("expected"))


def _fresh_and_prior(s, d):
    chunks = fx.chunks(s, d)
    i = F.col("lesson_index") + F.col("idx")
    prior = chunks.where(i % 5 != 0).select(
        "id", F.when(i % 7 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("type") == "prose", F.struct(F.lit("done").alias("summary")))
        .alias("enrichment"),
        F.when(i % 3 == 0, F.array().cast("array<float>")).otherwise(
            F.array(F.lit(1.0).cast("float"))).alias("embedding"))
    return chunks, prior


def _carried(s, d):
    return C.resume_carry(*_fresh_and_prior(s, d))


def _with_enrichment(s, d):
    chunks = fx.chunks(s, d)
    return C.resume_carry(chunks, fx.enriched_chunks(s, d, chunks).withColumn(
        "embedding", F.lit(None).cast("array<float>")))


def _cards(s, d):
    cards = A.flashcards(fx.enriched_chunks(s, d)).withColumnRenamed("module", "deck")
    placed = position(stored(cards, "cards"), ["deck"], ["lesson_index", "id"], "row")
    short = F.regexp_replace("id", "_(mc|sa)_0$", "")
    return stored(placed, "deck").withColumn("row", F.col("row") - 1).withColumn(
        "id", F.when(F.col("row") % 3 == 0, "  ").otherwise(short))


def _segments(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg", "text"))


def _upserted(s, d):
    e = fx.table(s, d, "embeddings")
    v = F.col("vec_id")

    def rows(key, tag, keep):
        return e.select(
            F.concat(F.lit("v"), key.cast("string")).alias("id"),
            F.concat(F.lit(tag), v.cast("string")).alias("text"),
            F.when(keep, F.col("embedding")).otherwise(F.array().cast("array<float>"))
            .alias("embedding"),
            F.concat(F.lit("module_"), F.col("label")).alias("module"),
            F.col("label").alias("lesson_index"), F.lit("t").alias("lesson_title"),
            F.lit("prose").alias("type"), F.lit(None).cast("string").alias("term"),
            v.alias("row"))

    new = rows(F.floor(v / 2) * 3, "new ", v % 4 != 1)
    half = F.lit(e.agg(F.max("vec_id")).scalar()) / 2
    vectors = C.vector_table(s, shared_dir(s, "vectors"), buckets=8)
    for number, batch in enumerate([rows(v * 2, "old ", F.lit(True)), new.where(F.col("row") < half), new.where(F.col("row") >= half)]):
        C.upsert_vectors(vectors, batch, number)
    return vectors.read()


QUERIES = {
    "chunk_paragraphs": lambda s, d: C.chunk_paragraphs(_docs(s, d), sep="\n").select(
        "doc_id", "idx", F.octet_length("text").alias("bytes"), _md5("text").alias("text_md5")),
    "chunk_lessons": lambda s, d: fx.chunks(s, d).select(
        "id", "module", "lesson_index", "lesson_title", "type", "idx", "term",
        _md5("text").alias("text_md5")),
    "chunk_stats": lambda s, d: C.chunk_stats(fx.chunks(s, d), fx.processed_lessons(s, d)),
    "speech_chunks": lambda s, d: C.speech_chunks(_segments(s, d)).select(
        "doc_id", "seg", "idx", "text"),
    "flatten_items": lambda s, d: C.flatten_items(_docs(s, d).select(
        "doc_id", F.split("text", "\n").alias("items")), ["doc_id"]),
    "embedding_dims": lambda s, d: C.embedding_dims(_vectors(s, d), "export", "expected"),
    "resume_carry": lambda s, d: _carried(s, d).select(
        "id", F.col("enrichment").isNotNull().alias("enriched"),
        F.col("embedding").isNotNull().alias("embedded")),
    "carry_counts": lambda s, d: C.carry_counts(_carried(s, d)),
    "parse_enrichment": lambda s, d: C.parse_enrichment(fx.raw_enrichment(s, d)).select(
        "id", "status", F.col("enrichment.summary").alias("summary"),
        F.size("enrichment.key_terms").alias("terms"),
        F.col("enrichment.multiple_choice")[0].correct_index.alias("correct"),
        F.size(F.col("enrichment.multiple_choice")[0].options).alias("options"),
        F.col("enrichment.short_answer")[0].answer.alias("answer")).na.fill(0, ["terms", "options"]
                                                                            ).replace(-1, 0, ["terms", "options"]),
    "glossary": lambda s, d: A.glossary(fx.processed_lessons(s, d)),
    "key_numbers": lambda s, d: A.key_numbers(fx.processed_lessons(s, d)),
    "flashcards": lambda s, d: A.flashcards(fx.enriched_chunks(s, d)),
    "deck_guids": lambda s, d: A.deck_guids(_cards(s, d)),
    "study_qa": lambda s, d: A.study_qa(fx.enriched_chunks(s, d)),
    "lesson_documents": lambda s, d: A.lesson_documents(_with_enrichment(s, d)).select(
        "module", "lesson_index", "section", "part", _md5("markdown").alias("md5"),
        F.length("markdown").alias("chars")),
    "new_documents": lambda s, d: C.new_documents(
        fx.processed_lessons(s, d).select("module", "lesson_index"),
        fx.processed_lessons(s, d).where("lesson_index % 3 = 0").select(F.format_string(
            "%s_lesson_%03d.md", "module", "lesson_index").alias("file_name"))),
    "upsert_vectors": lambda s, d: _upserted(s, d).select(
        "id", "text", F.size("embedding").alias("dim"), F.md5(F.array_join(F.transform(
            "embedding", lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string")), ",")).alias("vector_md5"),
        "module", "lesson_index", "type"),
}
