"""Question bank queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutelage.operators import bank as B
from tutelage.operators import study
from tutelage.plans import fixtures as fx

HEADED = B.Markers("*Quiz*", "## Question {n}", "## Answer {n}", "")


def _module_order():
    return F.regexp_extract("module", r"(\d+)", 1).cast("int")


def _bank(s, d):
    return B.extract_bank(fx.list_lessons(s, d), B.SAQ).unionByName(
        B.extract_bank(fx.heading_lessons(s, d), HEADED))


def _flat(bank):
    return bank.withColumn("points", F.array_join("points", "¦")).withColumn(
        "figures", F.array_join("figures", "¦")).withColumn(
        "aliases", F.array_join("aliases", "¦"))


def _doc_questions(s, d):
    """Every document as one question of its source's unit, twice spelled."""
    doc = fx.table(s, d, "documents")
    return doc.select(
        F.concat(F.lit("module_"), F.regexp_extract("source", r"(\d+)", 1)).alias("module"),
        F.concat(F.lit("Lesson "), F.col("lang"), F.lit(" SAQ")).alias("unit"),
        F.col("doc_id").alias("num"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  "), F.translate("text", "aeiou", "AEIOU"), F.lit("\n")))
        .otherwise(F.col("text")).alias("prompt"))


def _figure_texts(s, d):
    doc = fx.table(s, d, "documents")
    ref = F.concat(F.lit("![a]( ../img/"), "doc_id", F.lit(".png ) "))
    return doc.select(
        "doc_id", F.concat(F.lit("Module_1/Lesson_"), "doc_id").alias("rel"),
        F.concat(ref, F.col("text"), F.lit(" ![b](http://x.example/y.png)![c](./c.svg)")
                 ).alias("text"))


def _answers(s, d):
    doc = fx.table(s, d, "documents")
    lines = F.split("text", "\n")
    marked = F.transform(lines, lambda x, i: F.concat(
        F.when(F.col("doc_id") % 3 == 0, F.when(i % 2 == 0, "- ").otherwise("12. "))
        .otherwise(""), x))
    return doc.select("doc_id", F.array_join(
        marked, "\n").alias("a"), F.array_join(lines, "\n\n").alias("b")).select(
        "doc_id", F.when(F.col("doc_id") % 3 == 1, F.col("b")).otherwise(F.col("a"))
        .alias("answer"))


def _aliases(s, d):
    """Every fifth part was once recorded under another part's id."""
    key = F.col("p_partkey")
    return fx.table(s, d, "part").where(key % 5 == 0).select(
        key.cast("string").alias("alias"), (key + key % 2 + 1).cast("string").alias("id"))


def _migrated(s, d):
    log = fx.attempts(s, d)
    return B.migrate_ids(study.item_state(log), log, _aliases(s, d))


QUERIES = {
    "size_gate": lambda s, d: B.size_gate(fx.doc_lessons(s, d).withColumn(
        "n_bytes", F.when(F.col("doc_id") % 97 == 0, 0).otherwise(F.col("n_bytes") * 60))).select(
        "doc_id", "n_bytes", "status", "in_course", "in_bank"),
    "assessment_filter": lambda s, d: B.assessment_filter(
        fx.doc_lessons(s, d), fx.doc_lessons(s, d).select("course").distinct().withColumn(
            "lesson_pattern", F.when(F.col("course") == "course_en", "*SAQ*")
            .when(F.col("course") == "course_fr", "Lesson_?_*").otherwise(""))).select(
        "course", "dir", "lesson_dir"),
    "stable_ids": lambda s, d: B.stable_ids(_doc_questions(s, d)).select("num", "id", "legacy_id"),
    "id_collisions": lambda s, d: B.id_collisions(B.stable_ids(_doc_questions(s, d))),
    "extract_figures": lambda s, d: B.extract_figures(_figure_texts(s, d)).select(
        "doc_id", "pos", "figure", F.md5(F.encode("text", "UTF-8")).alias("text_md5")),
    "decompose_points": lambda s, d: B.decompose_points(_answers(s, d)),
    "split_sections": lambda s, d: B.split_sections(
        fx.list_lessons(s, d), B.SAQ.answer_heading).select(
        "course", "module", "lesson_dir", "pos", "num",
        F.regexp_replace("body", r"\s+", " ").alias("body")),
    "question_list": lambda s, d: B.question_list(fx.list_lessons(s, d), B.SAQ),
    "question_headings": lambda s, d: B.question_headings(fx.heading_lessons(s, d), HEADED),
    "extract_bank": lambda s, d: _flat(_bank(s, d)),
    "dedupe_bank": lambda s, d: _flat(B.dedupe_bank(
        _bank(s, d).withColumn("id", F.md5("prompt")), _module_order())).select(
        "id", "course", "module", "lesson_dir", "num", "prompt"),
    "lessons_in_manifest": lambda s, d: B.lessons_in_manifest(
        fx.doc_lessons(s, d), fx.listed_modules(s, d)).select(
        "course", "module", "module_order", "lesson_dir", "n_bytes"),
    "unlisted_modules": lambda s, d: B.unlisted_modules(
        fx.doc_lessons(s, d), fx.listed_modules(s, d)),
    "resolve_markers": lambda s, d: B.resolve_markers(fx.course_rows(s, d)),
    "migrate_ids": lambda s, d: _migrated(s, d)[0],
    "migrate_history": lambda s, d: _migrated(s, d)[1].select(
        "learner_id", "topic", "ts", "seq", "quality", "confidence"),
}
