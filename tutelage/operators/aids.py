"""Study aids: glossary, key numbers, flashcards, Q&A and lesson documents.

Documents come as ordered parts.  A part holds at most 500 consecutive pieces of
one section, so no group grows without bound however long a lesson is; a normal
lesson has one part per section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutelage.functions import text as X

LETTERS = "ABCDEF"   # fixed value: options shown on a card
PIECES_PER_PART = 500


def glossary(lessons: DataFrame) -> DataFrame:
    """One definition per term and module, case ignored: the first lesson wins."""
    terms = lessons.select("module", "lesson_index", F.explode("definitions").alias("t", "d"))
    return (
        terms.groupBy("module", F.lower(X.strip("t")).alias("canon"))
        .agg(F.min(F.struct("lesson_index", "t", "d")).alias("w"))
        .select("module", "canon", X.strip(F.col("w.t")).alias("term"),
                X.strip(F.col("w.d")).alias("definition"))
        .orderBy("module", "canon")
    )


def key_numbers(lessons: DataFrame) -> DataFrame:
    """Numbers to remember per lesson, sorted by their text."""
    pairs = F.array_sort(F.map_entries("key_numbers"))
    return lessons.select("module", "lesson_index", "lesson", F.posexplode(pairs).alias(
        "pos", "e")).select("module", "lesson_index", "lesson", "pos",
                            F.col("e.key").alias("value"), F.col("e.value").alias("context"))


def escape_tsv(text: Column) -> Column:
    text = F.replace(text, F.lit("\t"), F.lit("    "))
    return F.regexp_replace(text, r"\r\n|\r|\n", "<br>")


def _letter(i: Column) -> Column:
    return F.substring(F.lit(LETTERS), i + 1, F.lit(1))


def flashcards(chunks: DataFrame) -> DataFrame:
    """Multiple-choice and short-answer cards of every enriched chunk."""
    base = chunks.where(F.col("enrichment").isNotNull()).withColumn("tags", F.format_string(
        "module::%s lesson::%03d type::prose", "module", "lesson_index"))
    keep = ["module", "lesson_index", "lesson_title", "tags"]

    def card(q: Column, i: Column, kind: str, front: Column, back: Column) -> Column:
        return F.struct(
            F.concat("id", F.lit(f"_{kind}_"), i.cast("string")).alias("id"),
            escape_tsv(front).alias("front"), escape_tsv(back).alias("back"),
            escape_tsv(F.concat("tags", F.lit(f" question_type::{kind}"))).alias("tags"))

    def choice(q: Column, i: Column) -> Column:
        shown = F.slice(q.options, 1, len(LETTERS))
        front = F.concat(F.lit("Q: "), q.question, F.array_join(F.transform(
            shown, lambda o, j: F.concat(F.lit("<br>"), _letter(j), F.lit(". "), o)), ""))
        c = q.correct_index
        lettered = F.concat(_letter(c), F.lit(". "), F.coalesce(F.get(q.options, c), F.lit("")))
        why = F.when(F.coalesce(q.explanation, F.lit("")) != "", F.concat(
            F.lit("<br><br>"), q.explanation)).otherwise("")
        back = F.concat(F.when(c.between(0, len(LETTERS) - 1), lettered).otherwise(""), why)
        return card(q, i, "mc", front, back)

    def short(q: Column, i: Column) -> Column:
        return card(q, i, "sa", q.question, q.answer)

    none = F.expr("cast(array() as array<struct<id:string,front:string,back:string,tags:string>>)")
    cards = F.concat(
        F.coalesce(F.transform("enrichment.multiple_choice", choice), none),
        F.coalesce(F.transform("enrichment.short_answer", short), none))
    return base.select(*keep[:2], escape_tsv(F.col("lesson_title")).alias("lesson"),
                       F.inline(cards))


def deck_guids(cards: DataFrame) -> DataFrame:
    """Note ids of a deck: blank cards skipped, a repeated card id told apart by its
    row.  ``row`` is the card's place in the deck."""
    front, back = X.strip(F.col("front")), X.strip(F.col("back"))
    seeded = cards.where((front != "") & (back != "")).withColumn("seed", F.when(
        X.strip(F.col("id")) != "", X.strip(F.col("id"))).otherwise(
        F.concat(front, F.lit("::"), back)))
    first = seeded.groupBy("deck", "seed").agg(F.min("row").alias("first_row"))
    unique = F.when(F.col("row") == F.col("first_row"), F.col("seed")).otherwise(
        F.concat("seed", F.lit(":"), "row"))
    return seeded.join(first, ["deck", "seed"]).select(
        "deck", "row", "id", F.substring(F.sha2(unique, 256), 1, 16).alias("guid"),
        (F.col("row") != F.col("first_row")).alias("repeated"))


def _questions_text(e: Column) -> Column:
    """Questions of one enrichment as markdown."""
    def option(correct: Column):
        return lambda o, j: F.concat(
            F.lit("  "), _letter(j), F.lit(". "), o,
            F.when(j == correct, " ✓").otherwise(""), F.lit("\n"))

    def choice(q: Column, i: Column) -> Column:
        why = F.when(F.coalesce(q.explanation, F.lit("")) != "", F.concat(
            F.lit("\n  _"), q.explanation, F.lit("_\n"))).otherwise("")
        return F.concat(
            F.lit("**MC "), (i + 1).cast("string"), F.lit(".** "), q.question, F.lit("\n\n"),
            F.array_join(F.transform(F.slice(q.options, 1, len(LETTERS)),
                                     option(q.correct_index)), ""), why, F.lit("\n"))

    def short(q: Column, i: Column) -> Column:
        return F.concat(F.lit("**SA "), (i + 1).cast("string"), F.lit(".** "), q.question,
                        F.lit("\n\n> "), q.answer, F.lit("\n\n"))

    return F.concat(F.array_join(F.transform(e.multiple_choice, choice), ""),
                    F.array_join(F.transform(e.short_answer, short), ""))


def _joined(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces (``idx``, ``piece``) put together in order, 500 to a part."""
    return (
        pieces.withColumn("part", F.floor(F.col("idx") / PIECES_PER_PART).cast("int"))
        .groupBy(*keys, "part")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "piece"))),
                                      lambda p: p.piece), "").alias("body"))
    )


def study_qa(chunks: DataFrame) -> DataFrame:
    """Questions and answers per lesson, in chunk order, as markdown parts."""
    e = F.col("enrichment")
    summary = F.when(F.coalesce(e.summary, F.lit("")) != "", F.concat(
        F.lit("**Summary**: "), e.summary, F.lit("\n\n"))).otherwise("")
    pieces = chunks.where(e.isNotNull()).withColumn(
        "piece", F.concat(summary, _questions_text(e)))
    body = _joined(pieces, ["module", "lesson_index", "lesson_title"])
    head = F.when(F.col("part") == 0, F.concat(
        F.lit("\n## "), "lesson_title", F.lit("\n\n"))).otherwise("")
    return body.select("module", "lesson_index", "part",
                       F.concat(head, "body").alias("markdown"))


# Section order and headings of a lesson document.
SECTIONS = [("prose", "## Lecture content\n\n"), ("definition", "## Definitions\n\n"),
            ("key_number", "## Key numbers\n\n"), ("process", "## Processes\n\n")]
QUESTIONS_HEAD = "## Study questions\n\n"


def lesson_documents(chunks: DataFrame) -> DataFrame:
    """Chunks put back together as markdown, section by section.

    A lesson's document is its rows in (section, part) order; section 0 is the title.
    """
    kind = F.col("type")
    section = F.lit(None).cast("int")
    for i, (name, _) in enumerate(SECTIONS):
        section = F.when(kind == name, i + 1).otherwise(section)
    entry = F.concat(F.lit("- **"), "term", F.lit("** — "), F.substring(
        F.col("text"), F.length("term") + 3, F.length("text")), F.lit("\n"))
    piece = (
        F.when(kind == "prose", F.concat("text", F.lit("\n\n")))
        .when(kind == "process", F.concat(F.lit("- "), "text", F.lit("\n")))
        .otherwise(entry)
    )
    where = ["module", "lesson_index"]
    source = chunks.select(*where, section.alias("section"), "idx", piece.alias("piece"))
    asked = chunks.where((kind == "prose") & F.col("enrichment").isNotNull()).select(
        *where, F.lit(len(SECTIONS) + 1).alias("section"), "idx",
        _questions_text(F.col("enrichment")).alias("piece"))
    title = chunks.groupBy(*where).agg(F.concat(
        F.lit("# "), F.min("lesson_title"), F.lit("\n\n")).alias("markdown")).select(
        *where, F.lit(0).alias("section"), F.lit(0).alias("part"), "markdown")
    body = _joined(source.unionByName(asked), [*where, "section"])
    first = F.col("part") == 0
    head = F.lit("")
    for i, text in enumerate([t for _, t in SECTIONS] + [QUESTIONS_HEAD]):
        # a list section is closed by a blank line before the next heading
        head = F.when(first & (F.col("section") == i + 1), text).otherwise(head)
    return body.select(*where, "section", "part", F.concat(head, "body").alias("markdown")
                       ).unionByName(title)
