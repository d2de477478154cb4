"""Table steps of the media build: merging, dedupe, passes, guides, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutelage.functions import text as X
from tutelage.operators.ordered import position, running_sum

# Fixed values.
CORPUS_BYTES = 220_000
PASS_MINUTES = (60, 90)     # up to the first: one pass, up to the second: two, else three


def merge_lessons(parts: Sequence[DataFrame]) -> DataFrame:
    """Per-lesson outputs with differing columns as one ordered collection."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.orderBy("module", "lesson_index")


def unique_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key, by ``order``.  Copies are reduced before the shuffle."""
    rest = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.min_by(rest, order).alias("r")).select(key, "r.*")


def content_dedupe(assets: DataFrame) -> DataFrame:
    """One row per distinct content with its first path and number of referrers.

    Referrers keep their hash in the asset table, so they are not collected here.
    """
    return assets.groupBy(F.sha2("content", 256).alias("sha256")).agg(
        F.min("path").alias("first_path"), F.count(F.lit(1)).alias("referrers"),
        F.max(F.octet_length("content")).alias("n_bytes"))


def asset_descriptions(assets: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Every referring asset with the one description of its content."""
    hashed = assets.withColumn("sha256", F.sha2("content", 256)).drop("content")
    return hashed.join(descriptions, "sha256")


def guide_sections(lessons: DataFrame, sections: DataFrame, figures: DataFrame) -> DataFrame:
    """Lines of the study guide: each lesson's section, then its figures by name.

    Vector files are skipped.  Order by (module, lesson_index, kind, name).
    """
    where = ["module", "lesson_index"]
    body = lessons.select(*where).join(sections, where).select(
        *where, F.lit(0).alias("kind"), F.lit("").alias("name"), "markdown")
    shown = figures.where(~F.lower("name").endswith(".svg")).join(
        lessons.select(*where), where, "left_semi")
    head = shown.select(*where).distinct().select(
        *where, F.lit(1).alias("kind"), F.lit("").alias("name"), F.lit("### Figures")
        .alias("markdown"))
    lines = shown.select(*where, F.lit(2).alias("kind"), "name", F.concat(
        F.lit("!["), "name", F.lit("]("), "path", F.lit(")")).alias("markdown"))
    return body.unionByName(head).unionByName(lines)


def split_passes(units: DataFrame, lessons: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Lessons of each unit cut into one, two or three runs of near-equal length.

    ``units`` gives the minutes; the first runs get the extra lessons.
    """
    unit = list(unit)
    placed = position(lessons, unit, ["lesson_index"], "pos")
    sizes = lessons.groupBy(*unit).agg(F.count(F.lit(1)).alias("size"))
    passes = (F.when(F.col("minutes") <= PASS_MINUTES[0], 1)
              .when(F.col("minutes") <= PASS_MINUTES[1], 2).otherwise(3))
    plan = units.join(sizes, unit).withColumn("passes", passes)
    rows = placed.join(plan, unit)
    short = F.floor(F.col("size") / F.col("passes"))
    extra = F.col("size") % F.col("passes")
    at = F.col("pos") - 1
    in_long = at < extra * (short + 1)
    number = F.when(in_long, F.floor(at / (short + 1))).otherwise(
        extra + F.floor(F.try_divide(at - extra * (short + 1), short)))
    return rows.select(*unit, "lesson_index", "passes", (number + 1).cast("int").alias("pass_no"),
                       (F.col("minutes") / F.col("passes")).alias("target_minutes"))


def corpus_text(lessons: DataFrame) -> DataFrame:
    """The equation-bearing text of each lesson."""
    numbers = F.array_join(F.transform(F.array_sort(F.map_entries("key_numbers")), lambda e: F.concat(
        F.lit("- "), e.key, F.lit(": "), e.value, F.lit("\n"))), "")
    steps = F.array_join(F.transform("processes", lambda p: F.concat(
        F.lit("- "), p, F.lit("\n"))), "")
    return lessons.select("module", "lesson_index", F.concat(
        F.lit("## "), "lesson", F.lit("\n\n"), X.strip(F.col("lecture_content")), F.lit("\n"),
        F.when(numbers != "", F.concat(F.lit("\nKey numbers:\n"), numbers)).otherwise(""),
        steps, F.lit("\n")).alias("text"))


def corpus_budget(lessons: DataFrame, budget: int = CORPUS_BYTES) -> DataFrame:
    """Lessons in order until the byte budget is crossed, the crossing one cut.

    Lengths are summed without the texts; only kept lessons' texts are joined back.
    """
    texts = corpus_text(lessons)
    sized = texts.select("module", "lesson_index", F.octet_length("text").cast("bigint").alias("n"))
    total = running_sum(sized, ["module"], ["lesson_index"], F.col("n"), "upto")
    kept = total.withColumn("before", F.col("upto") - F.col("n")).where(F.col("before") <= budget)
    room = (F.lit(budget) - F.col("before")).cast("int")
    return kept.join(texts, ["module", "lesson_index"]).select(
        "module", "lesson_index", "before", (F.col("upto") > budget).alias("is_cut"),
        X.cut_bytes_at(F.col("text"), room).alias("text"))
