"""Question banks out of lesson markdown.

Everything about one lesson is worked out inside its row with array expressions,
so extraction needs no shuffle; a lesson is at most 1 MiB by the size gate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutelage.functions import text as X

# Size gate and the built-in marker set.
MAX_LESSON_BYTES = 1 << 20
BATCH_READ_BYTES = 200 * 1024
TRUNCATE_BYTES = 120 * 1000


@dataclass(frozen=True)
class Markers:
    """How a corpus marks its questions and answers."""

    lesson_pattern: str = ""
    question_heading: str = ""
    answer_heading: str = ""
    difficulty_marker: str = ""

    @property
    def per_question(self) -> bool:
        return "{n}" in self.question_heading


# Fixed values of the preset "saq".
SAQ = Markers(
    lesson_pattern="*SAQ*",
    question_heading="## Self-Assessment Questions",
    answer_heading="## Suggested Response - Q{n}",
    difficulty_marker="escaped-asterisks",
)


def _before(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, 2)[0]


def _numbered_parts(text: Column, pattern: str) -> Column:
    """array<struct<num, body>>: what follows each match of a numbered pattern."""
    nums = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    bodies = F.split(text, pattern, -1)
    return F.transform(nums, lambda n, i: F.struct(
        n.try_cast("int").alias("num"), F.get(bodies, i + 1).alias("body")))


def sections_of(content: Column, template: str, stop: str = "") -> Column:
    """Sections opened by a numbered heading; each ends at the next such heading,
    at the stop heading, or at a heading of the same or a higher level."""
    level = X.heading_level(template)
    parts = _numbered_parts(content, X.heading_regex(template))

    def cut(body: Column) -> Column:
        if stop:
            body = _before(body, X.heading_regex(stop))
        return _before(body, rf"(?md)^#{{1,{level}}}\s") if level else body

    return F.transform(parts, lambda s: F.struct(s.num.alias("num"), cut(s.body).alias("body")))


def list_items_of(content: Column, markers: Markers) -> Column:
    """Top-level items of the one ordered list under the question heading.

    The list ends at the first answer heading or at any heading.
    """
    rest = F.get(F.split(content, X.heading_regex(markers.question_heading), 2), F.lit(1))
    block = _before(_before(rest, X.heading_regex(markers.answer_heading)), X.ANY_HEADING)
    return _numbered_parts(block, X.TOP_ITEM)


def _last_wins(parts: Column) -> Column:
    """Drop entries whose number comes again later."""
    nums = F.transform(parts, lambda p: p.num)
    return F.filter(parts, lambda p, i: ~F.array_contains(
        F.slice(nums, i + 2, F.greatest(F.size(nums), F.lit(1))), p.num))


def split_sections(lessons: DataFrame, template: str, stop: str = "") -> DataFrame:
    return lessons.select("*", F.posexplode(
        sections_of(F.col("content"), template, stop))).select(
            *[c for c in lessons.columns if c != "content"], "pos", "col.num", "col.body")


def _halves(df: DataFrame, markers: Markers) -> DataFrame:
    """Prompt, figures and difficulty from the question-side text ``seg``."""
    tier = X.difficulty_tier(F.col("seg")) if markers.difficulty_marker else F.lit("")
    body = F.col("seg") if markers.per_question else X.strip_difficulty(F.col("seg"))
    return (
        df.withColumn("q_prompt", X.clean(X.strip_figures(body)))
        .withColumn("q_figures", figures_in(F.col("seg"), F.col("rel")))
        .withColumn("q_difficulty", tier)
    )


def _side(lessons: DataFrame, markers: Markers, parts: Column) -> DataFrame:
    return (
        _halves(
            lessons.withColumn("q", F.explode(_last_wins(parts)))
            .withColumn("seg", _segment(F.col("q.body"), markers)), markers)
        .select("course", "module", "lesson_dir", F.col("q.num").alias("num"),
                F.col("q_prompt").alias("prompt"),
                F.array_join("q_figures", ";").alias("figures"),
                F.col("q_difficulty").alias("difficulty"))
    )


def _segment(body: Column, markers: Markers) -> Column:
    return body if markers.per_question else X.strip(body)


def question_list(lessons: DataFrame, markers: Markers) -> DataFrame:
    """Question side of the one-list shape."""
    return _side(lessons, markers, list_items_of(F.col("content"), markers))


def question_headings(lessons: DataFrame, markers: Markers) -> DataFrame:
    """Question side of the one-heading-per-question shape."""
    return _side(lessons, markers, sections_of(
        F.col("content"), markers.question_heading, markers.answer_heading))


def figures_in(text: Column, rel: Column) -> Column:
    """Local image references as paths below the source root."""
    refs = F.transform(F.regexp_extract_all(text, F.lit(X.FIGURE), F.lit(1)), X.strip)
    local = F.filter(refs, lambda r: (r != "") & ~r.startswith("http"))
    return F.transform(local, lambda r: X.clean_path(F.concat_ws("/", rel, r)))


def extract_figures(questions: DataFrame) -> DataFrame:
    """One row per figure reference plus the text without any."""
    return questions.select(
        "*", F.posexplode_outer(figures_in(F.col("text"), F.col("rel"))).alias("pos", "figure"),
    ).withColumn("text", X.strip_figures(F.col("text")))


def points_of(answer: Column) -> Column:
    """Scoreable points: list items, else blank-line paragraphs."""
    listed = F.filter(F.transform(F.split(answer, "\n"), lambda line: X.strip(
        F.regexp_extract(X.strip(line), r"^(?:[-*]|[0-9]{1,3}\.) (.*)$", 1))),
        lambda p: p != "")
    paragraphs = F.filter(F.transform(F.split(answer, "\n\n"), X.strip), lambda p: p != "")
    return F.when(F.size(listed) > 0, listed).otherwise(paragraphs)


def decompose_points(answers: DataFrame) -> DataFrame:
    return answers.select(
        *[c for c in answers.columns if c != "answer"],
        F.posexplode(points_of(F.col("answer"))).alias("pos", "point"))


def stable_id(module: Column, unit: Column, prompt: Column) -> Column:
    key = F.concat_ws("|", X.squash(module), X.squash(unit), X.squash(prompt))
    return F.concat(module, F.lit("."), X.slug(unit), F.lit(".q"),
                    F.substring(F.sha2(key, 256), 1, 8))


def legacy_id(module: Column, unit: Column, num: Column) -> Column:
    return F.concat(module, F.lit("."), X.slug(unit), F.lit(".q"), num.cast("string"))


def stable_ids(questions: DataFrame) -> DataFrame:
    args = F.col("module"), F.col("unit")
    return questions.withColumn("id", stable_id(*args, F.col("prompt"))).withColumn(
        "legacy_id", legacy_id(*args, F.col("num")))


def id_collisions(identified: DataFrame) -> DataFrame:
    """Ids carried by more than one question, with how many spellings they have."""
    spelled = identified.groupBy("id", F.sha2("prompt", 256).alias("spelling")).agg(
        F.count(F.lit(1)).alias("n"))
    return spelled.groupBy("id").agg(
        F.sum("n").alias("questions"), F.count(F.lit(1)).alias("spellings")
    ).where("questions > 1")


def readable(lessons: DataFrame) -> DataFrame:
    """Lessons the bank reads: not empty and not above the size gate."""
    return lessons.where(F.octet_length("content").between(1, MAX_LESSON_BYTES))


def in_pattern(lessons: DataFrame, glob: str) -> DataFrame:
    return lessons.where(F.rlike("lesson_dir", X.glob_to_regex(F.lit(glob))))


def extract_bank(lessons: DataFrame, markers: Markers) -> DataFrame:
    """The question bank of a set of lessons.

    Answer sections lead in the one-list shape.  In the heading shape questions
    without an answer section also enter, with an empty answer.
    """
    content = F.col("content")
    if not markers.question_heading:
        asked = F.expr("cast(array() as array<struct<num:int,body:string>>)")
    elif markers.per_question:
        asked = sections_of(content, markers.question_heading, markers.answer_heading)
    else:
        asked = list_items_of(content, markers)
    pieces = (
        in_pattern(readable(lessons), markers.lesson_pattern)
        .withColumn("asked", F.coalesce(_last_wins(asked), F.expr(
            "cast(array() as array<struct<num:int,body:string>>)")))
        .withColumn("told", sections_of(content, markers.answer_heading))
        .drop("content")
    )
    lookup = F.map_from_entries(F.col("asked"))
    both = F.transform("told", lambda t: F.struct(
        t.num.alias("num"), t.body.alias("section"),
        F.try_element_at(lookup, t.num).alias("seg")))
    if markers.per_question:
        nums = F.transform("told", lambda t: t.num)
        both = F.concat(both, F.transform(
            F.filter("asked", lambda a: ~F.array_contains(nums, a.num)),
            lambda a: F.struct(a.num.alias("num"), F.lit(None).cast("string").alias("section"),
                               a.body.alias("seg"))))
    rows = (
        pieces.select("course", "module", "lesson_dir", "rel", F.posexplode(both))
        .select("course", "module", "lesson_dir", "rel", "pos", "col.*")
        .withColumn("seg", _segment(F.col("seg"), markers))
        .withColumn("unit", F.translate("lesson_dir", "_", " "))
    )
    section = F.col("section")
    cut = F.split(section, X.RESPONSE_LABEL, 2)
    labelled = F.size(cut) > 1
    rows = _halves(rows, markers).withColumn("cut", cut)
    restated = F.when(labelled, X.clean(X.strip_figures(X.strip_difficulty(F.col("cut")[0]))))
    answer = F.when(section.isNull(), "").when(
        labelled, X.clean(F.get("cut", F.lit(1)))).otherwise(
        X.clean(X.strip_difficulty(section)))
    told_tier = X.difficulty_tier(section) if markers.difficulty_marker else F.lit("")
    prompt = F.coalesce(F.nullif("q_prompt", F.lit("")), restated)
    return (
        rows.withColumn("prompt", prompt).withColumn("answer", answer)
        .where(F.coalesce("prompt", F.lit("")) != "")
        .withColumn("difficulty", F.when(section.isNull(), "").otherwise(
            F.coalesce(F.nullif("q_difficulty", F.lit("")), told_tier, F.lit(""))))
        .select(
            stable_id(F.col("module"), F.col("unit"), F.col("prompt")).alias("id"),
            "course", "module", "lesson_dir", "unit",
            X.unit_topic(F.col("unit"), markers.lesson_pattern).alias("unit_topic"),
            "num", "pos", "difficulty", "prompt", "answer",
            points_of(F.col("answer")).alias("points"),
            F.concat("module", F.lit(" / "), "unit", F.lit(" › Q"), "num").alias("citation"),
            F.coalesce("q_figures", F.array().cast("array<string>")).alias("figures"),
            F.array(legacy_id(F.col("module"), F.col("unit"), F.col("num"))).alias("aliases"),
        )
    )


def dedupe_bank(bank: DataFrame, module_order: Column) -> DataFrame:
    """First question per id of each course in teaching order: module, lesson, position."""
    payload = F.struct(*[c for c in bank.columns if c not in ("course", "id")])
    order = F.struct(module_order, F.col("lesson_dir"), F.col("pos"))
    return bank.groupBy("course", "id").agg(F.min_by(payload, order).alias("q")).select("course", "id", "q.*")


def size_gate(lessons: DataFrame) -> DataFrame:
    """Class of each lesson by its size in bytes, and who still reads it.

    An empty lesson is an error but stays in the course; the bank drops it.
    """
    n = F.col("n_bytes")
    status = (
        F.when(n == 0, "empty").when(n > MAX_LESSON_BYTES, "dropped")
        .when(n > BATCH_READ_BYTES, "omitted_from_batches")
        .when(n > TRUNCATE_BYTES, "truncated").otherwise("ok")
    )
    return (
        lessons.withColumn("status", status)
        .withColumn("in_course", n <= MAX_LESSON_BYTES)
        .withColumn("in_bank", n.between(1, MAX_LESSON_BYTES))
    )


def assessment_filter(lessons: DataFrame, courses: DataFrame) -> DataFrame:
    """Lessons whose directory matches their course's own glob."""
    globs = courses.select("course", "lesson_pattern")
    return (
        lessons.join(globs, "course")
        .where(F.rlike("lesson_dir", X.glob_to_regex(F.col("lesson_pattern"))))
        .drop("lesson_pattern")
    )


def lessons_in_manifest(lessons: DataFrame, modules: DataFrame) -> DataFrame:
    """Lessons of listed modules with their place in the teaching order."""
    listed = modules.select("course", "dir", "num", "module_order")
    return lessons.join(listed, ["course", "dir"]).withColumn(
        "module", F.concat(F.lit("module_"), "num"))


def unlisted_modules(lessons: DataFrame, modules: DataFrame) -> DataFrame:
    """Module-shaped directories no manifest lists."""
    seen = lessons.where(F.col("dir").startswith("Module_")).groupBy("course", "dir").agg(
        F.count(F.lit(1)).alias("lessons"))
    return seen.join(modules.select("course", "dir"), ["course", "dir"], "left_anti")


# Fixed values of the presets, as a table.
PRESETS = [("saq", SAQ.lesson_pattern, SAQ.question_heading, SAQ.answer_heading,
            SAQ.difficulty_marker)]
MARKER_FIELDS = ["lesson_pattern", "question_heading", "answer_heading", "difficulty_marker"]


def resolve_markers(courses: DataFrame) -> DataFrame:
    """Preset values under explicit ones; bindings default to the course slug."""
    preset = X.strip(F.coalesce("preset", F.lit("")))

    def pick(i: int, field: str) -> Column:
        own = F.nullif(F.col(field), F.lit(""))
        given = F.lit(None).cast("string")
        for row in PRESETS:
            given = F.when(preset == row[0], row[i + 1]).otherwise(given)
        return F.coalesce(own, given, F.lit(""))

    resolved = courses.select(
        "course", "slug", *[pick(i, f).alias(f) for i, f in enumerate(MARKER_FIELDS)],
        F.coalesce(F.nullif("memory_slug", F.lit("")), "slug").alias("memory_slug"),
        F.coalesce(F.nullif("knowledge_collection", F.lit("")), "slug")
        .alias("knowledge_collection"),
        preset.alias("preset"), F.col("question_heading").alias("own_q"),
        F.col("answer_heading").alias("own_a"))
    claims = (~F.col("preset").isin("", "none")) | (F.coalesce("own_q", F.lit("")) != "") | (
        F.coalesce("own_a", F.lit("")) != "")
    return resolved.withColumn("has_material", claims).withColumn(
        "per_question", F.contains(F.col("question_heading"), F.lit("{n}"))
    ).drop("own_q", "own_a")


def migrate_ids(state: DataFrame, history: DataFrame, aliases: DataFrame
                ) -> tuple[DataFrame, DataFrame]:
    """Rename items recorded under former ids.

    ``aliases`` maps (alias -> id).  State is never folded again: where the new
    id already has an item, that item keeps its own state and only the history
    is merged.  Among several old ids of one new id the smallest one stands in.
    History needs no per-item list: its rows are re-keyed, and time orders them.
    """
    names = aliases.select(F.col("alias").alias("topic"), F.col("id").alias("new_id")).where(
        "topic <> new_id")
    renamed = state.join(names, "topic", "left").withColumn(
        "new_topic", F.coalesce("new_id", "topic"))
    payload = [c for c in state.columns if c not in ("learner_id", "topic")]
    rank = F.struct(F.col("new_id").isNotNull(), F.col("topic"))
    kept = renamed.groupBy("learner_id", "new_topic").agg(
        F.min_by(F.struct(*payload), rank).alias("s"),
        F.count(F.lit(1)).alias("merged_items"),
    ).select("learner_id", F.col("new_topic").alias("topic"), "s.*", "merged_items")
    moved = history.join(names, "topic", "left").withColumn(
        "topic", F.coalesce("new_id", "topic")).drop("new_id")
    return kept, moved
