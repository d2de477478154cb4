"""Grading, file, lint and build-step queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutelage.operators import aids, flows, grading, lint
from tutelage.plans import fixtures as fx
from tutelage.session import shared_dir
from tutelage.sources import files, sinks

SAQ_GLOB = "*SAQ*"


def _md5(name):
    return F.md5(F.encode(name, "UTF-8"))


# --- files: written once from the tables, then read back by the library ---------

def _lesson_tree(s, d):
    root = shared_dir(s, "lessons")
    lessons = fx.doc_lessons(s, d)
    sinks.write_files(lessons.select(
        F.concat_ws("/", "course", "dir", "lesson_dir", F.lit("lesson.md")).alias("path"),
        "content"), root)
    return root


def _scan_lessons(s, d):
    return files.scan_lessons(s, _lesson_tree(s, d)).select(
        "course", "dir", "lesson_dir", "n_bytes", _md5("content").alias("md5"))


def _scan_assets(s, d):
    root = shared_dir(s, "assets")
    sinks.write_files(fx.assets(s, d), root)
    return files.scan_assets(s, root)


def _load_lessons_json(s, d):
    path = shared_dir(s, "processed")
    lessons = fx.processed_lessons(s, d).select(
        "module", "lesson_index", "lesson", "lecture_content", "definitions", "key_numbers",
        "processes", F.lit("ignored").alias("related_images"))
    # one document per 100 lessons, so no document grows with a module
    docs = lessons.withColumn("first", (F.floor(F.col("lesson_index") / 100) * 100).cast("int"))
    body = F.to_json(F.struct(*[c for c in lessons.columns if c not in (
        "module", "lesson_index")]))
    docs.groupBy("module", "first").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("lesson_index", body.alias("body")))),
        lambda x: x.body), ",").alias("items")).select(F.concat(
            F.lit('{"module":"'), "module", F.lit('","first":'), "first", F.lit(',"items":['),
            "items", F.lit("]}")).alias("value")).write.text(path)
    return files.load_lessons_json(s, path, multiline=False).select(
        "module", "lesson_index", "lesson", _md5("lecture_content").alias("md5"),
        F.size("definitions").alias("definitions"), F.size("key_numbers").alias("key_numbers"),
        F.array_join("processes", ";").alias("processes"))


def _load_cards(s, d):
    path = shared_dir(s, "cards")
    key = F.col("p_partkey")
    cards = fx.table(s, d, "part").select(
        F.floor(key / 500).alias("deck"), key, F.struct(
            F.concat(F.lit("card"), (key - key % 3).cast("string")).alias("id"),
            F.col("p_brand").alias("module"), F.col("p_type").alias("unit"),
            F.col("p_name").alias("prompt"), F.col("p_size").cast("string").alias("answer"),
            F.lit("c").alias("citation")).alias("card"))
    cards.groupBy("deck").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("p_partkey", "card"))), lambda x: x.card))
        .alias("value")).select("value").write.text(path)
    return files.load_cards(s, path, deck_per_line=True).drop("file")


def _load_golden(s, d):
    path = shared_dir(s, "golden")
    fx.golden_lines(s, d).select("value").write.text(path)
    return files.load_golden(s, path).select(
        F.coalesce("question_id", F.lit("")).alias("question_id"), "learner_answer",
        "expected_quality", "reject")


def _write_chunks(s, d):
    path = shared_dir(s, "chunks")
    sinks.write_chunks(fx.chunks(s, d), path)
    return s.read.schema(
        "id string, lesson_index bigint, lesson_title string, type string, idx int, text string, "
        "term string, module string").json(path).select(
        "id", "module", "lesson_index", "lesson_title", "type", "idx", "term",
        _md5("text").alias("text_md5"))


def _write_flashcards(s, d):
    path = shared_dir(s, "cards-tsv")
    sinks.write_flashcards(aids.flashcards(fx.enriched_chunks(s, d)), path)
    back = s.read.csv(path, sep="\t", header=True, quote="", schema=(
        "ID string, Front string, Back string, Lesson string, Tags string"),
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return back.select(F.col("ID").alias("id"), F.col("Front").alias("front"),
                       F.coalesce("Back", F.lit("")).alias("back"),
                       F.col("Lesson").alias("lesson"), F.col("Tags").alias("tags"))


# --- grading -----------------------------------------------------------------

def _resolved(s, d):
    return grading.resolve_golden(fx.golden(s, d), fx.bank(s, d))


def _raw_verdicts(s, d):
    k = F.col("doc_id")
    body = F.concat(
        F.lit('{"quality": '), F.when(k % 11 == 4, '"good"').otherwise(
            (F.col("actual") * 2 - 2).cast("string")),
        F.lit(', "hits": ["a {1}", "b"], "misses": ["'), "learner_answer",
        F.lit('"], "explanation": "so"}'))
    raw = (F.when(k % 11 == 1, F.concat(F.lit("Sure:\n"), body, F.lit("\nDone.")))
           .when(k % 11 == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(k % 11 == 3, "I cannot grade this.").when(k % 11 == 5, "{quality 3}")
           .when(k % 11 == 6, '{"hits": []}').otherwise(body))
    return fx.golden(s, d).select("doc_id", "grader", raw.alias("raw"))


def _verdicts(s, d):
    return grading.parse_verdicts(_raw_verdicts(s, d))


def _stub():
    """Grades by length; very short answers need a second try, some never work."""
    def score(text: str, attempt: int) -> str | None:
        n = len(text)
        if n % 7 == 3 or (n % 5 == 2 and attempt == 1):
            return None
        return f'{{"quality": {n % 6}}}'
    return score


def _annotate(s, d):
    return grading.annotate(fx.golden(s, d), "doc_id", "learner_answer", lambda: _stub(), 4)


# --- build steps -----------------------------------------------------------------

def _merge(s, d):
    lessons = fx.processed_lessons(s, d).select(
        "module", "lesson_index", "lesson", F.size("processes").alias("n_processes"))
    parts = [lessons.where(F.col("lesson_index") % 3 == 0).drop("n_processes"),
             lessons.where(F.col("lesson_index") % 3 == 1),
             lessons.where(F.col("lesson_index") % 3 == 2).select(
                 "n_processes", "lesson", "lesson_index", "module")]
    return flows.merge_lessons(parts)


def _described(s, d):
    found = fx.assets(s, d)
    notes = flows.content_dedupe(found).select(
        "sha256", F.concat(F.lit("seen at "), "first_path").alias("description"))
    return flows.asset_descriptions(found, notes).select("path", "sha256", "description")


def _guide(s, d):
    lessons = fx.processed_lessons(s, d).select("module", "lesson_index", "lesson")
    sections = lessons.select("module", "lesson_index", F.concat(
        F.lit("# "), "lesson").alias("markdown"))
    k = F.regexp_extract("lesson", r"(\d+)", 1).cast("bigint")
    figures = lessons.select("module", "lesson_index", F.explode(F.array_compact(F.array(
        F.when(k % 2 == 0, "b.png"), F.when(k % 3 == 0, "a.SVG"), F.when(k % 4 == 0, "a.png")
    ))).alias("name"), k.cast("string").alias("k")).withColumn(
        "path", F.concat_ws("/", F.lit("/src"), "k", "name"))
    return flows.guide_sections(lessons, sections, figures)


def _passes(s, d):
    doc = fx.table(s, d, "documents").select(
        "source", "lang", F.col("doc_id").alias("lesson_index"), "n_chars")
    units = doc.groupBy("source", "lang").agg(
        (F.sum("n_chars") % 91 + 30).cast("int").alias("minutes"))
    return flows.split_passes(units, doc.drop("n_chars"), ["source", "lang"])


QUERIES = {
    "scan_lessons": _scan_lessons,
    "scan_assets": _scan_assets,
    "load_lessons_json": _load_lessons_json,
    "load_cards": _load_cards,
    "load_golden": _load_golden,
    "write_chunks": _write_chunks,
    "write_flashcards": _write_flashcards,
    "resolve_golden": lambda s, d: _resolved(s, d).select(
        "doc_id", "question_id", "expected", "prompt", "reject"),
    "grading_requests": lambda s, d: grading.grading_requests(_resolved(s, d)).select(
        "doc_id", "question_id", "request"),
    "parse_verdicts": lambda s, d: _verdicts(s, d).select(
        "doc_id", "grader", "quality", F.array_join("hits", ";").alias("hits"),
        F.array_join("misses", ";").alias("misses"), "explanation", "reject"),
    "verdict_rejects": lambda s, d: grading.verdict_rejects(_verdicts(s, d)),
    "eval_summary": lambda s, d: grading.eval_summary(fx.golden(s, d)),
    "annotate": _annotate,
    "module_summary": lambda s, d: lint.module_summary(
        fx.tree_modules(s, d), fx.tree_lessons(s, d), fx.assets(s, d), SAQ_GLOB),
    "lesson_order": lambda s, d: lint.lesson_order(fx.tree_lessons(s, d)),
    "course_findings": lambda s, d: lint.course_findings(
        fx.tree_modules(s, d), fx.tree_lessons(s, d), fx.assets(s, d), SAQ_GLOB),
    "course_verdict": lambda s, d: lint.course_verdict(lint.course_findings(
        fx.tree_modules(s, d), fx.tree_lessons(s, d), fx.assets(s, d), SAQ_GLOB)),
    "manifest_findings": lambda s, d: lint.manifest_findings(fx.course_rows(s, d)),
    "merge_lessons": _merge,
    "unique_by_key": lambda s, d: flows.unique_by_key(
        fx.table(s, d, "documents").select("text", "doc_id", "source"), "text", "doc_id").select(
        _md5("text").alias("md5"), "doc_id", "source"),
    "content_dedupe": lambda s, d: flows.content_dedupe(fx.assets(s, d)),
    "asset_descriptions": _described,
    "guide_sections": _guide,
    "split_passes": _passes,
    "corpus_budget": lambda s, d: flows.corpus_budget(fx.processed_lessons(s, d), 60_000).select(
        "module", "lesson_index", "before", F.octet_length("text").alias("bytes"),
        F.when(~F.col("is_cut"), _md5("text")).alias("md5")),
}
