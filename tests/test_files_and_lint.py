"""Files read and written, grading, lint, budgets."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tutelage.operators import wording, flows, grading, lint
from tutelage.sources import files, sinks


def test_lesson_tree(spark, tmp_path):
    base = tmp_path / "root" / "bio" / "Module_1" / "Lesson_01 A+B"
    os.makedirs(base / "images")
    (base / "lesson.md").write_text("# Hé\n")
    (base / "images" / "x.PNG").write_bytes(b"1")
    (base / "images" / "y.txt").write_bytes(b"1")
    os.makedirs(base.parent / "Notes")
    (base.parent / "Notes" / "lesson.md").write_text("no")
    lessons = files.scan_lessons(spark, str(tmp_path / "root")).collect()
    assert [(r.course, r.dir, r.lesson_dir, r.n_bytes, r.content) for r in lessons] == [
        ("bio", "Module_1", "Lesson_01 A+B", 6, "# Hé\n")]
    found = {r.name: r.usable for r in files.scan_assets(spark, str(tmp_path / "root")).collect()}
    assert found == {"x.PNG": True, "y.txt": False}


def test_trees_are_listed_by_tasks(spark, tmp_path):
    """No index of the files is held by the driver; names stay as they are, hidden ones are skipped."""
    names = ["a%2Bb.png", "c d+e.SVG", ".hidden.png", "_tmp.png", "plain"]
    for course, lessons in (("bio", 3), ("x/deep", 2)):
        for i in range(lessons):
            base = tmp_path / "root" / course / "Module_1" / f"Lesson_{i} é"
            os.makedirs(base / "images" / "more")
            (base / "lesson.md").write_text("x" * (10 + i))
            for name in names:
                (base / "images" / name).write_bytes(name.encode())
            (base / "images" / "more" / "no.png").write_bytes(b"1")
    found = files.scan_assets(spark, str(tmp_path / "root"))
    assert found.inputFiles() == []
    assert sorted((r.course, r.lesson_dir, r.name, r.usable, r.sha256) for r in found.collect()) == sorted(
        (c, f"Lesson_{i} é", n, "." in n, hashlib.sha256(n.encode()).hexdigest())
        for c, k in (("bio", 3), ("deep", 2)) for i in range(k) for n in (names[0], names[1], names[4]))


def test_large_lessons_are_not_read(spark, tmp_path):
    for i in range(5):
        base = tmp_path / "root" / "bio" / "Module_1" / f"Lesson_{i}"
        os.makedirs(base)
        (base / "lesson.md").write_text("x" * (10 + i))
    found = files.scan_lessons(spark, str(tmp_path / "root"), max_bytes=12)
    assert found.inputFiles() == []
    assert sorted((r.lesson_dir, r.n_bytes, r.content) for r in found.collect()) == [
        (f"Lesson_{i}", 10 + i, "x" * (10 + i)) for i in range(3)]


def test_lessons_json_multiline(spark, tmp_path):
    doc = {"items": [{"lesson": "a", "definitions": {"t": "d"}, "related_images": [1]},
                     {"lesson": "b", "processes": ["p"]}]}
    path = tmp_path / "l.json"
    path.write_text(json.dumps(doc, indent=2))
    rows = files.load_lessons_json(spark, str(path)).orderBy("lesson_index").collect()
    assert [(r.lesson_index, r.lesson) for r in rows] == [(0, "a"), (1, "b")]
    assert rows[0].definitions == {"t": "d"} and rows[1].processes == ["p"]


def test_cards(spark, tmp_path):
    assert files.load_cards(spark, str(tmp_path / "none.json")).count() == 0
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"id": "k", "prompt": "first"}, {"id": "k", "prompt": "second"},
                                {"id": "m", "prompt": "third"}]))
    got = {r.id: (r.num, r.prompt, r.difficulty) for r in files.load_cards(spark, str(path)).collect()}
    assert got == {"k": (1, "first", "number"), "m": (3, "third", "number")}
    (tmp_path / "decks").mkdir()
    for name, ids in (("a", "kml"), ("b", "zk")):
        (tmp_path / "decks" / f"{name}.json").write_text(json.dumps([{"id": i, "prompt": name} for i in ids]))
    rows = files.load_cards(spark, str(tmp_path / "decks")).collect()
    assert {(r.file[-6:], r.id, r.num) for r in rows} == {
        ("a.json", "k", 1), ("a.json", "m", 2), ("a.json", "l", 3), ("b.json", "z", 1), ("b.json", "k", 2)}


def test_golden_names_bad_lines(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"question_id":"a","expected_quality":3}\n\n{oops\n'
                    '{"expected_quality":1}\n{"question_id":"b","expected_quality":7}\n')
    rows = files.load_golden(spark, str(path)).orderBy("line_no").collect()
    assert [(r.line_no, r.reject) for r in rows] == [
        (1, None), (3, "not valid JSON"), (4, "question_id is required"),
        (5, "expected_quality 7 out of range 0-5")]


def test_flashcards_round_trip(spark, tmp_path):
    cards = spark.createDataFrame([("i", 'a "q" \\ x', " b", "l", "t1 t2")],
                                  "id string, front string, back string, lesson string, tags string")
    sinks.write_flashcards(cards.coalesce(1), str(tmp_path / "t"))
    part = [p for p in os.listdir(tmp_path / "t") if p.startswith("part")][0]
    lines = (tmp_path / "t" / part).read_text().splitlines()
    assert lines == ["ID\tFront\tBack\tLesson\tTags", 'i\ta "q" \\ x\t b\tl\tt1 t2']


def test_verdict_block_and_clamp(spark):
    raws = ['ok {"quality": 9, "hits": ["h"]} bye', "none", '{"misses": []}', '{"quality": "x"}',
            '{"quality": -2, "explanation": "e {y}"}']
    df = spark.createDataFrame([(i, "g", r) for i, r in enumerate(raws)],
                               "k int, grader string, raw string")
    got = grading.parse_verdicts(df).orderBy("k").collect()
    assert [r.quality for r in got] == [5, None, 0, None, 0]
    assert [r.reject for r in got] == [None, "no JSON object", None, "not valid JSON", None]


def test_eval_arithmetic(spark):
    df = spark.createDataFrame([("g", 3, 4), ("g", 3, 3), ("g", 3, 2)],
                               "grader string, expected int, actual int")
    s = grading.eval_summary(df).first()
    assert (s.exact_rate, s.within_one_rate, s.mean_signed_error) == (1 / 3, 1.0, 0.0)
    assert not s.passed


def _flaky():
    def score(text, attempt):
        if text == "down":
            raise grading.TransportError("gone")
        return None if text == "never" or (text == "later" and attempt < 3) else text.upper()
    return score


def test_annotate_retries_and_skips(spark):
    df = spark.createDataFrame([(1, "now", False), (2, "later", False), (3, "never", False),
                                (4, "done", True)], "k int, t string, d boolean")
    got = {r.k: (r.output, r.tries, r.status) for r in grading.annotate(
        df, "k", "t", lambda: _flaky(), 2, F.col("d")).collect()}
    assert got == {1: ("NOW", 1, "ok"), 2: ("LATER", 3, "ok"), 3: (None, 3, "failed")}


def test_annotate_stops_on_transport_error(spark):
    df = spark.createDataFrame([(1, "down")], "k int, t string")
    with pytest.raises(Exception, match="gone"):
        grading.annotate(df, "k", "t", lambda: _flaky(), 1).collect()


def tree(spark, names):
    return spark.createDataFrame([("c", "Module_1", n, 10) for n in names],
                                 "course string, dir string, lesson_dir string, n_bytes bigint")


@pytest.mark.parametrize("parts", [1, 5])
def test_lesson_order(spark, in_range_parts, parts):
    def finding(*names):
        rows = lint.lesson_order(tree(spark, names)).collect()
        return (rows[0].code, rows[0].detail) if rows else None

    assert finding("Lesson_1", "Lesson_2", "Lesson_10") == ("order_lexical", "Lesson_10|Lesson_2")
    assert finding("Lesson_01", "Lesson_02", "Lesson_10") is None
    assert finding("Lesson_1_a", "Lesson_1_b", "Lesson_2") == ("numbers_repeat", "1")


def test_findings_have_a_sentence(spark):
    rows = spark.createDataFrame([(c, "a$1|b|c") for c in wording.SENTENCES], "code string, detail string")
    got = {r.code: r.message for r in wording.worded(rows).collect()}
    assert got["order_lexical"].startswith("By name, a$1 is put ahead of b,")
    assert not [m for m in got.values() if not m or "{" in m]


def test_course_verdict_strict(spark):
    f = spark.createDataFrame([("a", "warning"), ("b", "error")], "course string, severity string")
    loose = {r.course: r.passed for r in lint.course_verdict(f).collect()}
    strict = {r.course: r.passed for r in lint.course_verdict(f, True).collect()}
    assert loose == {"a": True, "b": False, "(all)": False} and not strict["a"]


@pytest.mark.parametrize("parts", [1, 5])
def test_budget_and_passes(spark, in_range_parts, parts):
    lessons = spark.createDataFrame(
        [("m", i, "T", "x" * 84, {}, []) for i in range(40)],
        "module string, lesson_index bigint, lesson string, lecture_content string, "
        "key_numbers map<string,string>, processes array<string>")
    rows = flows.corpus_budget(lessons, 1000).orderBy("lesson_index").collect()
    size = len("## T\n\n") + 84 + 2
    assert sum(len(r.text) for r in rows) == 1000
    assert len(rows) == 1000 // size + 1 and rows[-1].is_cut
    units = spark.createDataFrame([("m", 100)], "module string, minutes int")
    got = flows.split_passes(units, lessons.select("module", "lesson_index").where(
        "lesson_index < 8"), ["module"]).orderBy("lesson_index").collect()
    assert [r.pass_no for r in got] == [1, 1, 1, 2, 2, 2, 3, 3]
