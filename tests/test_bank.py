"""Question extraction from irregular lesson markdown."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tutelage.functions import text as X
from tutelage.operators import bank as B

LESSON = """# Rivers

## Self-Assessment Questions

1. \\* Name two rivers.
2. \\*\\* Fill in:
   1. first blank
   2. second blank

![map](images/../images/map.png) ![far](https://far.example/x.png)

3. \\*\\*\\* Explain   deltas.
3. \\*\\*\\* Explain deltas again.

## Suggested Response - Q1

\\* Name two rivers.

Response:

- Nile
- Amur

### Aside

Kept.

## suggested response – q2

**response:**

Both blanks.

## Suggested Response — Q3

A delta forms slowly. ---

# End

not an answer
"""


def lessons(spark, text, name="Lesson_02_Big_Rivers_SAQ"):
    return spark.createDataFrame(
        [("c", "module_1", name, f"Module_1/{name}", text)],
        "course string, module string, lesson_dir string, rel string, content string")


@pytest.fixture(scope="module")
def extracted(spark):
    return {r.num: r for r in B.extract_bank(lessons(spark, LESSON), B.SAQ).collect()}


def test_sections_and_labels(extracted):
    assert set(extracted) == {1, 2, 3}
    assert extracted[1].prompt == "Name two rivers."
    assert extracted[1].answer == "- Nile\n- Amur\n\n### Aside\n\nKept."
    assert extracted[2].answer == "Both blanks."
    assert extracted[3].answer == "A delta forms slowly."
    assert [extracted[i].difficulty for i in (1, 2, 3)] == ["short", "progressive", "long"]


def test_nested_list_stays_inside_its_item(extracted):
    assert "second blank" in extracted[2].prompt
    assert extracted[2].figures == ["Module_1/Lesson_02_Big_Rivers_SAQ/images/map.png"]


def test_repeated_number_last_wins(extracted):
    assert extracted[3].prompt == "Explain deltas again."


def test_identity(extracted):
    q = extracted[1]
    assert q.unit_topic == "Big Rivers"
    assert q.citation == "module_1 / Lesson 02 Big Rivers SAQ › Q1"
    digest = hashlib.sha256(
        b"module_1|lesson 02 big rivers saq|name two rivers.").hexdigest()[:8]
    assert q.id == f"module_1.lesson-02-big-rivers-saq.q{digest}"
    assert q.aliases == ["module_1.lesson-02-big-rivers-saq.q1"]
    assert q.points == ["Nile", "Amur"]


def test_id_survives_renumbering_and_reflow(spark):
    one = "## Self-Assessment Questions\n\n1. What is  silt?\n\n## Suggested Response - Q1\n\nMud."
    two = ("## Self-Assessment Questions\n\n1. New one?\n2. What is silt?\n\n"
           "## Suggested Response - Q2\n\nMud.")
    ids = [B.extract_bank(lessons(spark, t), B.SAQ).first().id for t in (one, two)]
    assert ids[0] == ids[1]


def test_heading_shape_keeps_unanswered(spark):
    text = "## Question 1\n\nWhy?\n\n## Answer 1\n\nSo.\n\n## Question 2\n\nHow?\n"
    shape = B.Markers("", "## Question {n}", "## Answer {n}", "")
    rows = {r.num: r for r in B.extract_bank(lessons(spark, text), shape).collect()}
    assert (rows[1].prompt, rows[1].answer) == ("Why?", "So.")
    assert (rows[2].prompt, rows[2].answer, rows[2].points) == ("How?", "", [])


def test_gates(spark):
    assert B.extract_bank(lessons(spark, ""), B.SAQ).count() == 0
    assert B.extract_bank(lessons(spark, LESSON + "x" * (1 << 20)), B.SAQ).count() == 0
    assert B.extract_bank(lessons(spark, LESSON, "Lesson_02_Rivers"), B.SAQ).count() == 0


def test_leading_bold_label_counts_as_asterisks(spark):
    text = ("## Self-Assessment Questions\n\n1. Plain?\n\n## Suggested Response - Q1\n\n"
            "**Response:**\n\nYes.")
    assert B.extract_bank(lessons(spark, text), B.SAQ).first().difficulty == "progressive"


def test_points(spark):
    texts = ["- a\n- b\n* c\n12. d", "one\n\ntwo\nlines\n\n", "single", "  ", "1234. no\n-\n- "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.p for r in df.select(B.points_of(F.col("t")).alias("p")).collect()]
    assert got == [["a", "b", "c", "d"], ["one", "two\nlines"], ["single"], [], ["1234. no\n-\n-"]]


@pytest.mark.parametrize("raw,label", [
    ("module_2", "module_2"), ("M2", "module_2"), ("2", "module_2"), ("module_10", "module_1"),
    ("", ""), ("zero 0", "")])
def test_module_label(spark, raw, label):
    assert spark.range(1).select(X.module_label(F.lit(raw))).first()[0] == label


def test_glob(spark):
    names = ["Lesson_1_SAQ", "Lesson_1", "Unit_SAQ_2"]
    df = spark.createDataFrame([(n,) for n in names], "n string")

    def match(glob):
        return [r.n for r in df.where(F.rlike("n", X.glob_to_regex(F.lit(glob)))).collect()]

    assert match("*SAQ*") == ["Lesson_1_SAQ", "Unit_SAQ_2"]
    assert match("Lesson_?") == ["Lesson_1"]
    assert match("") == names



def test_migration_keeps_state_and_merges_history(spark):
    from tests.test_study import attempts
    from tutelage.operators import study

    log = attempts(spark, [(1, "old", 0, 5, 3), (1, "old", 1, 5, 3), (1, "new", 2, 1, 0),
                           (2, "old", 0, 5, 3), (2, "old", 1, 5, 3)])
    aliases = spark.createDataFrame([("old", "new")], "alias string, id string")
    state, history = B.migrate_ids(study.item_state(log), log, aliases)
    got = {r.learner_id: r for r in state.collect()}
    assert not got[1].mastered and got[1].attempts == 1     # own state wins, no refold
    assert got[2].mastered and got[2].topic == "new"
    assert history.where("learner_id = 1 and topic = 'new'").count() == 3


def test_prompt_view(spark):
    df = spark.createDataFrame([("a ![x](data:image/png;base64,AAAA+/=) b",), ("y" * 130_000,)],
                               "content string")
    short, long = X.prompt_view(df).collect()
    assert short.guide_view == "a ![x]() b" and not short.diverges
    assert len(long.guide_view) == 120_000 and len(long.lecture_view) == 130_000 and long.diverges
