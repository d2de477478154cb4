"""Chunk packing, byte cuts, aids and resume."""

import os

import pytest
from pyspark.sql import functions as F

from tutelage.functions import text as X
from tutelage.operators import aids as A
from tutelage.operators import chunks as C
from tutelage.plans.chunk_queries import QUERIES
from tutelage.session import shared_dir

SF = os.environ.get("TUTELAGE_SF", "/root/testdata/sf0.001")


def pack(spark, text, budget):
    return spark.range(1).select(C.pack_paragraphs(F.lit(text), budget)).first()[0]


def test_packing_counts_bytes(spark):
    assert pack(spark, "aaaa\n\nbbbb\n\ncccc", 10) == ["aaaa\n\nbbbb", "cccc"]
    assert pack(spark, "aaaa\n\nbbbb", 9) == ["aaaa", "bbbb"]
    assert pack(spark, "éé\n\néé", 9) == ["éé", "éé"]            # 4 + 4 + 2 bytes
    assert pack(spark, "x" * 50 + "\n\nb", 10) == ["x" * 50, "b"]
    assert pack(spark, " \n\n \t\n\n", 10) == []


def test_chunk_ids_do_not_collide(spark):
    df = spark.createDataFrame(
        [("m", 3, "T", "p1\n\np2", {"α-amylase": "a", "β-amylase": "b"}, {}, ["s"])],
        "module string, lesson_index bigint, lesson string, lecture_content string, "
        "definitions map<string,string>, key_numbers map<string,string>, processes array<string>")
    rows = {r.id: r for r in C.chunk_lessons(df).collect()}
    assert set(rows) == {"m_l003_prose_0", "m_l003_definition_0", "m_l003_definition_1",
                         "m_l003_process_0"}
    assert rows["m_l003_definition_1"].text == "β-amylase: b"


@pytest.mark.parametrize("text,limit", [("aé", 2), ("aé", 3), ("日本語", 7), ("😀😀", 7), ("abc", 2)])
def test_cut_bytes(spark, text, limit):
    got = spark.range(1).select(X.cut_bytes(F.lit(text), limit)).first()[0]
    want = text.encode()[:limit].decode(errors="ignore")
    assert got == want


def test_shrink_ladder(spark):
    rungs = spark.range(1).select(C.shrink_ladder(F.lit("é" * 2000))).first()[0]
    assert [len(r.encode()) for r in rungs] == [1800, 900, 450]


def test_speech_chunks_preserve_text(spark):
    text = " ".join(f"Sentence number {i} has a few words in it." for i in range(60)) + " End."
    df = spark.createDataFrame([(1, text)], "k int, text string")
    parts = [r.text for r in C.speech_chunks(df).orderBy("idx").collect()]
    assert " ".join(parts) == text
    assert all(200 <= len(p) <= 700 for p in parts)


def test_flashcard_text(spark):
    e = ("struct<summary:string,key_terms:array<string>,multiple_choice:array<struct<question:"
         "string,options:array<string>,correct_index:int,explanation:string>>,short_answer:"
         "array<struct<question:string,answer:string>>>")
    df = spark.createDataFrame(
        [("c1", "m", 1, "T", ("s", [], [("Q\t1", list("pqrstuvw"), 6, "no\r\nletter")],
                              [("why", 'a "b"')]))],
        f"id string, module string, lesson_index bigint, lesson_title string, enrichment {e}")
    mc, sa = A.flashcards(df).orderBy("id").collect()
    assert mc.id == "c1_mc_0" and mc.front.startswith("Q: Q    1<br>A. p<br>B. q")
    assert mc.front.endswith("F. u") and mc.back == "<br><br>no<br>letter"
    assert (sa.id, sa.back) == ("c1_sa_0", 'a "b"')
    assert mc.tags == "module::m lesson::001 type::prose question_type::mc"


def test_long_documents_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(A, "PIECES_PER_PART", 2)
    df = spark.createDataFrame([(i, f"p{i};") for i in range(5)], "idx int, piece string")
    rows = A._joined(df.withColumn("k", F.lit(1)), ["k"]).orderBy("part").collect()
    assert [r.body for r in rows] == ["p0;p1;", "p2;p3;", "p4;"]


def test_parse_enrichment_marks_retries(spark):
    raws = ['```json\n{"summary":"s"}\n```', "``` {\"summary\":\"t\"}```", "nope", '{"summary":']
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = [(r.status, r.enrichment.summary if r.enrichment else None)
           for r in C.parse_enrichment(df).collect()]
    assert got == [("ok", "s"), ("ok", "t"), ("retry", None), ("retry", None)]


def test_upsert_replaces_by_id_and_skips_empty(spark, tmp_path):
    schema = ("id string, text string, embedding array<float>, module string, lesson_index int, "
              "lesson_title string, type string, term string, row int")

    def rows(*r):
        return spark.createDataFrame(
            [(i, t, v, "m", 0, "", "prose", None, n) for n, (i, t, v) in enumerate(r)], schema)

    table = C.vector_table(spark, str(tmp_path / "vectors"), buckets=8)
    C.upsert_vectors(table, rows(*[(k, "old", [1.0]) for k in "abdefgh"]), 0)
    second = rows(("a", "new1", [2.0]), ("a", "new2", [3.0]), ("b", "none", []), ("c", "new", [4.0]))
    for _ in range(2):      # run again after a failure: the same table
        written = C.upsert_vectors(table, second, 1)
        assert {b for b, v in table.versions().items() if 1 in v} == set(written) and len(written) <= 2
        got = {r.id: (r.text, r.embedding) for r in table.read().collect()}
        assert got == {**{k: ("old", [1.0]) for k in "bdefgh"}, "a": ("new2", [3.0]), "c": ("new", [4.0])}
    assert C.upsert_vectors(table, rows(("z", "none", [])), 2) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_lessons_are_numbered_without_their_texts(spark):
    """Texts are written once, also where chunks meet the enrichment made of them."""
    base = os.path.dirname(shared_dir(spark, "x")).removeprefix("file://")
    before = set(os.listdir(base))
    assert QUERIES["lesson_documents"](spark, SF).count() > 0
    made = [n for n in set(os.listdir(base)) - before if "text" in spark.read.parquet(f"{base}/{n}").columns]
    assert [n.rsplit("-", 1)[0] for n in made] == ["lessons"]
