"""Explicit schemas of the files the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])


TEXT_MAP = T.MapType(_S, _S)
TEXTS = T.ArrayType(_S)

PROCESSED_LESSON = _fields(
    lesson=_S, lecture_content=_S, definitions=TEXT_MAP, key_numbers=TEXT_MAP,
    processes=TEXTS, common_mistakes=TEXTS, exam_focus=TEXTS)
PROCESSED_LESSONS = _fields(items=T.ArrayType(PROCESSED_LESSON))

ENRICHMENT = _fields(
    summary=_S, key_terms=TEXTS,
    multiple_choice=T.ArrayType(_fields(
        question=_S, options=TEXTS, correct_index=_I, explanation=_S)),
    short_answer=T.ArrayType(_fields(question=_S, answer=_S)))

CARD = _fields(id=_S, module=_S, unit=_S, prompt=_S, answer=_S, citation=_S)

GOLDEN = _fields(question_id=_S, learner_answer=_S, expected_quality=_I, rationale=_S)

VERDICT = _fields(quality=_I, hits=TEXTS, misses=TEXTS, explanation=_S)

VARIABLE = _fields(
    name=_S, symbol=_S, unit=_S, desc=_S, role=_S, min=_D, max=_D, step=_D, value=_D,
    decimals=_I)
EXAMPLE = _fields(inputs=T.MapType(_S, _D), expected=_D, tol=_D, note=_S)
EQUATION = _fields(
    id=_S, module=_S, topic=_S, name=_S, source=_S, expr=_S, vars=T.ArrayType(VARIABLE),
    result=_fields(symbol=_S, unit=_S, desc=_S, decimals=_I), prompt=_S, use_note=_S,
    citation=_S, examples=T.ArrayType(EXAMPLE))
CATALOG = _fields(program=_S, equations=T.ArrayType(EQUATION))
