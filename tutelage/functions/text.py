"""Text rules as column expressions.

Sizes are in bytes (octet_length) wherever a limit is meant, because the limits
are byte limits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\s\x0B\x85\p{Z}]"
WS_CHARS = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"

# Markdown patterns of assessment lessons.
FIGURE = r"!\[[^\]]*\]\(([^)]+)\)"
TOP_ITEM = r"(?md)^(\d+)\.\s"
ANY_HEADING = r"(?md)^(#{1,6})\s"
RESPONSE_LABEL = r"(?imd)^[ \t]*(?:\*\*)?[ \t]*(?:response|answer)[ \t]*:(?:\*\*)?[ \t]*$"
LESSON_PREFIX = r"(?i)^lesson[ _]+\d+[ _\-]*"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (trim alone drops spaces only)."""
    return F.btrim(text, F.lit(WS_CHARS))


def squash(text: Column) -> Column:
    """Lower case with whitespace runs collapsed: the form ids and topics compare in."""
    return F.trim(F.regexp_replace(F.lower(text), rf"{WS}+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def module_label(ref: Column) -> Column:
    """Loose module reference to module_N, by its first digit 1-9 (so 10 gives 1)."""
    digit = F.regexp_extract(ref, "[1-9]", 0)
    return F.when(digit != "", F.concat(F.lit("module_"), digit)).otherwise("")


def clean(text: Column) -> Column:
    """Readable text: escapes undone, blanks and blank lines collapsed."""
    for escaped, plain in ((r"\*", ""), (r"\#", "#"), (r"\_", "_"), (r"\-", "-")):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))
    return strip(F.regexp_replace(text, r"---\z", ""))


def strip_figures(text: Column) -> Column:
    return F.regexp_replace(text, FIGURE, "")


def difficulty_tier(text: Column) -> Column:
    """short / progressive / long from the leading run of (escaped) asterisks."""
    head = F.regexp_replace(text, r"\A[ \t\n]+", "")
    head = F.regexp_replace(head, r"\A\d+\.\s[ \t]*", "")
    run = F.regexp_extract(head, r"\A[*\\ \t]*", 0)
    stars = F.length(F.regexp_replace(run, r"[^*]", ""))
    return (
        F.when(stars >= 3, "long").when(stars == 2, "progressive").when(stars == 1, "short")
        .otherwise("")
    )


def strip_difficulty(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\A[ \t\n]+", ""), r"\A[*\\ \t]+", "")


def unit_topic(unit: Column, glob: str) -> Column:
    """Unit name without its lesson prefix and the fixed token of the lesson glob."""
    name = F.regexp_replace(F.regexp_replace(unit, LESSON_PREFIX, ""), r"^[- ]+|[- ]+$", "")
    token = glob.strip("*")
    if token:
        tail = rf"(?i)(?<=.){re.escape(token)}$"
        cut = F.regexp_replace(strip(F.regexp_replace(name, tail, "")), r"[- ]+$", "")
        name = F.when(name.rlike(tail), cut).otherwise(name)
    return strip(name)


def glob_to_regex(glob: Column) -> Column:
    """Shell glob (``*``, ``?``, sets) as an anchored regular expression; an empty
    glob accepts every name."""
    quoted = F.regexp_replace(glob, r"([.+(){}|^$\\])", r"\\$1")
    body = F.replace(F.replace(quoted, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    return F.when(glob == "", F.lit(".*")).otherwise(F.concat(F.lit("^"), body, F.lit("$")))


def heading_regex(template: str) -> str:
    """Heading template as a pattern: case ignored, a hyphen also matches en and em
    dashes, ``{n}`` captures the number."""
    parts = ["[-–—]".join(re.escape(p) for p in lit.split("-")) for lit in template.split("{n}")]
    return r"(?imd)^[ \t]*" + r"(\d+)".join(parts) + r"[ \t]*$"


def heading_level(template: str) -> int:
    return len(template) - len(template.lstrip("#"))


def cut_bytes_at(text: Column, limit: Column) -> Column:
    """At most ``limit`` bytes without splitting a character.

    A character has at most three continuation bytes, so the cut moves back at
    most three places from ``limit`` to a byte that starts a character.
    """
    raw = F.encode(text, "UTF-8")

    def starts(n: Column) -> Column:
        byte = F.conv(F.hex(F.substring(raw, n + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.lit(0xC0)) != 0x80

    keep = F.coalesce(*[F.when(starts(limit - b), limit - b) for b in range(4)], limit)
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.decode(F.substring(raw, F.lit(1), keep), "UTF-8"))


def cut_bytes(text: Column, limit: int) -> Column:
    return cut_bytes_at(text, F.lit(limit))


def strip_fence(text: Column) -> Column:
    """Drop a surrounding markdown code fence."""
    text = F.regexp_replace(strip(text), r"\A```(?:json)?", "")
    return strip(F.regexp_replace(text, r"```\z", ""))


def last_path(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def clean_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` steps of a relative path."""
    none = F.array().cast("array<string>")
    return F.aggregate(
        F.split(path, "/"), none,
        lambda acc, step: F.when(step.isin("", "."), acc)
        .when((step == "..") & (F.size(acc) > 0) & (F.element_at(
            F.concat(F.array(F.lit("")), acc), -1) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(step))),
        lambda acc: F.array_join(acc, "/"))


def check_sheets(sheets: DataFrame) -> DataFrame:
    """Equation sheets (``raw``): fence dropped, must start with a heading; counts the
    third-level headings below the first line, one per equation."""
    body = strip(F.regexp_replace(F.regexp_replace(
        strip(F.col("raw")), r"\A```(?:markdown|md)?", ""), r"```\z", ""))
    status = (F.when(body == "", "empty").when(~body.startswith("#"), "not markdown")
              .otherwise("ok"))
    return sheets.withColumn("sheet", body).withColumn("status", status).withColumn(
        "equations", F.when(status == "ok", F.regexp_count(body, F.lit(r"\n### "))).otherwise(0))


# What the two prompt consumers keep of a lesson, in characters.
GUIDE_CHARS, LECTURE_CHARS = 120_000, 150_000


def prompt_view(lessons: DataFrame) -> DataFrame:
    """Lesson text as the study-guide and lecture prompts see it: inline data images
    dropped, each cut at its own length; ``diverges`` where the two differ."""
    body = F.regexp_replace("content", r"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+", "")
    return lessons.withColumn("guide_view", F.left(body, F.lit(GUIDE_CHARS))).withColumn(
        "lecture_view", F.left(body, F.lit(LECTURE_CHARS))).withColumn(
        "diverges", F.length(body) > GUIDE_CHARS)
