"""Sentences for the codes of findings, in one place; {0}, {1}, ... are a finding's details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCES = {
    "lesson_without_file": "This lesson folder holds no text file, so nothing is made of it.",
    "lesson_empty": "The text file has no content.",
    "lesson_too_large": "With {0} bytes the text is above the largest size that is taken in (1 MiB); it is left out. Divide it.",
    "lesson_not_read_whole": "With {0} bytes the text is above 200 KiB: steps that take all lessons together pass over it.",
    "lesson_cut_unevenly": "With {0} bytes the text is above 117 KiB: later steps shorten it at unequal places.",
    "lesson_without_title": "The first line is no title of the first level; one will be made up.",
    "lesson_misnamed": "A text lies in a folder of module {0} whose name does not begin with Lesson_; it is not used.",
    "module_absent": "There is no folder for module {0}.",
    "module_without_lessons": "Not one folder of module {0} can be used as a lesson.",
    "lessons_skipped": "Lessons of module {0} that are left out: {1}.",
    "vector_figures": "Module {0} has {1} drawings in vector form, of which {2} have no pixel version.",
    "module_unlisted": "The folder has the form of a module, yet the course does not name it.",
    "image_type": "Images of the type '{0}' are not read.",
    "numbers_repeat": "{0} lesson numbers stand for more than one lesson, so their lessons are mixed up.",
    "order_lexical": "By name, {0} is put ahead of {1}, against their numbers; leading zeros would mend that.",
    "no_assessment": "Assessment lessons are announced, but no lesson is one.",
    "missing": "A value is needed here.",
    "version_unknown": "Version {0} of the format is not known.",
    "slug_form": "'{0}' is not of the form a-z, 0-9 and -, with 1 to 64 characters and no - in front.",
    "preset_unknown": "There is no preset named '{0}'; use none or saq.",
    "placeholder": "'{0}' has been left from the template.",
    "number_not_positive": "{0} is no module number; they start at 1.",
    "number_repeated": "Number {0} belongs to an earlier module.",
}


def sentence(code: Column, detail: Column) -> Column:
    """The sentence of a finding, its details filled in."""
    texts = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    return F.aggregate(
        F.transform(F.split(detail, r"\|"), lambda d, i: F.struct(F.concat(F.lit("{"), i, F.lit("}")).alias("mark"), d.alias("text"))),
        F.element_at(texts, code), lambda acc, d: F.replace(acc, d["mark"], d["text"]))


def worded(findings: DataFrame) -> DataFrame:
    """``findings`` with the column ``message``."""
    return findings.withColumn("message", sentence(F.col("code"), F.col("detail")))
