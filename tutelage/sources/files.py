"""Lesson trees, lesson and card files, golden sets, catalogs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tutelage import schemas
from tutelage.functions import text as X
from tutelage.operators.ordered import position

# Fixed value: image types the vision stage accepts.
IMAGE_TYPES = ["png", "jpg", "jpeg", "gif", "webp", "bmp", "svg"]

_STEP = r"([^/]+)/([^/]+)/(Lesson_[^/]+)/"

# Folder levels that are dealt out anew (courses, modules, lessons), and what a task
# hands over at once.
LEVELS = 3
BATCH_FILES, BATCH_BYTES = 1000, 8 << 20
_ENTRY = "path string, length long, content binary"


def _hidden(name: str) -> bool:
    """Names that Spark's readers skip too."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _open_folders(root: str, pattern: str, deep: bool, max_bytes: int | None):
    """Batches of entries to batches of entries: folders (no length) give what they hold.

    Files whose path does not match are dropped.  The ``deep`` step opens folders to the bottom and
    reads the files.
    """
    def run(batches):
        import re

        import pyarrow as pa
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(root)
        wanted = re.compile(pattern)
        out, held = [], 0

        def found(entries):
            for e in entries:
                if _hidden(e.base_name):
                    continue
                if e.type == fs.FileType.Directory:
                    yield e.path, None
                elif e.is_file and wanted.search(e.path) and (max_bytes is None or e.size <= max_bytes):
                    yield e.path, e.size

        def opened(path, length):
            if length is not None:
                yield path, length
                return
            for entry in found(system.get_file_info(fs.FileSelector(path))):
                if deep and entry[1] is None:
                    yield from opened(*entry)
                else:
                    yield entry

        def content(path):
            with system.open_input_file(path) as f:
                return f.read()

        def flushed():
            columns = zip(*out)
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))],
                                   ["path", "length", "content"])

        for batch in batches:
            for row in batch.select(["path", "length"]).to_pylist():
                for path, length in opened(row["path"], row["length"]):
                    out.append((path, length, content(path) if deep else None))
                    held += length if deep else 0
                    if len(out) >= BATCH_FILES or held >= BATCH_BYTES:
                        yield flushed()
                        out, held = [], 0
        if out:
            yield flushed()

    return run


def read_files(spark: SparkSession, root: str, pattern: str, max_bytes: int | None = None) -> DataFrame:
    """Files below ``root`` whose whole path has the ``pattern`` in it, as (path, length, content).

    Tasks list the folders, a level at a time, and read the files, so no list of files passes through
    the driver.  Files above ``max_bytes`` are left out unread.
    """
    from pyarrow import fs

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = spark.createDataFrame([(fs.FileSystem.from_uri(root)[1], None, None)], _ENTRY)
    for level in range(LEVELS + 1):
        # a count of its own, or the few bytes of names would be put together into one task
        entries = entries.repartition(tasks, "path").mapInArrow(
            _open_folders(root, pattern, level == LEVELS, max_bytes), _ENTRY)
    return entries


def scan_lessons(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Lessons of every course below ``root``: <course>/<module>/Lesson_*/lesson.md.

    The size comes from the file listing, so lessons above ``max_bytes`` are never read.
    """
    step = rf"{_STEP}lesson\.md$"
    return read_files(spark, root, step, max_bytes).select(
        F.regexp_extract("path", step, 1).alias("course"),
        F.regexp_extract("path", step, 2).alias("dir"),
        F.regexp_extract("path", step, 3).alias("lesson_dir"),
        F.col("length").alias("n_bytes"),
        F.decode("content", "UTF-8").alias("content"),
    )


def scan_assets(spark: SparkSession, root: str) -> DataFrame:
    """Image files of every lesson, with content hash; other types are marked."""
    step = rf"{_STEP}images/([^/]+)$"
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return read_files(spark, root, step).select(
        F.regexp_extract("path", step, 1).alias("course"),
        F.regexp_extract("path", step, 2).alias("dir"),
        F.regexp_extract("path", step, 3).alias("lesson_dir"),
        F.regexp_extract("path", step, 4).alias("name"),
        ext.alias("ext"), ext.isin(IMAGE_TYPES).alias("usable"),
        F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"),
    )


def load_lessons_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Processed lessons with their position in the document; unknown keys ignored.

    ``multiline`` reads one pretty-printed document per file, otherwise one per line.
    """
    schema = T.StructType([T.StructField("module", T.StringType()),
                           T.StructField("first", T.IntegerType()),
                           *schemas.PROCESSED_LESSONS.fields])
    docs = spark.read.schema(schema).json(path, multiLine=multiline)
    return docs.select("module", "first", F.posexplode("items").alias("pos", "i")).select(
        "module", (F.coalesce("first", F.lit(0)) + F.col("pos")).alias("lesson_index"), "i.*")


def load_cards(spark: SparkSession, path: str, deck_per_line: bool = False) -> DataFrame:
    """Cloze cards as bank rows, numbered by their place in the deck.

    A missing file is an empty deck.  The first card of an id wins in each deck; the same id in
    another deck is another card.  ``file`` names the deck's file.
    """
    try:
        decks = spark.read.text(path, wholetext=not deck_per_line).select(
            "value", F.col("_metadata.file_path").alias("file"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        decks = spark.createDataFrame([], "value string, file string")
    cards = decks.withColumn("deck", F.monotonically_increasing_id()).select("file", "deck", F.posexplode(F.from_json("value", T.ArrayType(schemas.CARD)))).select(
        "file", "deck", "pos", "col.*")
    first = cards.groupBy("file", "deck", "id").agg(F.min_by(F.struct(
        "module", "unit", F.col("unit").alias("unit_topic"), (F.col("pos") + 1).alias("num"),
        F.lit("number").alias("difficulty"), "prompt", "answer", "citation"), "pos").alias("c"))
    return first.select("id", "c.*", "file")


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden grades with a reject reason and the line number in their file.

    Blank lines are skipped but count as lines.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"))
    numbered = position(lines, ["file"], ["block", "n"], "line_no")
    rows = (
        numbered.where(F.col("value").rlike(r"\S"))
        .withColumn("v", F.try_parse_json("value"))
        .withColumn("g", F.from_json("value", schemas.GOLDEN))
    )
    wanted = F.get_json_object("value", "$.expected_quality")
    quality = F.coalesce("g.expected_quality", F.lit(0))
    reject = (
        F.when(F.col("v").isNull() | ~X.strip(F.col("value")).startswith("{")
               | (wanted.isNotNull() & F.col("g.expected_quality").isNull()), "not valid JSON")
        .when(F.coalesce("g.question_id", F.lit("")) == "", "question_id is required")
        .when((quality < 0) | (quality > 5), F.concat(
            F.lit("expected_quality "), quality, F.lit(" out of range 0-5")))
    )
    return rows.select(
        "file", "line_no", "g.question_id",
        F.coalesce("g.learner_answer", F.lit("")).alias("learner_answer"),
        quality.alias("expected_quality"),
        F.coalesce("g.rationale", F.lit("")).alias("rationale"), reject.alias("reject"))


def load_catalog(spark: SparkSession, path: str, multiline: bool = True
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Equation catalog as three tables: equations, variables, examples."""
    docs = spark.read.schema(schemas.CATALOG).json(path, multiLine=multiline)
    equations = docs.select("program", F.inline("equations"))
    variables = equations.select(
        F.col("id").alias("equation_id"), F.posexplode("vars").alias("pos", "v")).select(
        "equation_id", "pos", "v.*").withColumn(
        "role", F.coalesce(F.nullif("role", F.lit("")), F.lit("input"))).withColumn(
        "symbol", F.coalesce(F.nullif("symbol", F.lit("")), "name"))
    examples = equations.select(
        F.col("id").alias("equation_id"), F.posexplode("examples").alias("pos", "x")).select(
        "equation_id", "pos", "x.*")
    return equations, variables, examples
