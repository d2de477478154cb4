"""Secret scan by DataFrame functions: spans in whole texts, and who else holds each value.

Kinds, in this order (fixed values; matched leftmost, without overlap, kind by kind):

  assign  a name such as password or api_key, then : or =, then a value of 6 or more characters
  access  AKIA and capitals or digits, 20 or more characters in all
  hex     24 or more characters of 0-9 a-f
  owned   the method's own: a run of 20 or more characters of A-Z a-z 0-9 + / _ - with small
          letters, capitals and at least three digits, that overlaps none of the above and whose
          value occurs under one owner only
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutelage.session import stored

ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
BASE = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
}
OWNED = "[A-Za-z0-9+/_-]{20,}"
KINDS = [*BASE, "owned"]
MIN_VALUE = 6
#: A value held by more owners than this is a widely copied example.
COPIED_OWNERS = 2

#: Pieces or spans of a text that are worked on together.
TOGETHER = 128

_OPEN, _CLOSE, _SPARE = "\u0001", "\u0002", "\u0003"


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<start,rank,end,kind,value>> of a kind's matches, in code points.

    Matches are put between two marks that no pattern can match (texts that hold the marks
    have them replaced before, one character for one), then the text is cut at the marks.  The place
    of a piece is the length of the blocks of pieces before its own and of the pieces before it
    in its block, so the work for a match does not grow with their number.
    """
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, _SPARE * 2), pattern, f"{_OPEN}$0{_CLOSE}")
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda acc, x: acc + x)

    def spans(pieces: Column, sizes: Column, before: Column) -> Column:
        def span(k: Column) -> Column:
            i = 2 * k + 1  # pieces alternate: text, match, text, match, ..., text
            block = F.floor(i / TOGETHER).cast("int")
            start = F.get(before, block) + total(F.slice(sizes, block * TOGETHER + 1, i % TOGETHER))
            found = F.get(pieces, i)
            return F.struct(
                start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.get(sizes, i)).alias("end"), F.lit(kind).alias("kind"),
                (F.regexp_extract(found, ASSIGN, 2) if kind == "assign" else found).alias("value"))

        return F.filter(F.transform(_counted(F.floor(F.size(pieces) / 2)), span), lambda s: F.length(s["value"]) >= MIN_VALUE)

    found = _named(F.split(marked, f"[{_OPEN}{_CLOSE}]", -1), lambda pieces: _named(
        F.transform(pieces, F.length), lambda sizes: _named(
            F.transform(_blocks(sizes), lambda j: total(F.slice(sizes, j * TOGETHER + 1, TOGETHER))), lambda sums: _named(
                F.transform(_blocks(sizes), lambda j: total(F.slice(sums, 1, j))), lambda before: spans(pieces, sizes, before)))))
    return F.when(text.rlike(pattern), found).otherwise(
        F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>"))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _counted(n: Column) -> Column:
    """0 to n - 1, for an n of at least 1."""
    return F.sequence(F.lit(0), n.cast("int") - 1)


def _blocks(values: Column) -> Column:
    return _counted(F.ceil(F.size(values) / TOGETHER))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, *, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """Rows of ``docs`` as (doc_id, owner, base, more): spans of each text, no text.

    A null text is empty.  ``more`` holds the candidates for ``owned``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*(_spans(text, k, p) for k, p in BASE.items()))
    loose = F.filter(_spans(text, "owned", OWNED), lambda s: (
        s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
        & (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= 3)))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
        base.alias("base"), loose.alias("loose"),
    ).select("doc_id", "owner", "base", F.filter(
        "loose", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    ).alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, docs, owners, copied) of every candidate value of the corpus.

    Counted by distinct and sums that combine before the shuffle, so a value that a third of the
    corpus holds is no hot key.
    """
    values = found.select("doc_id", "owner", F.explode(F.concat("base", "more")).alias("s")).select(
        "doc_id", "owner", F.sha2("s.value", 256).alias("value_hash")).distinct()
    per_owner = values.groupBy("value_hash", "owner").agg(F.count("*").alias("docs"))
    return per_owner.groupBy("value_hash").agg(
        F.sum("docs").alias("docs"), F.count("*").alias("owners")).withColumn(
        "copied", F.col("owners") > COPIED_OWNERS)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         owner_col: str = "source") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_copied,
    n_live, found (all spans by start, with their values).

    A repository is a document, an owner its ``owner_col`` (null counts as one owner).  Base spans
    are always reported; the ownership counts add the ``owned`` spans and say how many of a
    document's spans hold a widely copied value (``n_copied``) or a value of few owners
    (``n_live``).  Null and empty texts have no spans: counts 0, spans ''.  Rows that repeat an
    id are scanned one by one.  Columns besides the three named are neither needed nor kept.

    Texts are read once: the candidates of all rows (no text) are written to the shared folder
    and everything else works on those.
    """
    found = stored(candidates(docs, id_col=id_col, text_col=text_col, owner_col=owner_col)
                   .withColumn("row", F.monotonically_increasing_id()), "candidates")
    hit = F.size("base") + F.size("more") > 0
    judged = (
        found.where(hit).select("row", F.explode(F.concat("base", "more")).alias("s"))
        .withColumn("value_hash", F.sha2("s.value", 256)).join(ownership(found), "value_hash")
        .where((F.col("s.kind") != "owned") | (F.col("owners") == 1))
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
            "s.start", "s.rank", "s.end", "s.kind", "s.value", "owners", "copied"))).alias("found"))
    )
    # a row's own spans are all that is collected
    rows = found.where(hit).join(judged, "row", "left").select("doc_id", "base", "found").unionByName(
        found.where(~hit).select("doc_id", "base"), allowMissingColumns=True)
    count = lambda name: F.size(F.filter("base", lambda s: s["kind"] == name)).cast("long")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,owners:bigint,copied:boolean>>")
    return rows.withColumn("found", F.coalesce("found", none)).select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(F.sort_array("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["copied"])).alias("n_copied"),
        F.size(F.filter("found", lambda s: ~s["copied"])).alias("n_live"), "found")


def redact(docs: DataFrame, *, mark: str = "[secret]") -> DataFrame:
    """``docs`` (doc_id, text, source, and others) with every reported span replaced by ``mark``.

    Overlapping spans are one.  Values that are widely copied go too: a secret that leaked into
    many documents is still one.  ``n_chars``, where there is one, is counted anew.  Documents
    without a span, null texts included, stay as they are; rows are told apart by a number of their
    own, so null and repeated ids are treated like others.
    """
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    spans = scan(numbered, id_col="_row").where(F.size("found") > 0).select(F.col("doc_id").alias("_row"), "found")
    text, found = F.col("text"), F.col("found")
    last = lambda some: F.array_max(F.transform(some, lambda s: s["end"]))

    def block(j: Column) -> Column:
        """The text from the end of all earlier spans to that of this block's, spans replaced."""
        own = F.slice(found, j * TOGETHER + 1, TOGETHER)

        def filled(at: Column, part: Column) -> Column:
            return F.aggregate(
                own, F.struct(at.alias("at"), F.lit("").alias("text")),
                lambda acc, s: F.struct(
                    F.greatest(acc["at"], s["end"]).alias("at"),
                    F.when(s["start"] >= acc["at"], F.concat(
                        acc["text"], F.substring(part, acc["at"] - at + 1, s["start"] - acc["at"]), F.lit(mark))
                    ).otherwise(acc["text"]).alias("text")), lambda acc: acc["text"])

        return _named(F.coalesce(last(F.slice(found, 1, j * TOGETHER)), F.lit(0)), lambda at: _named(
            F.substring(text, at + 1, last(own) - at), lambda part: filled(at, part)))

    clean = numbered.join(spans, "_row", "left").withColumn("text", F.when(found.isNull(), text).otherwise(F.concat(
        F.array_join(F.transform(_blocks(found), block), ""), F.substring(text, last(found) + 1, F.length(text)))))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("found").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select(*docs.columns)
