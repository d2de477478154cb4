"""Personal data: base spans by form, and terms that give away whose they are.

An entity is the value of a base span: an address, a number.  The terms next to its occurrences
(``REACH`` words on either side) are its context.  With N documents, of which df(e) hold the entity,
df(t) the term and c(e, t) the entity with the term in its context,

  information of the entity   IC(e)     = log2(N / df(e))
  what the term tells of it   PMI(e, t) = log2(N c(e, t) / (df(e) df(t)))

A term that tells at least ``threshold`` of the entity's information, in ``least`` documents or more,
discloses it: its places in the entity's contexts are spans of the kind ``term``.  One that tells all
of it (it occurs nowhere else) is removed by ``sanitise``, another is generalised.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutelage.llm.words import each_block, hash_words, lowered
from tutelage.session import stored

KINDS = ("email", "ip", "card", "phone", "term")
BASE = KINDS[:4]
#: Terms on either side of a base span that are its context.
REACH = 6
#: A pair of entity and term counts from so many documents on.
LEAST_DOCS = 3
#: Share of an entity's information from which a term discloses it.
THRESHOLD = 0.9
#: Terms whose documents are counted in one pass over the texts.
PASS_TERMS = 2_000_000

# The base forms (fixed values), written so that a text is read in linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile("[^0-9]+")
_TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TERM_BEFORE = regex.compile(r"(?r)[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_B = np.arange(256)
_BETWEEN = (_B < 128) & ~((_B >= 48) & (_B <= 57)) & ~(((_B | 32) >= 97) & ((_B | 32) <= 122))


def emails(text: str) -> Iterator[tuple[int, int, str]]:
    """Addresses: the local part is the run of its letters before the @, back to the last match."""
    done = 0
    for match in _DOMAIN.finditer(text):
        start = at = match.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            done = match.end()
            yield start, done, text[start:done].lower()


def ips(text: str) -> Iterator[tuple[int, int, str]]:
    for match in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in match[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield *match.span(), ".".join(parts)


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int, str]]:
    for match in _CARD.finditer(text):
        if len(match[0]) >= 13:
            digits = _NO_DIGIT.sub("", match[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield *match.span(), digits


def phones(text: str) -> Iterator[tuple[int, int, str]]:
    for match in _PHONE.finditer(text):
        digits = _NO_DIGIT.sub("", match[0])
        if 9 <= len(digits) <= 15:
            yield *match.span(), digits


_FINDERS = ((emails, "@"), (ips, "."), (cards, ""), (phones, "+"))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by kind, then start; places are code points."""
    return [(k, *found) for k, (find, needs) in enumerate(_FINDERS) if needs in text for found in find(text)]


def contexts(text: str, spans: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, int]]:
    """(number of the span, start, end) of the terms near each span that overlap no span."""
    cover: list[list[int]] = []
    for start, end in sorted((s[1], s[2]) for s in spans):
        if cover and start < cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], end)
        else:
            cover.append([start, end])
    begins = [c[0] for c in cover]
    for number, (_, start, end, _) in enumerate(spans):
        for near in (_TERM.finditer(text, end), _TERM_BEFORE.finditer(text, 0, start)):
            for _, word in zip(range(REACH), near):
                a, b = word.span()
                last = bisect_right(begins, b - 1) - 1
                if last < 0 or cover[last][1] <= a:
                    yield number, a, b


def _hashes(values: list[str]) -> np.ndarray:
    raw = [v.encode("utf-8", "replace") for v in values]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    data = lowered(np.frombuffer(b"".join(raw), np.uint8))
    return hash_words(data, ends - np.array([len(r) for r in raw], np.int64), ends).view(np.int64)


_SPAN = "start:int,end:int"
_FOUND = f"row long, doc_id long, base array<struct<kind:int,{_SPAN}>>, near array<struct<e:long,t:long,{_SPAN}>>, held array<long>"
_FOUND_SCHEMA = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()),
    ("base", pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end")]))),
    ("near", pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))),
    ("held", pa.list_(pa.int64()))])


def occurrences(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, near, held) of ``docs`` (row, doc_id, text): spans, context terms with the
    hash of their entity, and the entities of the document; no text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values, terms = [], [], []
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                spans = base_spans(text) if text else []
                near = list(contexts(text, spans)) if spans else []
                rows.append((row, doc_id, spans, near))
                values += [f"{BASE[k]}:{value}" for k, _, _, value in spans]
                terms += [text[a:b] for _, a, b in near]
            entity, term = _hashes(values).tolist(), _hashes(terms).tolist()
            out, e, t = [], 0, 0
            for row, doc_id, spans, near in rows:
                out.append({
                    "row": row, "doc_id": doc_id,
                    "base": [{"kind": k, "start": a, "end": b} for k, a, b, _ in spans],
                    "near": [{"e": entity[e + n], "t": term[t + i], "start": a, "end": b} for i, (n, a, b) in enumerate(near)],
                    "held": sorted(set(entity[e:e + len(spans)]))})
                e, t = e + len(spans), t + len(near)
            yield pa.RecordBatch.from_pylist(out, _FOUND_SCHEMA)

    return docs.mapInArrow(run, _FOUND)


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, df): in how many rows of ``docs`` (text) each term of the written table ``terms`` (t) occurs.

    Terms are sent to the tasks in sets of at most about two million, each with a pass of its own;
    a task adds up the counts of all its rows.
    """
    passes = -(-terms.count() // PASS_TERMS) or 1
    out = None
    for p in range(passes):
        keys = np.sort(np.array([r["t"] for r in terms.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == p).toLocalIterator()],
                                np.int64).view(np.uint64))
        counted = stored(_count_pass(docs, keys).groupBy("t").agg(F.sum("df").alias("df")), "term-counts")
        out = counted if out is None else out.union(counted)
    return out


def _count_pass(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    frozen = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozen.value
        df = np.zeros(len(known), np.int64)
        for batch in batches if len(known) else ():
            for _, _, texts in each_block(batch, "text", _BETWEEN):
                at = np.minimum(np.searchsorted(known, texts.hashes), len(known) - 1)
                hit = np.flatnonzero(known[at] == texts.hashes)
                doc = np.repeat(np.arange(len(texts)), np.diff(texts.first))[hit]
                pairs = np.unique(doc * len(known) + at[hit])
                df += np.bincount(pairs % len(known), minlength=len(known))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(known[seen].view(np.int64)), pa.array(df[seen])], ["t", "df"])

    return docs.mapInArrow(run, "t long, df long")


def disclosures(docs: DataFrame, found: DataFrame, *, least: int = LEAST_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """(e, t, whole): terms that disclose an entity; ``whole`` if they tell all of its information.

    Counts come from all documents and combine before they are shuffled, so an entity or a term
    in a third of them is no hot key.
    """
    pairs = stored(
        found.where(F.size("near") > 0).select(F.explode(F.array_distinct(F.transform(
            "near", lambda x: F.struct(x["e"].alias("e"), x["t"].alias("t"))))).alias("x"))
        .groupBy("x.e", "x.t").agg(F.count("*").alias("c")).where(F.col("c") >= least), "pairs")
    terms = stored(pairs.select("t").distinct(), "terms")
    of_term = document_counts(docs, terms)
    of_entity = found.where(F.size("held") > 0).select(F.explode("held").alias("e")).groupBy("e").agg(F.count("*").alias("df_e"))
    total = F.lit(found.count())
    told = F.log2(total * F.col("c") / (F.col("df_e") * F.col("df")))
    return stored(
        pairs.join(of_term, "t").join(of_entity, "e").withColumn("ic", F.log2(total / F.col("df_e")))
        .where((F.col("ic") > 0) & (told >= threshold * F.col("ic")))
        .select("e", "t", (F.col("c") == F.col("df")).alias("whole")), "disclosures")


def _spans(docs: DataFrame, options: dict) -> DataFrame:
    """(row, doc_id, base, terms) of ``docs`` (row, doc_id, text), one row each."""
    found = stored(occurrences(docs), "occurrences")
    told = disclosures(docs.select("text"), found, **options)
    terms = (found.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.*")
             .join(told, ["e", "t"]).groupBy("row", "start", "end").agg(F.max("whole").alias("whole"))
             .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "whole"))).alias("terms")))
    none = F.array().cast("array<struct<start:int,end:int,whole:boolean>>")
    near = found.where(F.size("near") > 0).select("row", "doc_id", "base").join(terms, "row", "left")
    return near.unionByName(found.where(F.size("near") == 0).select("row", "doc_id", "base"), allowMissingColumns=True).withColumn(
        "terms", F.coalesce("terms", none))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))


def _listed(spans: Column, kind: Column | None = None) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(
        ":", F.lit(KINDS[4]) if kind is None else F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Base spans are always reported; ``n_term`` of the listed spans are terms that disclose an
    entity (options: ``least``, ``threshold``).  Null and empty texts have no spans: counts 0, spans
    '' and the hash of ''.  Rows that repeat an id are read one by one, and every row counts as a
    document; null ids are kept; an empty table gives no rows; other columns are not used.  Whole
    texts are read twice: for the spans, and to count the terms next to them.
    """
    rows = _spans(_numbered(docs, id_col, text_col), options)
    base = _listed(F.col("base"), F.array(*(F.lit(k) for k in BASE)))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{BASE[kind]}")

    return rows.select(
        "doc_id", *map(count, range(len(BASE))),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _listed(F.col("terms"))), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with personal data replaced; all columns stay.

    A base span becomes its kind in brackets, a disclosing term ``[number]`` or ``[word]``, one that
    occurs with its entity only is removed.  Spans that overlap are replaced by the first's mark.  Documents
    without spans, null texts included, stay as they are; rows are told apart by a number of their own,
    so null and repeated ids are treated like others.
    """
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    own = numbered.select(F.col("_row").alias("row"), F.col("_row").alias("doc_id"), F.col(text_col).alias("text"))
    marks = F.array(*(F.lit(f"[{k}]") for k in BASE))
    spans = _spans(own, options).where(F.size("base") + F.size("terms") > 0).select(F.col("row").alias("_row"), F.sort_array(F.concat(
        F.transform("base", lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.element_at(marks, s["kind"] + 1).alias("mark"))),
        F.transform("terms", lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.when(s["whole"], F.lit("")).otherwise("[word]").alias("mark"))),
    )).alias("_spans"))
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        here = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        mark = F.when((s["mark"] == "[word]") & here.rlike("^[0-9]+$"), "[number]").otherwise(s["mark"])
        return F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"),
            F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark)).alias("parts"))
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts")))

    done = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")), step)
    clean = numbered.join(spans, "_row", "left").withColumn("_done", F.when(F.col("_spans").isNotNull(), done))
    return clean.withColumn(text_col, F.when(F.col("_done").isNull(), text).otherwise(F.concat(
        F.array_join("_done.parts", ""), F.expr(f"substring(`{text_col}`, _done.at + 1)")))).select(*docs.columns)
