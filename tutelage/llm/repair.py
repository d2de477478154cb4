"""Conversations damaged on purpose, and their repair by Knuth's lightest derivation.

A repair takes the rows of a conversation in order and leaves a sequence of roles that the grammar
``(system? (user assistant)+)?`` accepts, told by initials.  An item (i, q) says that the first i
rows are dealt with and the grammar is in state q; its weight is (cost, audit), the edits'
initials in order.  Deductions lead on from an item: Delete, Keep or Rerole the next row, or
Insert a row.  The agenda pops the least weight first, and what it pops is final.

That order is monotone and superior.  Costs only grow, and an audit grows at its end.  Of two
audits of one item with equal cost neither begins the other: both deal with the same rows, so the
longer one would have more inserts, each of which costs.  Hence they differ at some place and stay
in that order whatever follows.

Long conversations are cut into chunks of rows; a chunk gives a weight for each pair of states it
can lead between, and chunks are joined in order.  Conversations that lie across several parts of
the ordered table are put together from those weights, so none is ever collected.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutelage.session import stored

# What each edit costs, and what a truncated row that stays costs besides.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar: nothing yet, after system, after user, after assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FINAL = (EMPTY, ASSISTANT)
#: The state after a row of that initial, from each state.
STEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The only role that a rerole or an insert can give in each state, and the state after it.
GIVEN = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
#: Rows whose derivations are worked out on one agenda.
CHUNK = 200

GOOD, BLANK, REPEATED, CUT_OFF = range(4)
_NOT_BLANK = r"[^\x20\x09-\x0D]"

Weight = tuple[int, str]
Row = tuple[str, int]


def lightest(rows: list[Row], start: int, goals: Iterable[int] = STATES) -> dict[int, Weight]:
    """Least weight with which all ``rows`` (initial, fault) are dealt with, per state, from ``start``.

    Stops as soon as no item can be lighter than the goals that are wanted.
    """
    n, waiting = len(rows), set(goals)
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    final: set[tuple[int, int]] = set()
    out: dict[int, Weight] = {}
    while agenda and waiting:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n:
            out[q] = (cost, audit)
            waiting.discard(q)
        given = GIVEN[q][1]
        if (i, given) not in final:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", i, given))
        if i == n:
            continue
        initial, fault = rows[i]
        if (i + 1, q) not in final:
            heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, q))
        if fault in (BLANK, REPEATED):
            continue
        stays = cost + (TRUNCATED if fault == CUT_OFF else 0)
        if initial in STEP[q]:
            heapq.heappush(agenda, (stays + KEEP, audit + "K", i + 1, STEP[q][initial]))
        heapq.heappush(agenda, (stays + REROLE, audit + "R", i + 1, given))
    return out


def joined(left: dict[int, Weight], right: dict[int, dict[int, Weight]]) -> dict[int, Weight]:
    """Least weights after a further stretch of rows, given its weights from each state."""
    out: dict[int, Weight] = {}
    for mid, (cost, audit) in left.items():
        for q, (more, rest) in right.get(mid, {}).items():
            if q not in out or cost + more <= out[q][0]:
                found = (cost + more, audit + rest)
                out[q] = min(found, out.get(q, found))
    return out


def stretch(rows: list[Row], starts: Iterable[int]) -> dict[int, dict[int, Weight]]:
    """Least weights over ``rows`` from each start to each state, chunk by chunk."""
    chunks = [rows[a:a + CHUNK] for a in range(0, len(rows), CHUNK)] or [[]]
    if len(chunks) == 1:
        return {p: lightest(chunks[0], p) for p in starts}
    out = {p: lightest(chunks[0], p) for p in starts}
    for chunk in chunks[1:]:
        right = {p: lightest(chunk, p) for p in STATES}
        out = {p: joined(left, right) for p, left in out.items()}
    return out


def best(paths: dict[int, Weight]) -> Weight:
    """The goal: least weight among the states that the grammar may end in."""
    return min(paths[q] for q in FINAL if q in paths)


def damaged(talks: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``talks`` with the faults that a hash of each row decides.

    A null role or text is one space, and so is a null number in the hashed text.  Rows are dropped
    (0), emptied (1), lose their ends of sentences (2), are doubled (3) or become the user's (4).
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = talks.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return rows.where("kind <> 0").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` in order of conversation and turn (nulls first, equal turns by role and text).

    Adds ``row``, an ascending number whose upper bits are the part of the table, ``initial`` and
    ``fault``, all but one kind of repetition: a row equal to the one right before it, in the same
    turn, is left to ``pieces``.  A conversation may lie across parts; equal rows never do.
    """
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    marked = rows.withColumn("mark", mark).withColumn("of", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    # a conversation's texts that occur in more than one of its turns, and the first of these
    again = stored(marked.where(F.col("text").rlike(_NOT_BLANK)).groupBy("of", "mark").agg(
        F.min(place).alias("earliest"), F.max(place).alias("latest")).where("earliest <> latest").drop("latest"), "again")
    known = marked.join(again, ["of", "mark"], "left")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (F.when(~F.col("text").rlike(_NOT_BLANK), BLANK)
             .when(F.col("earliest").isNotNull() & (F.col("earliest") != place), REPEATED)
             .when(~last.isin(".", "!", "?"), CUT_OFF).otherwise(GOOD))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return stored(
        known.select("conv_id", "turn", "role", "text", "mark", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
        .repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("row", F.monotonically_increasing_id()), "ordered")


@dataclass
class Piece:
    """A conversation's rows within one part, as they come."""

    conv_id: int | None
    part: int
    rows: list[Row] = field(default_factory=list)
    turns: list[int | None] = field(default_factory=list)   # first and last known one
    distinct: int = 0
    illegal: int = 0
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    mark: str | None = None
    turn: int | None = None

    def take(self, turn: int | None, mark: str, initial: str, fault: int) -> None:
        if self.rows:
            if fault != BLANK and turn == self.turn and mark == self.mark:
                fault = REPEATED
            self.illegal += self.rows[-1][0] + initial not in LEGAL
        if turn is not None and (not self.turns or turn != self.turns[1]):
            self.turns = [self.turns[0] if self.turns else turn, turn]
            self.distinct += 1
        self.turn, self.mark = turn, mark
        self.counts[fault] += 1
        self.rows.append((initial, fault))


LEGAL = {"su", "ua", "au"}
_COUNTS = ("low", "high", "distinct", "blank", "repeated", "cut_off", "illegal")
_PATHS = "paths array<struct<p:int,q:int,cost:long,audit:string>>"
_PIECE = f"conv_id long, part long, {' long, '.join(_COUNTS)} long, first string, last string, {_PATHS}"
_SCHEMA = pa.schema([
    *((n, pa.int64()) for n in ("conv_id", "part", *_COUNTS)), ("first", pa.string()), ("last", pa.string()),
    ("paths", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])


def pieces(rows: DataFrame) -> DataFrame:
    """A row per conversation and part of the ordered table: its counts and least weights.

    Only the first and the last conversation of a part can lie across parts; those get the weights
    from every state, all others those from the start.  A part's rows come in order, in small
    columns without texts, and at most one piece is held.
    """
    small = rows.select(F.shiftright("row", 33).alias("part"), "row", "conv_id", "turn", "mark", "initial", "fault")

    def emit(piece: Piece, inner: bool) -> dict:
        paths = stretch(piece.rows, [EMPTY] if inner else STATES)
        return {"conv_id": piece.conv_id, "part": piece.part, "low": piece.turns[0] if piece.turns else None,
                "high": piece.turns[1] if piece.turns else None, "distinct": piece.distinct, "blank": piece.counts[BLANK],
                "repeated": piece.counts[REPEATED], "cut_off": piece.counts[CUT_OFF], "illegal": piece.illegal,
                "first": piece.rows[0][0], "last": piece.rows[-1][0],
                "paths": [{"p": p, "q": q, "cost": c, "audit": a} for p, to in paths.items() for q, (c, a) in to.items()]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, first = None, True
        for batch in batches:
            done = []
            columns = (batch.column(c).to_pylist() for c in ("part", "conv_id", "turn", "mark", "initial", "fault"))
            for part, conv_id, turn, mark, initial, fault in zip(*columns):
                if piece is None or piece.part != part or piece.conv_id != conv_id:
                    if piece is not None:
                        done.append(emit(piece, not first and piece.part == part))
                        first = piece.part != part
                    piece = Piece(conv_id, part)
                piece.take(turn, mark, initial, fault)
            if done:
                yield pa.RecordBatch.from_pylist(done, _SCHEMA)
        if piece is not None:
            yield pa.RecordBatch.from_pylist([emit(piece, False)], _SCHEMA)

    return small.repartition("part").sortWithinPartitions("part", "row").mapInArrow(run, _PIECE)


_FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PLAN = f"conv_id long, {' long, '.join(_FOUND)} long, audit string"
_PLAN_SCHEMA = pa.schema([*((n, pa.int64()) for n in ("conv_id", *_FOUND)), ("audit", pa.string())])


def plans(parts: DataFrame) -> DataFrame:
    """(conv_id, counts, cost, audit): the pieces of each conversation put together in order."""
    def closed(conv_id: int | None, sums: dict, paths: dict[int, Weight]) -> dict:
        low, high = sums["low"], sums["high"]
        cost, audit = best(paths)
        return {"conv_id": conv_id, "gaps": 0 if low is None else high - low + 1 - sums["distinct"], "blank": sums["blank"],
                "duplicate": sums["repeated"], "truncated": sums["cut_off"], "illegal": sums["illegal"], "cost": cost, "audit": audit}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict | None = None
        paths: dict[int, Weight] = {}
        for batch in batches:
            done = []
            for piece in batch.to_pylist():
                own: dict[int, dict[int, Weight]] = {}
                for x in piece["paths"]:
                    own.setdefault(x["p"], {})[x["q"]] = (x["cost"], x["audit"])
                if sums is None or sums["conv_id"] != piece["conv_id"]:
                    if sums is not None:
                        done.append(closed(sums["conv_id"], sums, paths))
                    sums, paths = piece, own[EMPTY]
                    continue
                paths = joined(paths, own)
                sums["illegal"] += (sums["last"] + piece["first"] not in LEGAL)
                sums["distinct"] -= sums["high"] is not None and sums["high"] == piece["low"]
                for name in ("distinct", "blank", "repeated", "cut_off", "illegal"):
                    sums[name] += piece[name]
                sums["low"] = piece["low"] if sums["low"] is None else sums["low"]
                sums["high"] = sums["high"] if piece["high"] is None else piece["high"]
                sums["last"] = piece["last"]
            if done:
                yield pa.RecordBatch.from_pylist(done, _PLAN_SCHEMA)
        if sums is not None:
            yield pa.RecordBatch.from_pylist([closed(sums["conv_id"], sums, paths)], _PLAN_SCHEMA)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, _PLAN)


class Walk:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, EMPTY

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = GIVEN[self.state]
            self.at += 1
            yield role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The rows that this one becomes, with those put in before it."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEP[self.state][role[:1]]
            yield role, text
        elif edit == "R":
            role, self.state = GIVEN[self.state]
            yield role, text


def _applied(rows: DataFrame, edits: DataFrame, make, schema: str) -> DataFrame:
    """Rows of ``make(lines)`` for each conversation: its plan, then its rows, in one sorted stream.

    ``make`` takes (plan row, iterator of repaired (role, text)).  Neither the rows nor the lines
    of a conversation are ever held together.
    """
    plan = edits.select("conv_id", F.lit(-1).cast("long").alias("row"), F.struct(*_FOUND, "audit").alias("plan"))
    stream = plan.unionByName(rows.select("conv_id", "row", "role", "text"), allowMissingColumns=True)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "row", "plan", "role", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = flat(batches)
        ahead = next(source, None)

        def lines(walk: Walk) -> Iterator[tuple[str, str]]:
            nonlocal ahead
            while ahead is not None and ahead[1] >= 0:
                role, text = ahead[3:]
                ahead = next(source, None)
                yield from walk.row(role, text)
            yield from walk.inserts()

        while ahead is not None:
            conv_id, _, found, _, _ = ahead
            ahead = next(source, None)
            yield from make(conv_id, found, lines(Walk(found["audit"])))

    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "row").mapInArrow(run, schema)


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ordered rows and the plan of each conversation, both written."""
    in_order = ordered(rows)
    return in_order, stored(plans(pieces(in_order)), "plans")


def repaired(talks: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows of ``talks`` (conv_id, turn, role, text) after the
    cheapest repair, in order from place 0.  Cases as in ``digest``; nothing is damaged before."""
    def make(conv_id, found, lines):
        block, place = [], 0
        for role, text in lines:
            block.append((conv_id, place, role, text))
            place += 1
            if len(block) == 1000:
                yield _batch(block)
                block = []
        if block:
            yield _batch(block)

    def _batch(block):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*block), (
            pa.int64(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "place", "role", "text"])

    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = talks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        whole("role"), whole("text"))
    return _applied(*plan(rows), make, "conv_id long, place long, role string, text string")


def digest(talks: DataFrame) -> DataFrame:
    """One row per conversation of ``talks`` (conv_id, turn, role, text), damaged and repaired:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles and texts are one space; a null conv_id is a conversation of its own; rows without
    a turn come first, rows of one turn by role and text, equal rows are repeats.  A conversation of
    which no row is left has zeros, an empty audit and the hash of the empty text; an empty table
    gives no rows.  Texts of any length are hashed as they pass; further columns are not used.
    """
    def make(conv_id, found, lines):
        whole, first = hashlib.sha256(), True
        for role, text in lines:
            whole.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, **found, "repaired_sha256": whole.hexdigest()}], schema)

    schema = pa.schema([*_PLAN_SCHEMA, ("repaired_sha256", pa.string())])
    done = _applied(*plan(damaged(talks)), make, f"{_PLAN}, repaired_sha256 string")
    none = talks.select(F.col("conv_id").cast("long").alias("conv_id"), *(F.lit(0).cast("long").alias(c) for c in _FOUND),
                        F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    # a conversation with a plan has one row more, which comes first of the two
    return done.withColumn("has", F.lit(1)).unionByName(none.distinct().withColumn("has", F.lit(0))).groupBy("conv_id").agg(
        F.max_by(F.struct(*_FOUND, "audit", "repaired_sha256"), "has").alias("x")).select("conv_id", "x.*")
