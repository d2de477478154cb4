"""Conversation repair against exhaustive enumeration and against a plain whole-table version."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tutelage.llm import repair
from tutelage.llm.setup import prepare

KIND = "conv_id long, turn long, role string, text string, audit string, row long"
ACCEPTED = re.compile(r"(s?(ua)+)?")


def every_repair(rows, inserts=3):
    """Least (cost, audit) by trying all edit sequences with few inserts."""
    best = None

    def go(i, cost, audit, roles, left):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and ACCEPTED.fullmatch(roles):
            best = min(best or (cost, audit), (cost, audit))
        if left:
            for r in "ua":
                go(i, cost + 5, audit + "I", roles + r, left - 1)
        if i == len(rows):
            return
        initial, fault = rows[i]
        go(i + 1, cost + 2, audit + "D", roles, left)
        if fault in (repair.BLANK, repair.REPEATED):
            return
        more = 5 * (fault == repair.CUT_OFF)
        go(i + 1, cost + more, audit + "K", roles + (initial or "-"), left)
        for r in "ua":
            go(i + 1, cost + more + 1, audit + "R", roles + r, left)

    go(0, 0, "", "", inserts)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_lightest_equals_enumeration(seed, monkeypatch):
    rng = random.Random(seed)
    for _ in range(60):
        rows = [(rng.choice(["s", "u", "u", "a", "a", "t", ""]), rng.choice([0, 0, 0, 0, 1, 2, 3]))
                for _ in range(rng.randint(0, 5))]
        want = every_repair(rows)
        assert repair.best(repair.lightest(rows, repair.EMPTY)) == want
        for chunk in (1, 2):
            monkeypatch.setattr(repair, "CHUNK", chunk)
            assert repair.best(repair.stretch(rows, [repair.EMPTY])[repair.EMPTY]) == want


def plain(talks):
    """The contract, conversation by conversation."""
    out, groups = {}, defaultdict(list)
    space = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in talks:
        groups.setdefault(conv, [])
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind == 0:
            continue
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = (repair.BLANK if not body else repair.REPEATED if (role, text) in seen
                     else repair.CUT_OFF if body[-1] not in ".!?" else repair.GOOD)
            seen.add((role, text))
            faults.append(fault)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit = repair.best(repair.lightest([(r[1][:1], f) for r, f in zip(rows, faults)], repair.EMPTY))
        lines, at, state = [], 0, repair.EMPTY
        for edit in audit:
            if edit in "RI":
                role, state = repair.GIVEN[state]
                lines.append(f"{role}:{rows[at][2] if edit == 'R' else ''}")
            elif edit == "K":
                state = repair.STEP[state][rows[at][1][:1]]
                lines.append(f"{rows[at][1]}:{rows[at][2]}")
            at += edit != "I"
        out[conv] = (gaps, *(faults.count(f) for f in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talks(seed=2):
    rng = random.Random(seed)
    say = lambda: rng.choice(["Yes.", "No!", "cut", " ", "", "What?", "fine .\n", "É", None, "x" * 3000 + "."])
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "User"]) if rng.random() < 0.3 else
             ["user", "assistant"][t % 2], say()) for c in range(80) for t in range(rng.randint(1, 9))]
    rows += [(100, t, ["user", "assistant"][t % 2], f"line {rng.randint(0, 400)}{rng.choice(['.', '', '!'])}") for t in range(1500)]
    rows += [(200 + i, 0, "user", "alone.") for i in range(40)]
    rows += [(None, t, "user", "a.") for t in (1, 1, None, None, 4)] + [(101, None, "user", "b."), (101, None, "assistant", "c")]
    return rows + [(102, 2, "user", "same."), (102, 2, "user", "same."), (102, 2, "assistant", "z."), (102, -5, "system", "y.")]


@pytest.mark.parametrize("parts", [1, 7])
def test_digest_equals_the_contract(spark, monkeypatch, parts):
    """Also where the large conversation and some small ones lie across parts of the table."""
    prepare(spark)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = talks()
        got = repair.digest(spark.createDataFrame([(*r, "x", 1) for r in rows], KIND))
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        found = {r[0]: tuple(r[1:]) for r in got.collect()}
        want = plain(rows)
        assert {k: v for k, v in found.items() if want.get(k) != v} == {} and len(found) == len(want)
        assert any(v[6] == "" for v in want.values())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_table(spark):
    assert repair.digest(spark.createDataFrame([], KIND)).count() == 0


def test_repaired_rows(spark):
    prepare(spark)
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "A."), (3, 0, "user", " ")]
    got = repair.repaired(spark.createDataFrame([(*r, "", 0) for r in rows], KIND))
    assert sorted(map(tuple, got.collect())) == [(1, 0, "user", "Still there?"), (1, 1, "assistant", "Yes.")]
