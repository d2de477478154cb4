"""Study state against a plain sequential fold, with one key over few and over many parts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tutelage.functions import scoring as S
from tutelage.operators import policy, reports, study
from tutelage.operators.ordered import PART, in_parts, position, running_sum, with_previous

T0 = datetime(2024, 1, 1)
SCHEMA = ("learner_id bigint, topic string, ts timestamp_ntz, seq bigint, quality int, "
          "confidence int, note string")


def attempts(spark, rows):
    """rows: (learner, topic, minutes, quality, confidence)"""
    return spark.createDataFrame(
        [(a, t, T0 + timedelta(minutes=m), i, q, c, "") for i, (a, t, m, q, c) in enumerate(rows)],
        SCHEMA)


def one_item(spark, marks):
    rows = [(1, "x", i, q, c) for i, (q, c) in enumerate(marks)]
    return study.risk_score(study.item_state(attempts(spark, rows))).collect()[0]


def fold(rows):
    """The rules, one attempt after the other."""
    out = []
    s = dict(reps=0, streak=0, lapses=0, mastered=False)
    for ts, q, c in rows:
        if q >= 4:
            s["reps"] += 1
            s["streak"] += 1
            if s["streak"] >= 2 and c >= 2:
                s["mastered"] = True
        else:
            s["lapses"] += q < 3
            s["streak"], s["mastered"] = 0, False
        if s["mastered"]:
            due = ts + timedelta(days={2: 1, 3: 2}.get(s["streak"], 4))
        elif q >= 4 and c >= 2:
            due = ts + timedelta(days=1)
        else:
            due = ts + timedelta(minutes=7 if q < 4 else 20 if s["streak"] == 1 else 40)
        out.append((s["reps"], s["streak"], s["lapses"], s["mastered"], due))
    return out


@pytest.fixture(scope="module")
def log():
    rng = random.Random(7)
    rows = []
    for _ in range(3000):
        # one item holds about a third of all rows
        learner, topic = (1, "hot") if rng.random() < 0.35 else (rng.randint(1, 6),
                                                                 rng.choice("abcd"))
        rows.append((learner, topic, rng.randint(0, 4000), rng.choice([1, 2, 3, 4, 5, 5, 5, 5]),
                     rng.randint(0, 3)))
    return rows


def expected(rows):
    by_item = {}
    for i, (a, t, m, q, c) in enumerate(rows):
        by_item.setdefault((a, t), []).append((T0 + timedelta(minutes=m), i, q, c))
    return {k: (sorted(v), fold([(ts, q, c) for ts, _, q, c in sorted(v)]))
            for k, v in by_item.items()}


@pytest.mark.parametrize("parts", [1, 16])
@pytest.mark.parametrize("days", [1, 30])
def test_state_equals_fold(spark, log, monkeypatch, parts, days):
    monkeypatch.setattr(study, "SLOT_DAYS", days)
    got = study.item_state(attempts(spark, log).repartition(parts)).collect()
    want = expected(log)
    assert len(got) == len(want)
    for r in got:
        marks, states = want[(r.learner_id, r.topic)]
        assert (r.reps, r.streak, r.lapses, r.mastered, r.due) == states[-1]
        assert r.attempts == len(marks)
        assert r.created == marks[0][0] and r.last_reviewed == marks[-1][0]


@pytest.mark.parametrize("parts", [1, 13])
def test_history_equals_fold(spark, log, in_range_parts, parts):
    want = expected(log)
    rows = study.attempt_history(attempts(spark, log)).collect()
    assert len(rows) == len(log)
    for r in rows:
        states = want[(r.learner_id, r.topic)][1]
        assert (r.reps, r.streak, r.lapses, r.mastered, r.due) == states[r.attempts - 1]


def test_further_history_goes_on_from_the_last(spark, log):
    """History of the later half, from the state after the earlier one, is that of the whole."""
    rows = attempts(spark, log).where("ts < timestamp '2024-01-02 12:00'"), attempts(spark, log).where("ts >= timestamp '2024-01-02 12:00'")
    first = study.attempt_history(rows[0])
    last = first.groupBy(*study.KEY).agg(F.max_by(F.struct("attempts", "reps", "streak", "lapses", "mastered"), "attempts").alias("s")
                                         ).select(*study.KEY, "s.*")
    got = first.unionByName(study.history_after(rows[1], last))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, study.attempt_history(attempts(spark, log)).collect()))


def test_state_reads_twice_without_windows(spark, log):
    plan = study.item_state(attempts(spark, log))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 2


def numbers(seed=3):
    """One key holds half of all rows; many rows share their moment, some keys are null."""
    rng = random.Random(seed)
    return [("big" if rng.random() < 0.5 else rng.choice(["x", "y", None]), rng.randint(0, 30), i, rng.randint(0, 9))
            for i in range(2000)]


@pytest.mark.parametrize("parts", [1, 2, 16])
def test_running_sum_position_and_previous(spark, in_range_parts, parts):
    rows = numbers()
    df = spark.createDataFrame(rows, "k string, o bigint, i bigint, v bigint")
    got = {r.i: r.s for r in running_sum(df, ["k"], ["o", "i"], F.col("v"), "s").collect()}
    places = {r.i: r.pos for r in position(df, ["k"], ["o", "i"], "pos").collect()}
    earlier = {r.i: r.b for r in with_previous(df, ["k"], ["o", "i"], F.col("v"), "b").collect()}
    assert len(got) == len(places) == len(earlier) == len(rows)
    for key in {r[0] for r in rows}:
        total, last = 0, None
        for n, (_, _, i, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            total += v
            assert (got[i], places[i], earlier[i]) == (total, n, last)
            last = v


@pytest.mark.parametrize("parts", [16])
def test_a_large_key_lies_over_many_parts(spark, in_range_parts, parts):
    df = spark.createDataFrame(numbers(), "k string, o bigint, i bigint, v bigint")
    sizes = {(r.k, r[PART]): r["count"] for r in in_parts(df, ["k"], ["o", "i"]).groupBy("k", PART).count().collect()}
    assert max(sizes.values()) < 300 and len([k for k in sizes if k[0] == "big"]) > 6


def test_mastery_needs_confidence_on_a_later_hit(spark):
    assert one_item(spark, [(5, 3), (5, 3)]).mastered
    assert not one_item(spark, [(5, 1)] * 3).mastered
    assert one_item(spark, [(5, 0), (5, 2)]).mastered
    assert one_item(spark, [(5, 3), (5, 3), (5, 0)]).mastered      # stays mastered
    lapsed = one_item(spark, [(5, 3), (5, 3), (2, 1)])
    assert (lapsed.mastered, lapsed.streak, lapsed.lapses) == (False, 0, 1)
    assert one_item(spark, [(5, 3), (5, 3), (3, 1)]).lapses == 0   # shaky, no lapse


def test_blindspot_carries_the_highest_risk(spark):
    blind = one_item(spark, [(1, 3)])
    assert blind.calibration == "blindspot" and blind.risk == 100 + 30 + 10 + 10
    unsure = one_item(spark, [(1, 0)])
    assert unsure.calibration == "shaky" and unsure.risk < blind.risk
    assert one_item(spark, [(4, 2)]).calibration == "solid"


def test_due_ladder(spark):
    def wait(marks):
        r = one_item(spark, marks)
        return r.due - r.last_reviewed

    assert wait([(2, 1)]) == timedelta(minutes=7)
    assert wait([(4, 1)]) == timedelta(minutes=20)
    assert wait([(4, 1), (4, 1)]) == timedelta(minutes=40)
    assert wait([(5, 3)]) == timedelta(days=1)
    assert [wait([(5, 3)] * n).days for n in (2, 3, 4, 5)] == [1, 2, 4, 4]


def test_scores_are_clamped_and_bad_ones_rejected(spark):
    from tutelage.sources.attempts import RAW_ATTEMPT, accepted, attempt_log, rejected

    raw = spark.createDataFrame([
        (1, "  Two\tWords ", T0, 1, '"9"', "-3", " n "), (1, "t", T0, 2, "2.5", "1", ""),
        (1, " ", T0, 3, "1", "1", "")], RAW_ATTEMPT)
    log = attempt_log(raw)
    ok = accepted(log).collect()
    assert [(r.topic, r.quality, r.confidence, r.note) for r in ok] == [("two words", 5, 0, "n")]
    assert {r.reject for r in rejected(log).collect()} == {
        "quality: not a whole number", "topic is required"}


BANK = ("id string, course string, module string, unit string, unit_topic string, num int, "
        "difficulty string, prompt string, answer string, citation string, kind string")


def bank(spark, n=12):
    return spark.createDataFrame([
        (f"q{i}", "c", f"module_{i % 3}", "u", f"t{i % 2}", i, ["short", "long"][i % 2], f"p{i}",
         "" if i == 5 else "a", "", "official") for i in range(n)], BANK)


def test_next_question_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(a, f"q{rng.randrange(12)}", rng.randint(0, 99), 5, 3)
            for a in range(1, 8) for _ in range(a * 3)]
    rows += [(9, f"q{i}", 1, 5, 3) for i in range(12)] + [(10, "elsewhere", 1, 5, 3)]
    state = study.item_state(attempts(spark, rows))
    got = {r.learner_id: r.id for r in policy.next_question(bank(spark), state).collect()}
    questions = [r for r in bank(spark).collect() if r.answer]
    for learner in {r[0] for r in rows}:
        seen = {r[1] for r in rows if r[0] == learner}
        unit = {q.id: f"{q.module}|{q.unit_topic}" for q in questions}
        tried = {u: sum(1 for q in questions if unit[q.id] == u and q.id in seen)
                 for u in unit.values()}
        left = sorted((tried[unit[q.id]], unit[q.id], q.difficulty == "long", q.num, q.id)
                      for q in questions if q.id not in seen)
        assert got.get(learner) == (left[0][-1] if left else None)


@pytest.mark.parametrize("parts", [1, 7])
def test_unseen_questions_equal_anti_join(spark, in_range_parts, parts):
    rng = random.Random(6)
    rows = [(a, f"q{rng.randrange(12)}", 1, 5, 3) for a in range(1, 6) for _ in range(4)]
    rows += [(9, f"q{i}", 1, 5, 3) for i in range(12)] + [(10, "elsewhere", 1, 5, 3)]
    state = study.item_state(attempts(spark, rows))
    order = sorted(r.id for r in bank(spark).collect() if r.answer)
    found = policy.unseen_questions(bank(spark), state).collect()
    got = [(r.learner_id, i) for r in found for i in order[r.from_pos - 1:r.to_pos]]
    assert all((r.first_id, r.last_id, r.n_questions) == (order[r.from_pos - 1], order[r.to_pos - 1], r.to_pos - r.from_pos + 1)
               for r in found)
    active = {r[0] for r in rows if r[1] in order}
    assert sorted(got) == sorted({(a, i) for a in active for i in order} - {(r[0], r[1]) for r in rows})


def test_unseen_list_names_every_question(spark):
    rng = random.Random(7)
    rows = [(a, f"q{rng.randrange(12)}", 1, 5, 3) for a in range(1, 6) for _ in range(4)]
    rows += [(9, f"q{i}", 1, 5, 3) for i in range(12)] + [(10, "elsewhere", 1, 5, 3)]
    state = study.item_state(attempts(spark, rows))
    ids = {r.id for r in bank(spark).collect() if r.answer}
    active = {r[0] for r in rows if r[1] in ids}
    got = [(r.learner_id, r.id) for r in policy.unseen_list(bank(spark), state).collect()]
    assert sorted(got) == sorted({(a, i) for a in active for i in ids} - {(r[0], r[1]) for r in rows})


def test_policy_order(spark):
    """Due blindspot, then new questions, then due items, then re-verification."""
    now = F.lit(T0 + timedelta(days=30)).cast("timestamp_ntz")
    small = bank(spark, 2)
    rows = [(1, "q0", 0, 1, 3),                                     # due blindspot
            (2, "q0", 0, 1, 0),                                     # due, one unseen left
            (3, "q0", 0, 1, 0), (3, "q1", 0, 5, 3), (3, "q1", 1, 5, 3),
            (4, "q0", 0, 5, 3), (4, "q0", 1, 5, 3), (4, "q1", 0, 5, 3), (4, "q1", 1, 5, 3)]
    items = study.with_meta(study.item_state(attempts(spark, rows)), small)
    got = {r.learner_id: (r.action, r.topic) for r in policy.next_action(
        small, items, now).collect()}
    assert got == {1: ("review", "q0"), 2: ("quiz_new", "q1"), 3: ("review", "q0"),
                   4: ("reverify", "q0")}
    early = F.lit(T0).cast("timestamp_ntz")
    idle = policy.next_action(small, items.where("learner_id = 4"), early).collect()[0]
    assert idle.action == "introduce_new" and idle.weak_topics == ""


def test_digest_lists_blindspots_in_parts_by_course(spark, monkeypatch):
    monkeypatch.setattr(reports, "BLINDSPOTS_PER_PART", 3)
    rows = [(1, f"q{i}", i, 1, 3) for i in range(8)] + [(1, "elsewhere", 3, 1, 3), (2, "d1", 1, 5, 3), (2, "d1", 2, 5, 3)]
    other = spark.createDataFrame([("d1", "d", "m", "u", "t", 1, "short", "p", "a", "", "official")], BANK)
    b = bank(spark).unionByName(other)
    items = study.with_meta(study.item_state(attempts(spark, rows)), b)
    parts = reports.mastery_digest(b, items, F.lit(T0).cast("timestamp_ntz")).collect()
    assert sorted((r.learner_id, r.course, r.part) for r in parts) == [
        (1, "", 0), (1, "", 1), (1, "c", 0), (1, "c", 1), (1, "c", 2), (1, "c", 3), (2, "d", 0)]
    assert sum(r.digest.count('"topic"') for r in parts if r.course == "c") == 8
    lines = {(r.learner_id, r.course): r.summary for r in reports.mastery_summary(
        b, items, F.lit(T0).cast("timestamp_ntz")).collect()}
    assert lines[2, "d"] == "Tried 1 of 1 questions; 1 mastered (100%), 0 to repeat\nNo blindspots"


def test_weak_units_equal_a_full_listing(spark):
    """Against every learner with every unit; many units, some courses hardly touched."""
    rng = random.Random(9)
    questions = [(f"k{i}", f"c{i % 2}", f"m{i % 7}", "u", f"t{i % 5}", i, "short", "p", "a", "", "official") for i in range(140)]
    b = spark.createDataFrame(questions, BANK)
    rows = [(a, f"k{rng.randrange(140)}", n, 5, 3) for a in range(1, 6) for n in range(a * a * 3)]
    items = study.item_state(attempts(spark, rows))
    state = {(r.learner_id, r.topic): r.mastered for r in items.collect()}
    want = {}
    for who in range(1, 6):
        for course in {q[1] for q in questions if (who, q[0]) in state}:
            units = {}
            for q in questions:
                if q[1] == course:
                    n, done = units.get((q[2], q[4]), (0, 0))
                    units[q[2], q[4]] = (n + 1, done + state.get((who, q[0]), False))
            ranked = sorted((done * 100 // n, *unit) for unit, (n, done) in units.items() if done < n)
            want[who, course] = [(f"{m} · {u}", pct) for pct, m, u in ranked[:5]]
    got = {(r.learner_id, r.course): [tuple(u) for u in r.weak_units] for r in reports._weak_units(b, items).collect()}
    assert got == want


def test_coverage_lists_untouched_units(spark):
    questions = [(f"k{i}", f"c{i % 2}", f"m{i % 3}", "u", f"t{i % 4}", i, "short", "p", "a", "", "official") for i in range(24)]
    b = spark.createDataFrame(questions, BANK)
    items = study.item_state(attempts(spark, [(1, "k0", n, 5, 3) for n in range(4)] + [(1, "k12", 1, 1, 3), (2, "k1", 1, 5, 3)]))
    got = {(r.learner_id, r.course, r.module, r.unit): (r.questions, r.attempted, r.mastered, r.mastered_pct)
           for r in reports.coverage(b, items).collect()}
    units = {(q[1], q[2], q[4]): 2 for q in questions}
    want = {(who, *u): (n, 0, 0, 0) for who, course in ((1, "c0"), (2, "c1")) for u, n in units.items() if u[0] == course}
    want[1, "c0", "m0", "t0"] = (2, 2, 1, 50)
    want[2, "c1", "m1", "t1"] = (2, 1, 0, 0)
    want[1, "c0", "", "(overall)"], want[2, "c1", "", "(overall)"] = (12, 2, 1, 8), (12, 1, 0, 0)
    assert got == want


def test_percent_truncates(spark):
    row = spark.range(1).select(
        reports.percent(F.lit(2), F.lit(3)).alias("a"), reports.percent(F.lit(0), F.lit(0)).alias("b"))
    assert tuple(row.first()) == (66, 0)


def test_focus_kinds_stay_out_of_the_regular_flow(spark):
    b = bank(spark, 3).withColumn("kind", F.when(F.col("num") == 1, "number").otherwise(F.col("kind")))
    items = study.with_meta(study.item_state(attempts(
        spark, [(1, "q1", 0, 1, 3), (1, "q2", 5, 1, 0)])), b)
    now = F.lit(T0 + timedelta(days=1)).cast("timestamp_ntz")
    assert policy.next_due(items, now).first().topic == "q2"
    assert policy.next_due(items, now, "number").first().topic == "q1"
    assert {r.topic for r in policy.gaps(items, 0).collect()} == {"q1", "q2"}


def test_whole_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in ("5", '"4"', "5.0", "3e0", "4.5", '"5.0"', "x", "9", None)], "raw string")
    value, reason = S.whole_number(F.col("raw"), 0, 5)
    got = [(r.v, r.why) for r in rows.select(value.alias("v"), reason.alias("why")).collect()]
    assert got == [(5, None), (4, None), (5, None), (3, None), (None, "not a whole number"),
                   (None, "not a whole number"), (None, "not a whole number"), (9, "out of range 0-5"), (None, "missing")]
