"""Formula reading, catalog checks and generated problems."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tutelage import schemas
from tutelage.functions import formulas as fm
from tutelage.functions import numbers as N
from tutelage.operators import maths as M
from tutelage.session import stored


def values(spark, cases):
    """Value or error of each (formula, variables)."""
    rows = [(i, f, list(env), [float(v) for v in env.values()]) for i, (f, env) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, expr string, names array<string>, values array<double>")
    return [r.error or r.value for r in M.eval_formulas(df).orderBy("i").collect()]


def test_arithmetic(spark):
    cases = {"-2^2": -4, "(-2)^2": 4, "2^3^2": 512, "2^-1": 0.5, "1+2*3": 7, "007 + .5": 7.5, "log(1000)": 3, "ln(e)": 1,
             "round(2.5)": 3, "round(-2.5)": -3, "min(2, 1)": 1, "2.5e-1 * 4": 1, "pi": math.pi, "8/2/2": 2, "--3": 3,
             "floor(-1.5) + ceil(1.2)": 0, "max(2, 3) - abs(-4)": -1, "floor(2^60)": 2.0**60, "10 - 4 - 3": 3, "pow(2, 10)": 1024,
             "sqrt(16) * exp(0) / cos(0)": 4, "log2(8) + log10(100) + sin(0) + tan(0)": 5}
    assert values(spark, [(f, {}) for f in cases]) == pytest.approx(list(cases.values()))


@pytest.mark.parametrize("formula", ["", "1 +", "2x", "a b", "a ** b", "a // b", "x = 1", "a.b",
                                     "[1]", "'s'", "f(a,)", "1_0", "2j", "a if b else c",
                                     "lambda: 0", "(1", "(" * 5000 + "1" + ")" * 5000])
def test_not_arithmetic(formula):
    assert fm.read(formula) == (False, [], False, [])


def test_errors_and_reserved_words(spark):
    cases = {
        "1 / (x - x)": "division by zero", "sqrt(0 - 1)": "not finite", "y + 1": 'undefined variable "y"', "nope(1)": 'unknown function "nope"',
        "min(1)": 'function "min" takes 2 argument(s)', "nope(y)": 'unknown function "nope"', "y + nope(1)": 'undefined variable "y"',
        "ln(0)": "not finite", "max(sqrt(0 - 1), 1)": "not finite", "floor(sqrt(0 - 1))": "not finite", "10^400": "not finite",
        "1/0 + y": 'undefined variable "y"', "1 / (1 / (x - x))": "division by zero", "min(1 / (x - x), 2)": "division by zero", "2 x": "does not parse", "": "does not parse"}
    assert values(spark, [(f, {"x": 1}) for f in cases]) == list(cases.values())
    assert values(spark, [("lambda + in", {"lambda": 1, "in": 2}), ("x * y", {"x": 2, "y": 4}), ("x * y", {"y": 3, "x": 5})]) == [3, 8, 15]
    assert fm.read("b * a + sqrt(b) - e")[1] == ["b", "a"]


def test_formulas_equal_plain_evaluation(spark):
    """Random expressions, against Python's own arithmetic."""
    rng = random.Random(4)

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["x", "y", "2", "0.5", "3"])
        kind = rng.random()
        if kind < 0.15:
            return f"-({grow(depth - 1)})"
        if kind < 0.3:
            return f"{rng.choice(['min', 'max'])}({grow(depth - 1)}, {grow(depth - 1)})"
        return f"({grow(depth - 1)} {rng.choice('+-*')} {grow(depth - 1)})"

    cases = [(grow(4), {"x": rng.randint(-4, 4), "y": rng.randint(-4, 4)}) for _ in range(200)]
    assert values(spark, cases) == pytest.approx([float(eval(f, {"min": min, "max": max}, env)) for f, env in cases])


def test_number_texts(spark):
    rows = [(12.5, 2), (0.375, 3), (3.0, 2), (0.1, 0), (1234567.0, 0), (2.5, 0), (0.0, 1)]
    df = spark.createDataFrame(rows, "v double, d int").select(
        N.rounded_text(F.col("v"), F.col("d")).alias("r"), N.exact_text(F.col("v"), F.col("d"))
        .alias("e"))
    got = df.collect()
    assert [r.e for r in got] == ["12.5", "0.375", "3", "0.1", "1234567", "2.5", "0"]
    assert [r.r for r in got] == ["12.5", "0.375", "3", "0", "1234567", "2", "0"]


def equation(**changes):
    base = dict(
        id="density", module="module_1", topic="Matter", name="Density", source="",
        expr="m / V * k", vars=[("m", "", "g", "", "input", 1.0, 9.0, 0.5, 0.0, 1),
                                ("V", "", "mL", "", "input", 2.0, 4.0, 0.0, 0.0, 2),
                                ("k", "", "", "", "constant", 0.0, 0.0, 0.0, 0.5, 0)],
        result=("rho", "g/mL", "density", 3), prompt="", use_note="", citation="",
        examples=[({"m": 6.0, "V": 3.0}, 1.0, 0.0, "")])
    return {**base, **changes}


def catalog(spark, *rows):
    data = [tuple(r[f] for f in schemas.EQUATION.names) for r in rows]
    return spark.createDataFrame(data, schemas.EQUATION).withColumn(
        "pos", F.monotonically_increasing_id()).coalesce(1)


def test_wrong_formula_is_dropped(spark):
    good = equation()
    wrong = equation(id="wrong", expr="m / V * 0.7")
    broken = equation(id="broken", expr="m * q", examples=[],
                      vars=[("m", "", "", "", "", 5.0, 1.0, 0.0, 0.0, 0)])
    eqs = catalog(spark, good, wrong, broken)
    reasons = {(r.equation_id, r.reason) for r in M.validate_catalog(eqs).collect()}
    assert ("wrong", "example 0: formula disagrees with the source") in reasons
    assert ("broken", 'undeclared variable "q"') in reasons
    assert ("broken", 'variable "m": max below min') in reasons
    kept, rejected = M.filter_catalog(eqs)
    assert [(r.id, r.verified) for r in kept.collect()] == [("density", True)]
    assert rejected.count() == 2


def test_samples_are_reproducible_and_in_range(spark):
    eqs = catalog(spark, equation())
    who = spark.createDataFrame([(i, "density") for i in range(50)], "learner_id int, equation_id string")
    one = M.sample_inputs(who, eqs, 3).select("learner_id", "draw", "values").collect()
    two = M.sample_inputs(who.repartition(7), eqs, 3).select("learner_id", "draw", "values").collect()
    assert sorted(one) == sorted(two) and len({tuple(r["values"]) for r in one}) > 100
    for r in one:
        m, v, k = r["values"]
        assert 1 <= m <= 9 and (m * 2) == round(m * 2) and 2 <= v <= 4 and k == 0.5


def test_problem_text(spark):
    eqs = catalog(spark, equation())
    row = eqs.withColumn("names", F.expr("array('m','V','k')")).withColumn(
        "values", F.expr("array(6.5D, 3.0D, 0.5D)"))
    p = M.generate_problems(row).first()
    assert p.question == "Given V = 3 mL, m = 6.5 g, calculate density."
    assert p.answer_text == "1.083 g/mL"
    assert p.steps == ["rho = m / V * k", "rho = 6.5 / 3 × 0.5", "rho = 1.083 g/mL"]


def test_practice_labels(spark):
    eqs = catalog(spark, equation(), equation(id="d2", name="Density two"),
                  equation(id="z", topic="Zinc", name="Zinc"))
    rows = M.practice_set(eqs).where("label <> ''").collect()
    labels = {(r.equation_id, r.label) for r in rows}
    assert ("density", "P1") in labels and ("d2", "P8") in labels
    assert ("density", "C9(a)") in labels and ("d2", "C9(b)") in labels
    assert ("z", "P10") in labels and not any(r.label.startswith("C") for r in rows
                                              if r.topic == "Zinc")


def test_a_draw_is_worked_out_once():
    """What a draw is made of is bound, not written out again wherever it is used."""
    v = F.col("v")
    assert str(M._sample(v, F.lit("k"))).count("md5") == 1
    assert str(N.exact_text(F.col("x"), F.lit(0))).count("format_number") <= N.EXTRA_DECIMALS + 2


@pytest.mark.parametrize("parts", [7])
def test_problems_are_dealt_to_all_tasks_and_solved_once(spark, in_range_parts, parts):
    eqs = catalog(spark, *(equation(id=f"d{i}", name=f"Density {i}") for i in range(9))).coalesce(1)
    who = spark.createDataFrame([(1, f"d{i}") for i in range(9)], "learner_id int, equation_id string").coalesce(1)
    problems = M.generate_problems(M.sample_inputs(who, eqs, 2))
    assert problems.rdd.getNumPartitions() == parts
    assert problems._jdf.queryExecution().optimizedPlan().toString().count("division by zero") == 1
    assert problems.count() == 18


@pytest.mark.parametrize("parts", [7])
def test_practice_is_dealt_to_all_tasks(spark, in_range_parts, parts, monkeypatch):
    solved = []

    def watched(df, purpose):
        solved.append(df.rdd.getNumPartitions())
        return stored(df, purpose)

    monkeypatch.setattr(M, "stored", watched)
    eqs = catalog(spark, *(equation(id=f"d{i}", name=f"Density {i}") for i in range(9))).coalesce(1)
    assert M.practice_set(eqs).count() == 9 * 5 + 5
    assert solved == [3 * parts]
