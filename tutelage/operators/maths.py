"""Numeric practice: checking equation catalogs, sampling, solving, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutelage.functions import numbers as N
from tutelage.functions import text as X
from tutelage.functions.formulas import value_of, with_tokens
from tutelage.operators.ordered import running_sum
from tutelage.session import dealt, stored

# Fixed values.
RELATIVE_TOLERANCE = 0.005
LEAST_TOLERANCE = 1e-9
SAMPLE_DECIMALS = 2
WORKED, PRACTICE, COMPREHENSIVE, MAX_PARTS = 1, 4, 1, 5
PLACEHOLDER = r"\{([A-Za-z_][A-Za-z0-9_]*)\}"


def _is_constant(v: Column) -> Column:
    return F.coalesce(v.role, F.lit("")) == "constant"


def catalog_order(equations: DataFrame, module: str | None = None) -> DataFrame:
    """Equations by topic then name, of one module or all."""
    rows = equations if not module else equations.where(F.col("module") == module)
    return rows.orderBy("topic", "name", "id")


def eval_formulas(rows: DataFrame) -> DataFrame:
    """Value or error of ``expr`` over (``names``, ``values``) of each row."""
    return _evaluated(with_tokens(rows)).drop("read")


def _evaluated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_r", _value(F.col("names"), F.col("values"))).select(
        *rows.columns, F.col("_r.value").alias("value"), F.col("_r.error").alias("error"))


def _value(names: Column, values: Column) -> Column:
    return value_of(F.col("read.tokens"), names, values, F.col("read.names"), F.col("read.fails"))


def _sample(v: Column, *key: Column | str) -> Column:
    """One reproducible draw inside a variable's range, on its grid or decimals."""
    power = F.pow(F.lit(10.0), F.when(F.coalesce(v.decimals, F.lit(0)) == 0, SAMPLE_DECIMALS)
                  .otherwise(v.decimals))

    def on_grid(raw: Column) -> Column:
        nearest = N.let(raw / v.step, lambda x: N.half_away(x) * v.step)
        lifted = N.let(nearest, lambda x: F.when(x < v.min, x + v.step).otherwise(x))
        return N.let(lifted, lambda x: F.when(x > v.max, x - v.step).otherwise(x))

    return N.let(v.min + N.uniform(*key, v["name"]) * (v.max - v.min), lambda raw: F.when(
        v.step > 0, on_grid(raw)).otherwise(N.let(raw * power, N.half_away) / power))


def sample_inputs(assigned: DataFrame, equations: DataFrame, draws: int, seed: int = 1
                  ) -> DataFrame:
    """``draws`` input sets per assigned (learner_id, equation_id).

    A draw depends only on its key, so any partitioning gives the same numbers.
    """
    catalog = with_tokens(equations).withColumnRenamed("id", "equation_id")
    posed = dealt(assigned, "equation_id").join(dealt(catalog, "equation_id"), "equation_id")
    drawn = posed.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    return with_samples(drawn, F.lit(str(seed)), F.col("learner_id").cast("string"),
                        F.col("equation_id"), F.col("draw").cast("string"))


def with_samples(rows: DataFrame, *key: Column) -> DataFrame:
    """Add ``names`` and ``values`` for the variables of each row's equation."""
    values = F.transform("vars", lambda v: F.when(_is_constant(v), v.value).otherwise(
        _sample(v, *key)))
    return rows.withColumn("names", F.transform("vars", lambda v: v["name"])).withColumn(
        "values", values)


def _shown(v: Column, value: Column) -> Column:
    return N.exact_text(value, F.coalesce(v.decimals, F.lit(0)))


def generate_problems(samples: DataFrame) -> DataFrame:
    """Question, answer and worked steps of every sampled input set.

    Rows whose formula does not compute are left out.
    """
    # a filter would be pushed below the draws and work out all of them, and the formula, a second time
    results = F.filter(F.array(_value(F.col("names"), F.col("values"))), lambda r: r.error.isNull())
    rows = with_tokens(samples)
    solved = rows.select("*", F.explode(results).alias("_r")).select(*rows.columns, "_r.value")
    pairs = F.zip_with("vars", "values", lambda v, x: F.struct(
        v["name"].alias("name"), F.coalesce(F.nullif(v.symbol, F.lit("")), v["name"]).alias("symbol"),
        v.unit.alias("unit"), _is_constant(v).alias("fixed"), _shown(v, x).alias("shown")))
    rows = solved.withColumn("p", pairs)
    given = F.array_sort(F.transform(F.filter("p", lambda q: ~q.fixed), lambda q: F.concat(
        q.symbol, F.lit(" = "), N.with_unit(q.shown, q.unit))))
    told = F.aggregate("p", F.col("prompt"), lambda acc, q: F.replace(
        acc, F.concat(F.lit("{"), q["name"], F.lit("}")), q.shown))
    has_prompt = F.coalesce("prompt", F.lit("")).rlike(r"\S")
    question = F.when(has_prompt, told).otherwise(F.concat(
        F.lit("Given "), F.array_join(given, ", "), F.lit(", calculate "),
        F.coalesce(F.nullif("result.desc", F.lit("")), "name"), F.lit(".")))
    has_source = F.coalesce("source", F.lit("")).rlike(r"\S")
    lhs = F.coalesce(F.nullif("result.symbol", F.lit("")), F.lit("answer"))
    right_side = F.when(has_source, F.regexp_replace("source", r"(?s)\A[^=]*=", "")).otherwise(
        F.col("expr"))
    # longest names first, each as a whole word
    words = F.array_distinct(F.flatten(F.transform("p", lambda q: F.array(
        F.struct((-F.length(q.symbol)).alias("k"), q.symbol.alias("w"), q.shown.alias("t")),
        F.struct((-F.length(q["name"])).alias("k"), q["name"].alias("w"), q.shown.alias("t"))))))
    filled = F.aggregate(F.array_sort(words), right_side, lambda acc, w: F.regexp_replace(
        acc, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), w.w, F.lit(r"\E(?![A-Za-z0-9_])")), w.t))
    answer = N.with_unit(N.rounded_text(
        F.col("value"), F.coalesce("result.decimals", F.lit(0))), F.col("result.unit"))
    eq = F.lit(" = ")
    steps = F.array(
        F.when(has_source, F.col("source")).otherwise(F.concat(lhs, eq, "expr")),
        F.concat(lhs, eq, X.strip(F.replace(filled, F.lit("*"), F.lit("×")))),
        F.concat(lhs, eq, "answer_text"))
    return rows.withColumn("question", question).withColumn(
        "answer_text", answer).withColumn("steps", steps).drop("p", "read")


def practice_set(equations: DataFrame, seed: int = 1) -> DataFrame:
    """A numbered practice set per module: worked examples, practice P1.., and one
    multi-part problem C.. per topic of two or more equations.

    P and C share one running number in reading order; worked examples have none.
    """
    def draws(rows: DataFrame, kind: int, n: int) -> DataFrame:
        numbered = rows.select("*", F.lit(kind).alias("kind"), F.explode(
            F.sequence(F.lit(1), F.lit(n))).alias("slot"))
        return with_samples(numbered, F.lit(str(seed)), F.col("module"), F.col("id"), F.concat(
            F.col("kind").cast("string"), F.lit("."), F.col("slot").cast("string")))

    equations = dealt(with_tokens(equations), "id")
    topic_sizes = equations.groupBy("module", "topic").agg(F.count(F.lit(1)).alias("n")).where(
        "n >= 2").select("module", "topic")
    parts = draws(equations.join(topic_sizes, ["module", "topic"], "left_semi"), 2, COMPREHENSIVE)
    singles = generate_problems(draws(equations, 0, WORKED)).unionByName(generate_problems(draws(equations, 1, PRACTICE)))
    by_name = Window.partitionBy("module", "topic", "slot").orderBy("name", "id")
    keep = ["module", "topic", "name", "id", "kind", "slot", "question", "answer_text", "steps"]
    multi = (
        generate_problems(parts).select(*keep)
        .withColumn("part", F.row_number().over(by_name)).where(F.col("part") <= MAX_PARTS)
    )
    rows = singles.select(*keep).withColumn("part", F.lit(0)).unionByName(multi)
    # solved once: the numbering below reads the problems more than once
    rows = stored(rows, "problems")
    counted = (F.col("kind") == 1) | ((F.col("kind") == 2) & (F.col("part") == 1))
    # Practice comes before the multi-part problem of its topic.
    later = F.when(F.col("kind") == 2, 1).otherwise(0)
    numbered = running_sum(
        rows, ["module"],
        ["topic", later, F.when(later == 1, F.col("slot")),
         F.when(later == 1, F.col("part")), "name", "id", "kind", "slot"],
        counted.cast("bigint"), "number")
    label = (
        F.when(F.col("kind") == 1, F.concat(F.lit("P"), F.col("number").cast("string")))
        .when(F.col("kind") == 2, F.concat(
            F.lit("C"), F.col("number").cast("string"), F.lit("("),
            F.substring(F.lit("abcde"), F.col("part"), F.lit(1)), F.lit(")")))
        .otherwise("")
    )
    return numbered.select(
        "module", "topic", F.col("id").alias("equation_id"), "kind", "slot",
        label.alias("label"), "question", "answer_text", "steps")


def validate_catalog(equations: DataFrame) -> DataFrame:
    """Every problem of every equation as (equation_id, pos, reason).

    ``pos`` is the equation's place in its catalog.  An equation without a readable
    formula is only reported for that, the later checks need one.
    """
    first = equations.groupBy("id").agg(F.min("pos").alias("first_pos"))
    has_expr = F.coalesce("expr", F.lit("")).rlike(r"\S")
    named = F.filter("vars", lambda v: F.coalesce(v["name"], F.lit("")) != "")
    rows = (
        equations.join(first, "id", "left").withColumn("has_expr", has_expr)
        .transform(with_tokens).withColumn("named", named)
        .withColumn("mid", _value(
            F.transform(named, lambda v: v["name"]),
            F.transform(named, lambda v: F.when(_is_constant(v), v.value).otherwise(
                (v.min + v.max) / 2))))
    )
    reads = F.col("has_expr") & F.col("read.parses")
    declared = F.transform("named", lambda v: v["name"])

    def some(when: Column, reason: Column | str) -> Column:
        return F.when(when, F.lit(reason) if isinstance(reason, str) else reason)

    def quoted(before: str, name: Column, after: str) -> Column:
        return F.concat(F.lit(before + '"'), name, F.lit('"' + after))

    def per_variable(v: Column) -> Column:
        unnamed = F.coalesce(v["name"], F.lit("")) == ""
        sampled = ~unnamed & ~_is_constant(v)
        return F.array(
            some(unnamed, "variable with empty name"),
            some(sampled & (v.max < v.min), quoted("variable ", v["name"], ": max below min")),
            some(sampled & (v.max == v.min), quoted("variable ", v["name"], ": empty range")),
            some(sampled & (v.step < 0), quoted("variable ", v["name"], ": negative step")))

    def missing(names: Column, reason) -> Column:
        return F.transform(F.filter(names, lambda n: ~F.array_contains(declared, n)), reason)

    nothing = F.array().cast("array<string>")
    basic = F.array(
        some(F.coalesce("id", F.lit("")) == "", "missing id"),
        some((F.col("id") != "") & (F.col("pos") > F.col("first_pos")), "duplicate id"),
        some(F.coalesce("name", F.lit("")) == "", "missing name"),
        some(~F.col("has_expr"), "missing expr"),
        some(F.col("has_expr") & ~F.col("read.parses"), "expr does not parse"))
    deep = F.when(reads, F.concat(
        F.flatten(F.transform("vars", per_variable)),
        missing(F.col("read.names"), lambda n: quoted("undeclared variable ", n, "")),
        missing(F.regexp_extract_all(F.coalesce("prompt", F.lit("")), F.lit(PLACEHOLDER),
                                     F.lit(1)), lambda n: quoted("undeclared placeholder ", n, "")),
        F.array(some(F.col("mid.error").isNotNull(), F.concat(
            F.lit("mid-range sample: "), "mid.error"))))).otherwise(nothing)
    fixed = rows.select("id", "pos", F.explode(F.filter(
        F.concat(basic, deep), lambda r: r.isNotNull())).alias("reason"))
    return fixed.unionByName(_failed_examples(rows.where(reads))).select(
        F.col("id").alias("equation_id"), "pos", "reason")


def _failed_examples(rows: DataFrame) -> DataFrame:
    """Worked examples of the source the formula does not reproduce."""
    fixed = F.map_from_entries(F.transform(
        F.filter("named", _is_constant), lambda v: F.struct(v["name"], v.value)))
    given = F.map_filter(fixed, lambda k, _: ~F.map_contains_key(F.col("x.inputs"), k))
    examples = (
        rows.select("id", "pos", "read", fixed.alias("fixed"), "named",
                    F.posexplode("examples").alias("i", "x"))
        .withColumn("env", F.map_concat(given, F.col("x.inputs")))
        .select("id", "pos", "read", "i", "x", F.map_keys("env").alias("names"),
                F.map_values("env").alias("values"))
    )
    relative = F.coalesce("x.tol", F.lit(0.0)) == 0
    bound = F.when(relative, F.greatest(
        F.abs("x.expected") * RELATIVE_TOLERANCE, F.lit(LEAST_TOLERANCE))).otherwise(
        F.col("x.tol"))
    label = F.concat(F.lit("example "), F.col("i").cast("string"))
    reason = F.when(F.col("error").isNotNull(), F.concat(label, F.lit(": "), "error")).when(
        F.abs(F.col("value") - F.col("x.expected")) > bound,
        F.concat(label, F.lit(": formula disagrees with the source")))
    return _evaluated(examples).select("id", "pos", reason.alias("reason")).where(
        F.col("reason").isNotNull())


def filter_catalog(equations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) equations: one problem anywhere rejects every entry of that id."""
    bad = stored(validate_catalog(equations).select(F.col("equation_id").alias("id")).distinct(), "rejected")
    verified = F.coalesce(F.size("examples"), F.lit(0)) > 0
    marked = equations.withColumn("verified", verified)
    return marked.join(bad, "id", "left_anti"), marked.join(bad, "id", "left_semi")
