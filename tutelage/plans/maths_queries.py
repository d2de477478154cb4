"""Equation catalog and practice queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutelage import schemas
from tutelage.functions.formulas import with_tokens
from tutelage.functions.text import check_sheets
from tutelage.operators import maths as M
from tutelage.plans import fixtures as fx
from tutelage.session import shared_dir, stored
from tutelage.sources import files


def _inputs(s, d):
    """lineitem as formula inputs: the quantity places each input inside its range."""
    eq = with_tokens(fx.equations(s, d)).select(
        F.col("pos").alias("l_partkey"), "expr", "read", F.filter("vars", lambda v: v["name"] != "").alias("vars"))
    share = F.col("l_quantity") / 50
    values = F.transform("vars", lambda v: F.when(v.role == "constant", v.value).otherwise(
        v.min + share * (v.max - v.min)))
    return fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                             "l_quantity").join(eq, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "expr", "read",
        F.transform("vars", lambda v: v["name"]).alias("names"), values.alias("values"))


def _evaluated(s, d):
    return M.eval_formulas(_inputs(s, d)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        F.round("value", 6).alias("value"), "error")


def _assigned(s, d):
    return fx.attempts(s, d).select("learner_id", F.concat(F.lit("eq"), "topic").alias(
        "equation_id")).distinct()


def _samples(s, d):
    return M.sample_inputs(_assigned(s, d), stored(_clean(s, d)[0], "sound"), 2)


def _catalog(s, d):
    """The catalog as files of 500 equations, read back."""
    path = shared_dir(s, "catalog")
    body = F.to_json(F.struct(*[f.name for f in schemas.EQUATION.fields]))
    fx.equations(s, d).groupBy(F.floor(F.col("pos") / 500).alias("file")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", body.alias("body")))),
                                 lambda x: x.body), ",").alias("items")).select(F.concat(
            F.lit('{"program":"p","equations":['), "items", F.lit("]}")).alias("value")
    ).write.text(path)
    return files.load_catalog(s, path, multiline=False)


def _clean(s, d):
    return M.filter_catalog(stored(fx.equations(s, d), "equations"))


def _filtered(s, d):
    kept, rejected = _clean(s, d)
    cols = ["id", "pos", "verified"]
    return kept.select(*cols, F.lit(True).alias("kept")).unionByName(
        rejected.select(*cols, F.lit(False).alias("kept")))


QUERIES = {
    "load_catalog": lambda s, d: _catalog(s, d)[0].select(
        "program", "id", "module", "topic", "name", "expr", F.size("vars").alias("n_vars"),
        F.col("result.decimals").alias("decimals"), F.size("examples").alias("n_examples")),
    "load_catalog_variables": lambda s, d: _catalog(s, d)[1].select(
        "equation_id", "pos", "name", "symbol", "unit", "role", "min", "max", "step", "value",
        "decimals"),
    "load_catalog_examples": lambda s, d: _catalog(s, d)[2].select(
        "equation_id", "pos", F.size("inputs").alias("n_inputs"), "expected", "tol"),
    "catalog_order": lambda s, d: M.catalog_order(fx.equations(s, d)).select(
        "module", "topic", "name", "id"),
    "eval_formulas": _evaluated,
    "validate_catalog": lambda s, d: M.validate_catalog(fx.equations(s, d)),
    "filter_catalog": _filtered,
    "sample_inputs": lambda s, d: _samples(s, d).select(
        "learner_id", "equation_id", "draw", F.inline(F.arrays_zip("names", "values"))).withColumnRenamed(
        "names", "name").withColumnRenamed("values", "value"),
    "generate_problems": lambda s, d: M.generate_problems(_samples(s, d)).select(
        "learner_id", "equation_id", "draw", "question", F.round("value", 6).alias("answer"),
        "answer_text", F.array_join("steps", " | ").alias("steps")),
    "practice_set": lambda s, d: M.practice_set(stored(_clean(s, d)[0], "sound")).select(
        "module", "topic", "equation_id", "kind", "slot", "label", "question", "answer_text"),
    "check_sheets": lambda s, d: check_sheets(_sheets(s, d)).select(
        "doc_id", "status", "equations"),
}


def _sheets(s, d):
    """documents as equation sheets in every shape the check must tell apart."""
    k = F.col("doc_id")
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(
        i % 3 == 1, F.concat(F.lit("### "), x)).otherwise(x)), "\n")
    body = F.concat(F.when(k % 5 == 3, "").otherwise("# Equations\n"), lines)
    raw = (F.when(k % 5 == 0, F.concat(F.lit("```markdown\n"), body, F.lit("\n```")))
           .when(k % 5 == 1, F.concat(F.lit("  ```md\n"), body, F.lit("```\n")))
           .when(k % 5 == 4, "``` \n```").otherwise(body))
    return fx.table(s, d, "documents").select("doc_id", raw.alias("raw"))
