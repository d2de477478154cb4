"""Formula text as postfix tokens, and their value by a fold in the JVM.

Formulas are data: they arrive as a column, so no fixed set of column expressions can cover them.
Every distinct formula is read once, with Python's own grammar (``^`` as ``**``, same precedence)
behind a whitelist, into an array of tokens.  All rows are then computed by one column expression,
a fold of the tokens over a stack.
"""

from __future__ import annotations

import ast
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutelage.session import stored

CONSTANTS = {"pi": math.pi, "e": math.e}
# Callable names with their argument counts.
ARITY = {**dict.fromkeys(("sqrt", "abs", "exp", "ln", "log", "log2", "log10", "sin", "cos", "tan", "floor", "ceil", "round"), 1),
         **dict.fromkeys(("pow", "min", "max"), 2)}
BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "pow"}

_PLAIN = re.compile(r"[\w\s+\-*/^().,]*\Z", re.ASCII)
_FOREIGN = re.compile(r"\*\s*\*|/\s*/|,\s*\)|\d_|(?<![\w.])_\d", re.ASCII)
_NAME = re.compile(r"(?<![\w.])([A-Za-z_]\w*)", re.ASCII)

#: Operations by number, the usual ones first; a formula's row compares few of them.
OPS = ("number", "name", "*", "/", "+", "-", "pow", "negative", "fail", *sorted(set(ARITY) - {"pow"}), "none")
#: op, how many values it takes off the stack, the number of a ``number``, the text of a ``name`` or ``fail``.
TOKENS = "array<struct<op:int,pops:int,number:double,text:string>>"
READ = f"struct<parses:boolean,names:array<string>,fails:boolean,tokens:{TOKENS}>"


def read(formula: str) -> tuple[bool, list[str], bool, list[tuple]]:
    """(parses, variables in the order they appear, whether a call cannot work, tokens) of a formula.

    Names get a prefix first, so that words Python reserves stay usable.
    """
    nothing = (False, [], False, [])
    if not _PLAIN.match(formula) or _FOREIGN.search(formula):
        return nothing
    text = re.sub(r"(?<![\w.])0+(?=\d)", "", formula, flags=re.ASCII)
    text = _NAME.sub(r"n_\1", text).replace("^", "**")
    tokens: list[tuple] = []
    try:
        tree = ast.parse(" ".join(text.split()), mode="eval").body
        if not _postfix(tree, tokens):
            return nothing
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return nothing
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    found = sorted((n.col_offset, n.id[2:]) for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called)
    names = [n for n in dict.fromkeys(n for _, n in found) if n not in CONSTANTS]
    return True, names, any(t[0] == "fail" for t in tokens), [(OPS.index(op), *rest) for op, *rest in tokens]


def _postfix(node: ast.AST, out: list[tuple]) -> bool:
    """Append the tokens of an expression; False where it is more than plain arithmetic.

    A call that cannot work fails before its arguments are looked at.
    """
    match node:
        case ast.Constant(value=int() | float() as value) if not isinstance(value, bool):
            out.append(("number", 0, float(value), None))
        case ast.Name(id=name):
            known = CONSTANTS.get(name[2:])
            out.append(("name", 0, None, name[2:]) if known is None else ("number", 0, known, None))
        case ast.UnaryOp(op=ast.UAdd() | ast.USub() as op, operand=operand):
            if not _postfix(operand, out):
                return False
            if isinstance(op, ast.USub):
                out.append(("negative", 1, None, None))
        case ast.BinOp(left=left, op=op, right=right) if type(op) in BINARY:
            if not (_postfix(left, out) and _postfix(right, out)):
                return False
            out.append((BINARY[type(op)], 2, None, None))
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
            name = name[2:]
            if name not in ARITY:
                out.append(("fail", 0, None, f'unknown function "{name}"'))
            elif len(args) != ARITY[name]:
                out.append(("fail", 0, None, f'function "{name}" takes {ARITY[name]} argument(s)'))
            if not all([_postfix(a, out) for a in args]):
                return False
            out.append((name if len(args) == ARITY.get(name) else "none", len(args), None, None))
        case _:
            return False
    return True


def with_tokens(rows: DataFrame, expr: str = "expr") -> DataFrame:
    """``rows`` with the column ``read`` (parses, names, tokens) of their formula; null reads as ''.
    Rows that have it already stay as they are.

    Distinct formulas are read and written, so Spark knows how few they are before it joins.
    """
    if "read" in rows.columns:
        return rows
    text = F.coalesce(expr, F.lit(""))
    table = stored(rows.select(text.alias("_formula")).distinct().withColumn("read", F.udf(read, READ, useArrow=False)("_formula")), "formulas")
    return rows.withColumn("_formula", text).join(table, "_formula").drop("_formula")


def _applied(op: Column, x: Column, y: Column) -> Column:
    """Value of an operation; ``x`` is the last operand, ``y`` the one before.

    A division by zero gives null, and so does everything that is made of it; other values that do not
    exist are NaN.
    """
    nan = F.lit(float("nan"))

    def whole(rounded: Column) -> Column:
        # from 2**52 on every number is whole already
        return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(rounded.cast("double"))

    def of_positive(value: Column) -> Column:
        return F.when(x.isNotNull(), F.coalesce(value, nan))

    def either(least: Column) -> Column:
        return F.when(x.isNull() | y.isNull(), None).when(F.isnan(x) | F.isnan(y), nan).otherwise(least)

    cases = {
        "*": y * x, "/": F.try_divide(y, x), "+": y + x, "-": y - x, "pow": F.pow(y, x), "negative": -x, "abs": F.abs(x),
        "ceil": whole(F.ceil(x)), "cos": F.cos(x), "exp": F.exp(x), "floor": whole(F.floor(x)), "ln": of_positive(F.ln(x)),
        "log": of_positive(F.log10(x)), "log10": of_positive(F.log10(x)), "log2": of_positive(F.log2(x)), "max": either(F.greatest(y, x)),
        "min": either(F.least(y, x)), "round": whole(F.signum(x) * F.floor(F.abs(x) + 0.5)), "sin": F.sin(x), "sqrt": F.sqrt(x),
        "tan": F.tan(x),
    }
    name, value = next(items := iter(cases.items()))
    out = F.when(op == OPS.index(name), value)
    for name, value in items:
        out = out.when(op == OPS.index(name), value)
    return out


def value_of(tokens: Column, names: Column, values: Column, known: Column, fails: Column) -> Column:
    """struct(value, error) of a formula over the row's own named values.

    ``known`` are the formula's variables and ``fails`` whether one of its calls cannot work; both only
    decide whether the tokens are searched for a fault.
    """
    number, name, fail = (OPS.index(o) for o in ("number", "name", "fail"))

    def step(stack: Column, token: Column) -> Column:
        op = token["op"]
        given = F.coalesce(F.get(values, F.array_position(names, token["text"]).cast("int") - 1).cast("double"), F.lit(float("nan")))
        pushed = F.when(op == number, token["number"]).when(op == name, given).otherwise(
            _applied(op, F.try_element_at(stack, F.lit(-1)), F.try_element_at(stack, F.lit(-2))))
        return F.concat(F.when(token["pops"] == 0, stack).otherwise(F.slice(stack, 1, F.size(stack) - token["pops"])), F.array(pushed))

    def settled(stack: Column) -> Column:
        value = F.try_element_at(stack, F.lit(-1))
        error = F.when(value.isNull(), "division by zero").when(F.isnan(value) | (F.abs(value) == float("inf")), "not finite")
        return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))

    def failed(error: Column) -> Column:
        return F.struct(F.lit(None).cast("double").alias("value"), error.alias("error"))

    fault = F.get(F.filter(tokens, lambda t: (t["op"] == fail) | ((t["op"] == name) & ~F.array_contains(names, t["text"]))), F.lit(0))
    told = F.when(fault["op"] == fail, fault["text"]).otherwise(F.concat(F.lit('undefined variable "'), fault["text"], F.lit('"')))
    return (
        F.when(F.size(tokens) == 0, failed(F.lit("does not parse")))
        .when(fails | (F.size(F.array_except(known, names)) > 0), failed(told))
        .otherwise(F.aggregate(tokens, F.array().cast("array<double>"), step, settled)))
