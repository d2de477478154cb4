"""Numbers as learners see them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A shown value may get this many more decimals than declared before it is cut.
EXTRA_DECIMALS = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; inside lambdas Spark finds no common parts itself."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_away(x: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def rounded_text(value: Column, decimals: Column) -> Column:
    """``decimals`` places with trailing zeros dropped: 12.50 reads 12.5."""
    d = F.greatest(decimals, F.lit(0))
    pattern = F.when(d > 0, F.concat(F.lit("0."), F.repeat(F.lit("#"), d))).otherwise("0")
    return F.call_function("format_number", value, pattern)


def exact_text(value: Column, decimals: Column) -> Column:
    """Shortest text from ``decimals`` places up that still means the value, so a
    constant 0.1 declared with no decimals does not show as 0."""
    d = F.greatest(decimals, F.lit(0))

    def means_value(text: Column) -> Column:
        return F.abs(text.cast("double") - value) <= F.abs(value) * 1e-9

    # coalesce stops at the first hit, nearly always the declared decimals
    tries = [rounded_text(value, d + k) for k in range(EXTRA_DECIMALS + 1)]
    return F.coalesce(*[let(t, lambda x: F.when(means_value(x), x)) for t in tries], tries[-1])


def with_unit(text: Column, unit: Column) -> Column:
    return F.when(F.coalesce(unit, F.lit("")) == "", text).otherwise(
        F.concat(text, F.lit(" "), unit))


def uniform(*parts: Column | str) -> Column:
    """Reproducible number in [0, 1) from its key parts, on any partitioning."""
    key = F.md5(F.encode(F.concat_ws("|", *parts), "UTF-8"))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 4294967296.0
