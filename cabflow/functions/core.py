"""Generic Column helpers: safe division, exact sums and stable rounding.

All helpers return plain Catalyst expressions (no Python UDFs), so they
stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.column import Column as _Column
from pyspark.sql.types import DecimalType
from pyspark.sql.window import WindowSpec


def col(c: Column | str) -> Column:
    return c if isinstance(c, _Column) else F.col(c)


def safe_div(num: Column | str, den: Column | str) -> Column:
    """``num / den``; NULL when ``den`` is zero or NULL (never raises under ANSI)."""
    return F.try_divide(col(num), col(den))


def above(x: Column | str, bound: Column | float) -> Column:
    """``x > bound`` as in the source dialect: FALSE for NaN (Spark takes NaN for the largest value)."""
    return (col(x) > bound) & ~F.isnan(col(x))


def at_least(x: Column | str, bound: Column | float) -> Column:
    """``x >= bound``; FALSE for NaN."""
    return (col(x) >= bound) & ~F.isnan(col(x))


# Values are summed as DECIMAL(38, 12): twelve decimals hold the digits of
# money, kilometres and minutes, and LARGEST leaves room for 10^11 addends.
SUM_SCALE = 12
FIXED = DecimalType(38, SUM_SCALE)
LARGEST = 1e15


def fixed(x: Column | str, largest: float = LARGEST) -> Column:
    """``x`` as an exact decimal; NULL stays NULL, NaN, infinities and larger values raise an error."""
    c = col(x).cast("double")
    problem = F.concat(F.lit("no exact decimal for "), c.cast("string"))
    return F.when(c.isNull(), F.lit(None).cast(FIXED)).when(F.abs(c) < largest, c.cast(FIXED)).otherwise(F.raise_error(problem))


def exact_sum(x: Column | str, over: WindowSpec | None = None) -> Column:
    """Order-independent SUM of a double, returned as a double.

    A double SUM depends on the order in which partial sums meet, so it can
    change between runs, partitionings and retries. Summing the value as a
    fixed-point decimal is associative: the result is the same for any plan,
    which also makes recomputed tasks after an executor loss bit-identical.
    NULLs are skipped; an all-NULL group gives NULL, as SUM does. A value
    that the decimal cannot hold is an error, never left out.
    """
    summed = F.sum(fixed(x))
    if over is not None:
        summed = summed.over(over)
    return summed.cast("double")


def round_dec(x: Column | str, digits: int) -> Column:
    """ROUND(x, digits) half away from zero on the decimal value of ``x``.

    Rounding the decimal text rather than the binary double keeps the result
    identical across engines (``1.005`` rounds to ``1.01``). A value that the
    decimal cannot hold is an error.
    """
    return F.round(fixed(x, 1e25), digits).cast("double")
