"""Column builders shared by every report.

All of them are built-in Catalyst expressions (no Python UDFs), so they stay
inside whole-stage codegen.

Numeric conventions (exact where the source semantics are exact):

* percentages and decimal averages go through Spark decimal arithmetic and are
  rounded HALF_UP once, at the end (``round`` on a decimal). ``avg`` on a
  decimal is *not* used: it rounds to 6 digits first, and a second rounding
  can then go the wrong way on large groups.
* unrounded ratios are one IEEE double division of two counts.
* day differences are ``datediff`` (integer days, no time-zone effect).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Result types, fixed so every engine returns the same declared type.
COUNT_T = T.LongType()
AMOUNT_T = T.DecimalType(12, 2)
AMOUNT_SUM_T = T.DecimalType(22, 2)
DAYS_T = T.IntegerType()


def pct_type(dp: int) -> T.DecimalType:
    return T.DecimalType(7, dp)


def avg_type(dp: int) -> T.DecimalType:
    return T.DecimalType(12, dp)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(c: str | Column) -> Column:
    """First day of the month as a DATE (``trunc``; ``date_trunc`` gives a timestamp)."""
    return F.trunc(col(c), "month")


def days_between(end: str | Column, start: str | Column) -> Column:
    """Whole days from ``start`` to ``end`` (equal to the epoch-seconds form on DATEs)."""
    return F.datediff(col(end), col(start))


def count_where(pred: Column, null_on_empty: bool = False) -> Column:
    """Rows matching ``pred``.

    ``null_on_empty`` mimics ``SUM(CASE WHEN p THEN 1 ELSE 0 END)``, which is
    NULL over an empty input; the default ``count_if`` is 0 there.
    """
    if null_on_empty:
        return F.sum(F.when(pred, F.lit(1)).otherwise(F.lit(0))).cast(COUNT_T)
    return F.count_if(pred)


def sum_where(pred: Column, value: str | Column, zero: Column | None = None) -> Column:
    """Sum of ``value`` over rows matching ``pred``; ``zero`` (default 0) when none match."""
    return F.coalesce(F.sum(F.when(pred, col(value))), zero if zero is not None else F.lit(0))


def nullif_zero(c: Column) -> Column:
    return F.when(c != 0, c)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as one double division; NULL when ``den`` is 0."""
    return num.cast("double") / nullif_zero(den).cast("double")


def pct(num: Column, den: Column, dp: int) -> Column:
    """``ROUND(100.0 * num / NULLIF(den, 0), dp)`` with exact HALF_UP rounding.

    Counts are cast to DECIMAL(20,0); 100 * num / den is then a DECIMAL(38,14)
    quotient (itself rounded HALF_UP at 14 digits), which rounds to ``dp``
    digits without a double-rounding error for any denominator below 10^13.
    Meant for a part of a whole (0..100 %); the DECIMAL(7, dp) result holds
    up to 99999.x %, and ANSI mode raises beyond that instead of wrapping.
    """
    n = num.cast(T.DecimalType(20, 0)) * F.lit(100)
    d = nullif_zero(den).cast(T.DecimalType(20, 0))
    return F.round(n / d, dp).cast(pct_type(dp))


def exact_avg(value: Column, dp: int, where: Column | None = None, integral: bool = False) -> Column:
    """``ROUND(AVG(value), dp)`` computed as ``round(sum / count, dp)``.

    For DECIMAL(12,2) input the quotient is DECIMAL(38,18); integral input
    (day counts) is widened to DECIMAL(12,0) first, giving DECIMAL(38,16).
    Either way one HALF_UP rounding gives the exact result. NULL when no row
    qualifies.
    """
    v = value.cast(T.DecimalType(12, 0)) if integral else value
    if where is not None:
        v = F.when(where, v)
    n = nullif_zero(F.count(v)).cast(T.DecimalType(20, 0))
    return F.round(F.sum(v) / n, dp).cast(avg_type(dp))


def rounded_avg(total: Column, n: Column, dp: int) -> Column:
    """``ROUND(total / n, dp)`` of sums already taken (whole-number totals), HALF_UP once; NULL when n is 0."""
    return F.round(total.cast(T.DecimalType(22, 0)) / nullif_zero(n).cast(T.DecimalType(16, 0)), dp).cast(avg_type(dp))


def mean_double(value: Column, where: Column | None = None) -> Column:
    """Unrounded average as ``double(sum) / count``; NULL when no row qualifies."""
    v = value if where is None else F.when(where, value)
    return F.sum(v).cast("double") / nullif_zero(F.count(v)).cast("double")


def pick(index: Column, values: list[str]) -> Column:
    """``values[index]`` (0-based) from a literal array; map-only, no join.

    NULL for a NULL index. Spark declares ``element_at`` on an array without
    NULLs as non-null and reads some element for a NULL index, so the index is
    tested before.
    """
    chosen = F.element_at(F.array(*[F.lit(v) for v in values]), (index + F.lit(1)).cast("int"))
    return F.when(index.isNotNull(), chosen)


def padded(number: Column, width: int) -> Column:
    """Digits of ``number`` padded with zeros to ``width``; longer numbers stay whole
    (``lpad`` alone would cut them)."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))
