"""Column-level building blocks (built-in Spark expressions only)."""

from claimlens.functions.exprs import (  # noqa: F401
    AMOUNT_SUM_T,
    AMOUNT_T,
    COUNT_T,
    DAYS_T,
    avg_type,
    count_where,
    days_between,
    exact_avg,
    mean_double,
    month_start,
    nullif_zero,
    padded,
    pct,
    pct_type,
    pick,
    ratio,
    rounded_avg,
    sum_where,
)
