"""Grouped aggregations: counts, shares of a total, outcome rates, summaries.

All of them aggregate with a partial (map-side) hash aggregate before the
shuffle, so a low-cardinality or heavily skewed key (3 statuses, 13 regions,
one region holding a third of all claims) moves one row per key per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions import (
    AMOUNT_SUM_T,
    COUNT_T,
    count_where,
    exact_avg,
    mean_double,
    pct,
)


def _filtered(df: DataFrame, where: Column | None) -> DataFrame:
    return df if where is None else df.filter(where)


def count_by(
    df: DataFrame, keys: Sequence[str | Column], where: Column | None = None, name: str = "claims_count"
) -> DataFrame:
    """``SELECT keys, COUNT(*) AS name ... GROUP BY keys``."""
    return _filtered(df, where).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def share_of_total(
    df: DataFrame,
    keys: Sequence[str | Column],
    where: Column | None = None,
    dp: int = 2,
    count_name: str = "n",
    pct_name: str = "pct",
) -> DataFrame:
    """Group counts with each group's percentage of all (filtered) rows.

    The total is taken *after* aggregation, as a scalar subquery summing the
    group counts, instead of attaching a one-row total to every fact row
    before grouping (which Spark would plan as a nested-loop join over the
    whole fact table).
    """
    counts = count_by(df, keys, where, count_name)
    total = counts.select(F.sum(count_name)).scalar()
    return counts.withColumn(pct_name, pct(F.col(count_name), total, dp))


def outcome_rate(
    df: DataFrame,
    keys: Sequence[str | Column],
    base: Column,
    hit: Column,
    dp: int = 1,
    base_name: str = "base_count",
    hit_name: str = "hit_count",
    rate_name: str = "rate_pct",
) -> DataFrame:
    """Among rows matching ``base``, how many also match ``hit``, and the % rate."""
    return (
        df.filter(base)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(base_name), count_where(hit).alias(hit_name))
        .withColumn(rate_name, pct(F.col(hit_name), F.col(base_name), dp))
    )


def summary_stats(
    df: DataFrame,
    keys: Sequence[str | Column],
    value: Column,
    stats: Sequence[str],
    dp: int = 2,
    where: Column | None = None,
    names: dict[str, str] | None = None,
    integral: bool = False,
) -> DataFrame:
    """count / min / max / sum / avg of ``value`` per group.

    ``avg`` is the exact HALF_UP ``round(sum/count, dp)``; ``sum`` keeps the
    DECIMAL(22,2) sum type for amounts.
    """
    names = names or {}
    builders = {
        "count": lambda: F.count(F.lit(1)).cast(COUNT_T),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "sum": lambda: F.sum(value).cast(AMOUNT_SUM_T) if not integral else F.sum(value),
        "avg": lambda: exact_avg(value, dp, integral=integral),
        "mean": lambda: mean_double(value),
    }
    aggs = [builders[s]().alias(names.get(s, s)) for s in stats]
    src = _filtered(df, where)
    if keys:
        return src.groupBy(*keys).agg(*aggs)
    return src.agg(*aggs)


def reaggregate(
    df: DataFrame,
    keys: Sequence[str],
    sums: Sequence[str] = (),
    avgs: Sequence[str] = (),
    weights: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Roll a reporting view up to coarser keys, as a BI tool would.

    Counts and amounts are summed; rates and durations are averaged
    (unweighted, the BI default). ``weights`` maps an output name to a
    (numerator, denominator) pair of summed columns and gives the weighted
    rate ``sum(num) / sum(den)`` instead.
    """
    aggs = [F.sum(c).alias(c) for c in sums]
    aggs += [F.avg(c).alias(c) for c in avgs]
    for name, (num, den) in (weights or {}).items():
        aggs.append(
            (F.sum(num).cast("double") / F.when(F.sum(den) != 0, F.sum(den)).cast("double")).alias(name)
        )
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
