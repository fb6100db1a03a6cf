"""Monthly KPIs over two dates of the same fact row.

A claim is *received* in one month and *closed* (decided) in another. The
month spine is every month that holds a received date or any decision date.
Instead of three scans (spine, received aggregate, closed aggregate) and two
outer joins, the facts are summed once per (opened month, closed month): one
scan, one shuffle of at most (month pairs x tasks) partial rows. Those few rows
are then told to both of their months and summed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions import month_start


def dual_date_monthly(
    fact: DataFrame,
    opened: str,
    closed: str,
    opened_sums: dict[str, Column],
    closed_sums: dict[str, Column],
    month_name: str = "month_start_date",
) -> DataFrame:
    """(month, *opened_sums, *closed_sums) for every month of either date.

    ``opened_sums`` are added up in the row's opening month and ``closed_sums`` in
    its closing month; both are aggregates that add up (counts, sums). A NULL date
    makes no month on its side.
    """
    pairs = month_pair_sums(fact, opened, closed, {**opened_sums, **closed_sums})
    return sums_by_month(pairs, list(opened_sums), list(closed_sums), month_name)


def month_pair_sums(fact: DataFrame, opened: str, closed: str, sums: dict[str, Column]) -> DataFrame:
    """The one aggregation of the facts, per (opened month, closed month); also on a stream."""
    return fact.groupBy(month_start(opened).alias("_opened"), month_start(closed).alias("_closed")).agg(
        *[value.alias(name) for name, value in sums.items()]
    )


def sums_by_month(pairs: DataFrame, opened: list[str], closed: list[str], month_name: str) -> DataFrame:
    """Month-pair sums told to the months: ``opened`` sums to the first, ``closed`` sums to the second."""
    sides = F.explode(F.array(
        F.struct(F.col("_opened").alias("month"), F.lit(True).alias("opens")),
        F.struct(F.col("_closed").alias("month"), F.lit(False).alias("opens")),
    ))
    told = pairs.select("*", sides.alias("_side")).filter(F.col("_side.month").isNotNull())
    opens = F.col("_side.opens")
    return told.groupBy(F.col("_side.month").alias(month_name)).agg(
        *[F.sum(F.when(opens if name in opened else ~opens, F.col(name))).alias(name) for name in opened + closed]
    )
