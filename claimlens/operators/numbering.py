"""Consecutive numbers over all rows, at any size.

``row_number() OVER (ORDER BY ...)`` as a window without partitions would sort every row in one
task. ``number_rows`` cuts the rows at splitters that Spark samples from the sort keys
themselves (``repartitionByRange``), so clustered or outlying keys, strings and NULLs
make ranges of about the same number of rows. ``row_numbers`` (``OVER ()``) leaves rows where
they are. Both write the rows once with their place in their partition; a count per
partition, one row a task, gives each partition its first number. The numbers are
read off the written rows, so a retried task gives the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.session import stored

_PLACE, _SLICE = "__place", "__slice"


def _placed(df: DataFrame, what: str) -> DataFrame:
    """``df`` written with the partition and the place in it of every row."""
    return stored(df.withColumn(_PLACE, F.monotonically_increasing_id()), what).withColumn(_SLICE, F.shiftright(_PLACE, 33))


def _numbered(placed: DataFrame, name: str) -> DataFrame:
    sizes = placed.groupBy(_SLICE).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(_SLICE, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # One row for each task that wrote the rows: small by construction.
    told = placed.join(F.broadcast(starts), _SLICE)
    return told.withColumn(name, F.col("__before") + F.col(_PLACE).bitwiseAND((1 << 33) - 1) + 1).drop(_PLACE, _SLICE, "__before")


def number_rows(df: DataFrame, *order: str | Column, name: str = "row_number", buckets: int | None = None, unique: bool = True) -> DataFrame:
    """``df`` with the 1-based place of each row in ``order`` (columns or sort expressions; NULLs come
    last unless an expression says otherwise).

    ``unique=False`` is for keys that many rows may share: ties are then cut at the rows' place in the
    written input, so even one key that all rows share makes even ranges. ``buckets`` is the number of
    ranges; by default Spark's, with small ones put together.
    """
    by = [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]
    if not unique:
        df = _placed(df, "unnumbered").drop(_SLICE)
        by.append(F.col(_PLACE))
    ranged = df.repartitionByRange(buckets, *by) if buckets else df.repartitionByRange(*by)
    ranged = ranged.sortWithinPartitions(*by)
    return _numbered(_placed(ranged if unique else ranged.drop(_PLACE), "numbered"), name)


def row_numbers(df: DataFrame, name: str = "row_number") -> DataFrame:
    """``row_number() OVER ()``: consecutive numbers in no particular order. No shuffle, no sort."""
    return _numbered(_placed(df, "numbered"), name)


def range_sizes(df: DataFrame, *order: str | Column, buckets: int) -> list[int]:
    """Rows in each range that ``number_rows`` would sort in one task (for tests and sizing)."""
    by = [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]
    cut = df.repartitionByRange(buckets, *by).groupBy(F.spark_partition_id().alias("p")).count()
    return [r["count"] for r in cut.collect()]


def with_total(df: DataFrame, name: str = "total_rows") -> DataFrame:
    """``count(*) OVER ()``: the row count on every row, as a scalar subquery."""
    return df.withColumn(name, df.select(F.count(F.lit(1))).scalar())
