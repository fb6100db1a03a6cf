"""Table profiles: row counts and distinct counts over several tables.

Each table is scanned once by its own aggregate; results meet as scalar
subqueries (Catalyst merges subqueries over the same table into one
aggregate) or as a ``unionByName`` of one-row frames. Distinct counts are
exact (``count(DISTINCT)`` is planned as a shuffle of the distinct keys, not a
collection into one task); ``approx=True`` switches to HyperLogLog++.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> Column:
    """Scalar-subquery column holding ``COUNT(*)`` of ``df``."""
    return df.select(F.count(F.lit(1))).scalar()


def distinct_count(df: DataFrame, column: str, approx: bool = False, rsd: float = 0.01) -> Column:
    agg = F.approx_count_distinct(column, rsd) if approx else F.count_distinct(F.col(column))
    return df.select(agg).scalar()


def row_counts(tables: Mapping[str, DataFrame], name_col: str = "table_name",
               count_col: str = "row_count") -> DataFrame:
    """One (table_name, row_count) row per table."""
    frames = [
        df.agg(F.count(F.lit(1)).alias(count_col)).select(F.lit(name).alias(name_col), count_col)
        for name, df in tables.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def table_profile(
    tables: Mapping[str, DataFrame],
    distinct: Mapping[str, list[str]] | None = None,
    approx: bool = False,
) -> DataFrame:
    """(table_name, row_count, column_name, distinct_count) profile of several tables.

    One aggregate pass per table computes its row count and the distinct
    counts of the columns listed for it in ``distinct`` (exact by default);
    tables without listed columns give one row with a NULL column name.
    """
    frames = []
    for name, df in tables.items():
        cols = list((distinct or {}).get(name, []))
        aggs = [F.count(F.lit(1)).alias("row_count")]
        aggs += [
            (F.approx_count_distinct(c) if approx else F.count_distinct(F.col(c))).alias(f"_d{i}")
            for i, c in enumerate(cols)
        ]
        wide = df.agg(*aggs)
        if cols:
            pairs = F.explode(F.array(*[
                F.struct(F.lit(c).alias("column_name"), F.col(f"_d{i}").alias("distinct_count"))
                for i, c in enumerate(cols)
            ])).alias("p")
            out = wide.select(F.lit(name).alias("table_name"), "row_count", pairs).select(
                "table_name", "row_count", "p.column_name", "p.distinct_count")
        else:
            out = wide.select(
                F.lit(name).alias("table_name"), "row_count",
                F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("bigint").alias("distinct_count"))
        frames.append(out)
    result = frames[0]
    for f in frames[1:]:
        result = result.unionByName(f)
    return result
