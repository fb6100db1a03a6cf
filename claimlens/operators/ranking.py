"""Top-k, top-per-group and dimension-usage rankings.

* ``top_k`` is ``orderBy(...).limit(k)``, planned as TakeOrderedAndProject:
  every task keeps its own k best rows and one final merge picks the global k,
  so no shuffle of the input and no task ever holds more than k rows per
  partition.
* ``top_per_group`` uses ``row_number``/``dense_rank`` with a ``<= k`` filter,
  which Spark plans with a partial WindowGroupLimit before the shuffle: each
  task forwards at most k rows per group, so even a group holding a third of
  all rows is reduced map-side.
* callers must give a *total* order (unique last key) so results are
  deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int = 1,
    method: str = "row_number",
    rank_name: str | None = None,
) -> DataFrame:
    """Rows ranked ``<= k`` within each group of ``keys``.

    ``method`` is ``row_number`` (exactly k rows per group), ``rank`` or
    ``dense_rank`` (ties share a rank and are all kept).
    """
    fn = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[method]
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank_name or "_rank"
    ranked = df.withColumn(name, fn().over(w)).filter(F.col(name) <= k)
    return ranked if rank_name else ranked.drop(name)


def dimension_usage(
    usage: DataFrame,
    dim: DataFrame,
    key: str,
    attrs: Sequence[str],
    order: Sequence[Column],
    k: int,
    count_name: str = "usage_count",
) -> DataFrame:
    """Top-k dimension members by how often ``usage`` references them.

    Counts per key first (partial aggregation, so a hot member is cheap), then
    joins the counts -- at most one row per member -- to the dimension's
    attributes, then takes the top k. The join is between two inputs of
    dimension size: a broadcast when the planner's statistics show a small
    dimension, otherwise a sort-merge join that never moves fact rows.
    """
    counts = usage.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))
    joined = counts.join(dim.select(key, *attrs), key)
    return top_k(joined, order, k)


def top_k_with_lookup(
    fact: DataFrame,
    order: Sequence[Column],
    k: int,
    dim: DataFrame,
    key: str,
) -> DataFrame:
    """The k first fact rows that have a dimension row, with its attributes.

    Equal to joining every fact row first. The k first rows are taken without a
    shuffle of the facts and looked up; if some have no dimension row, more are
    taken until k have one. After two such rounds the facts are joined whole, so
    any number of orphans gives the same rows.
    """
    for take in (k, 8 * k, 64 * k):
        top = top_k(fact, order, take)
        found = top.join(dim, key)
        if found.count() >= k or top.count() < take:
            return top_k(found, order, k)
    return top_k(fact.join(dim, key), order, k)
