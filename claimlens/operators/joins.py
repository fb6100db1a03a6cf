"""Join helpers that keep shuffles and broadcasts under control.

No side is broadcast by hint: the planner broadcasts sides whose measured
statistics are under ``autoBroadcastJoinThreshold``, and AQE switches a
sort-merge join to a broadcast join at runtime when a shuffle stage's *measured*
size is below ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def preagg_left_join(
    dim: DataFrame,
    fact: DataFrame,
    key: str,
    aggs: Sequence[Column],
    fills: dict[str, Column] | None = None,
) -> DataFrame:
    """``dim LEFT JOIN fact ... GROUP BY dim`` rewritten as aggregate-then-join.

    The fact table is reduced to one row per key *before* the join, so the
    join moves dimension-sized data only and a hot key costs nothing extra;
    dimension rows without facts survive with ``fills`` (e.g. 0 for counts).
    """
    per_key = fact.groupBy(key).agg(*aggs)
    joined = dim.join(per_key, key, "left")
    for name, fill in (fills or {}).items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), fill))
    return joined
