"""Sums of claims per region without moving claims for the region lookup.

A model that derives the region from the customer sums its claims per customer
first; only those sums meet the customers, and are summed again per region.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.sources.model import ClaimsModel


def sums_by_region(
    m: ClaimsModel, sums: dict[str, Column], keys: Sequence[str] = (), where: Column | None = None
) -> DataFrame:
    """(region, *keys, *sums). ``sums`` are aggregates that add up: counts and sums."""
    aggs = [value.alias(name) for name, value in sums.items()]
    if m.region_source is None:
        claims = m.claims if where is None else m.claims.filter(where)
        return claims.groupBy("region", *keys).agg(*aggs)
    claims, regions = m.region_source
    if where is not None:
        claims = claims.filter(where)
    per_key = claims.groupBy("region_key", *keys).agg(*aggs)
    return per_key.join(regions, "region_key", "left").groupBy("region", *keys).agg(
        *[F.sum(name).alias(name) for name in sums]
    )


def count_by_region(m: ClaimsModel, name: str = "claims_count", keys: Sequence[str] = (),
                    where: Column | None = None) -> DataFrame:
    return sums_by_region(m, {name: F.count(F.lit(1))}, keys, where)
