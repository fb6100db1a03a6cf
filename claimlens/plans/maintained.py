"""The reporting views as stored sums that add up, kept current by signed changes.

Counts and sums per group are all a view needs: adding the sums of rows that came and taking off
those of rows that went gives the sums of the rows there are. A corrected claim goes with its old
values and comes with its new ones. A group whose last row went is dropped, as in a full
computation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions import AMOUNT_SUM_T
from claimlens.plans import views

#: Stored sums: group columns, and the count of rows in a group.
SUMS: dict[str, tuple[list[str], str]] = {
    "sums_month": (["_opened", "_closed"], "claims_received"),
    "sums_region": (["region"], "total_claims"),
    "sums_provider": (["provider_id"], "total_claims"),
}
_COUNT, _AMOUNT = T.LongType(), T.DecimalType(22, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_KPIS = {"total_claims": _COUNT, "closed_claims": _COUNT, "_approved": _COUNT, "_payout": _AMOUNT, "_days": _COUNT, "_processed": _COUNT}
SCHEMAS: dict[str, T.StructType] = {
    "sums_month": _schema(_opened=T.DateType(), _closed=T.DateType(), claims_received=_COUNT, closed_claims=_COUNT, _approved=_COUNT,
                          _rejected=_COUNT, _payout=_AMOUNT, _days=_COUNT),
    "sums_region": _schema(region=T.StringType(), **_KPIS),
    "sums_provider": _schema(provider_id=_COUNT, **_KPIS),
}


def _measures(name: str) -> list[T.StructField]:
    return [f for f in SCHEMAS[name].fields if f.name not in SUMS[name][0]]


def sums(name: str, claims: DataFrame) -> DataFrame:
    """The sums of a view over some claims."""
    if name == "sums_month":
        grouped = views.monthly_pairs(claims)
    else:
        grouped = claims.groupBy(*SUMS[name][0]).agg(
            *views._kpis(views.is_closed(), views.is_closed() & views.has_dates(), F.count(F.lit(1))))
    return grouped.select(*SUMS[name][0], *[F.coalesce(F.col(f.name), F.lit(0)).cast(f.dataType).alias(f.name) for f in _measures(name)])


def changed(name: str, held: DataFrame, came: DataFrame | None, went: DataFrame | None) -> DataFrame:
    """The sums after some claims came and some went."""
    keys, rows = SUMS[name]
    whole = held
    if came is not None:
        whole = whole.unionByName(sums(name, came))
    if went is not None:
        off = sums(name, went)
        whole = whole.unionByName(off.select(*keys, *[(-F.col(f.name)).cast(f.dataType).alias(f.name) for f in _measures(name)]))
    summed = whole.groupBy(*keys).agg(*[F.sum(f.name).cast(f.dataType).alias(f.name) for f in _measures(name)])
    return summed.filter(F.col(rows) != 0)


def finished(stored: dict[str, DataFrame], providers: DataFrame) -> dict[str, DataFrame]:
    """The three views from their sums; the provider view keeps providers without claims."""
    def zero(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0).cast(AMOUNT_SUM_T if column == "_payout" else "long")).alias(column)

    own = stored["sums_provider"]
    named = providers.select("provider_id", "provider_name", "provider_type", "region").join(own, "provider_id", "left")
    measures = [f.name for f in _measures("sums_provider")]
    provider = named.select("provider_id", "provider_name", "provider_type", "region", *[zero(m) for m in measures])
    return {
        "vw_monthly_kpi": views.monthly_kpi(stored["sums_month"]),
        "vw_region_kpi": views._finish(stored["sums_region"], ["region"]),
        "vw_provider_summary": views._finish(provider, ["provider_id", "provider_name", "provider_type", "region"]),
    }
