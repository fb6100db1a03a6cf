"""BI presentation queries over the three reporting views.

The dashboard does no business logic of its own: KPI cards, trends, tables
and slicers are projections, filters, top-k and re-aggregations of the views.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions import AMOUNT_SUM_T
from claimlens.operators import reaggregate, top_k
from claimlens.plans.views import v1_monthly_kpi, v2_region_kpi, v3_provider_summary
from claimlens.sources.model import ClaimsModel

c = F.col


def p1_latest_month_kpis(m: ClaimsModel, require_received: bool = False) -> DataFrame:
    """KPI cards of the latest month of the monthly view.

    Decision months can run ahead of received months; ``require_received``
    picks the latest month that received claims instead.
    """
    monthly = v1_monthly_kpi(m)
    if require_received:
        monthly = monthly.filter(c("claims_received") > 0)
    return top_k(monthly, [c("month_start_date").desc()], 1)


def p2_monthly_trends(m: ClaimsModel) -> DataFrame:
    """Claims-received and approval-rate trend lines."""
    return v1_monthly_kpi(m).select(
        "month_start_date", "claims_received", "closed_claims", "approval_rate_closed"
    ).orderBy("month_start_date")


def p3_region_table(m: ClaimsModel) -> DataFrame:
    """Region table and volume-vs-rate scatter (bubble size = payout)."""
    return v2_region_kpi(m).select(
        "region", "total_claims", "closed_claims", "approval_rate_closed", "total_payout_nok"
    ).orderBy(c("total_claims").desc(), "region")


def p4_top_providers_by_rate(m: ClaimsModel, k: int = 10) -> DataFrame:
    """Top providers by approval rate; a NULL rate (nothing closed) is not a top rate."""
    return top_k(
        v3_provider_summary(m),
        [c("approval_rate_closed").desc_nulls_last(), c("provider_id")],
        k,
    )


def p5_top_providers_by_payout(m: ClaimsModel, k: int = 10) -> DataFrame:
    return top_k(v3_provider_summary(m), [c("total_payout_nok").desc(), c("provider_id")], k)


def p6_sliced_provider_table(
    m: ClaimsModel,
    regions: Sequence[str] | None = None,
    provider_types: Sequence[str] | None = None,
) -> DataFrame:
    """Provider table filtered by the region and type slicers (None = all)."""
    df = v3_provider_summary(m)
    if regions is not None:
        df = df.filter(c("region").isin(*regions))
    if provider_types is not None:
        df = df.filter(c("provider_type").isin(*provider_types))
    return df.orderBy("provider_id")


def p7_reaggregate(m: ClaimsModel, weighted: bool = False) -> DataFrame:
    """Provider view rolled up to provider region the way the BI tool does it:
    Sum for counts and payout, Average for rates and durations.

    The plain average of rates is not the overall rate; ``weighted=True``
    gives the provider average weighted by closed claims instead.
    """
    v3 = v3_provider_summary(m)
    if weighted:
        v3 = v3.withColumn("_approved", c("approval_rate_closed") * c("closed_claims"))
        return reaggregate(
            v3, ["region"], sums=["total_claims", "closed_claims", "total_payout_nok"],
            avgs=["avg_processing_days_closed"],
            weights={"approval_rate_closed": ("_approved", "closed_claims")},
        ).withColumn("total_payout_nok", c("total_payout_nok").cast(AMOUNT_SUM_T)).orderBy("region")
    return reaggregate(
        v3,
        ["region"],
        sums=["total_claims", "closed_claims", "total_payout_nok"],
        avgs=["approval_rate_closed", "avg_processing_days_closed"],
    ).withColumn("total_payout_nok", c("total_payout_nok").cast(AMOUNT_SUM_T)).orderBy("region")
