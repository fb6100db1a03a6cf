"""The three reporting views the BI layer reads: month, region and provider grain.

Shared KPI conventions:

* approval rate = (Approved + PartiallyApproved) / closed, NULL when nothing closed;
* payout = sum of amounts of Closed claims, 0 when none;
* processing days = average of whole days from receipt to decision over
  Closed claims with both dates, NULL when none.

Rates and averages are unrounded doubles (one division each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import AMOUNT_SUM_T, count_where, days_between, ratio
from claimlens.operators import month_pair_sums, preagg_left_join, sums_by_month
from claimlens.plans.regions import sums_by_region
from claimlens.schemas import APPROVED_LIKE, CLOSED
from claimlens.sources.model import ClaimsModel

c = F.col


def is_closed() -> Column:
    return c("status") == CLOSED


def has_dates() -> Column:
    return c("decision_date").isNotNull() & c("received_date").isNotNull()


def days() -> Column:
    return days_between("decision_date", "received_date")


def zero_amount() -> Column:
    return F.lit(0).cast(AMOUNT_SUM_T)


def _kpis(closed: Column, processed: Column, n_total: Column | None) -> list[Column]:
    """Aggregates shared by the views; ``closed`` selects closed rows,
    ``processed`` the rows that count toward processing time."""
    aggs = []
    if n_total is not None:
        aggs.append(n_total.alias("total_claims"))
    aggs += [
        count_where(closed).alias("closed_claims"),
        count_where(closed & c("decision").isin(*APPROVED_LIKE)).alias("_approved"),
        F.sum(F.when(closed, c("claim_amount_nok"))).cast(AMOUNT_SUM_T).alias("_payout"),
        F.sum(F.when(processed, days())).alias("_days"),
        count_where(processed).alias("_processed"),
    ]
    return aggs


def _finish(df: DataFrame, keys: list[str], with_total: bool = True) -> DataFrame:
    cols = [*keys]
    if with_total:
        cols.append("total_claims")
    cols += [
        "closed_claims",
        ratio(c("_approved"), c("closed_claims")).alias("approval_rate_closed"),
        F.coalesce(c("_payout"), zero_amount()).alias("total_payout_nok"),
        ratio(c("_days"), c("_processed")).alias("avg_processing_days_closed"),
    ]
    return df.select(*cols)


def monthly_pairs(claims: DataFrame) -> DataFrame:
    """The sums of the monthly view per (received month, decision month): the only
    pass over the claims, batch or streaming."""
    closed = is_closed() & has_dates()
    return month_pair_sums(claims, "received_date", "decision_date", {
        "claims_received": F.count(F.lit(1)),
        "closed_claims": count_where(closed),
        "_approved": count_where(closed & c("decision").isin(*APPROVED_LIKE)),
        "_rejected": count_where(closed & (c("decision") == "Rejected")),
        "_payout": F.sum(F.when(closed, c("claim_amount_nok"))),
        "_days": F.sum(F.when(closed, days())),
    })


def monthly_kpi(pairs: DataFrame) -> DataFrame:
    """Month grain from :func:`monthly_pairs`: receipts by received month, closures by decision month.

    The month spine holds every month with a received date or any decision
    date (also of claims that are not Closed).
    """
    counts = ["closed_claims", "_approved", "_rejected"]
    monthly = sums_by_month(pairs, ["claims_received"], [*counts, "_payout", "_days"], "month_start_date")
    for name in ["claims_received", *counts]:
        monthly = monthly.withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    monthly = monthly.withColumn("_payout", c("_payout").cast(AMOUNT_SUM_T))
    return monthly.select(
        "month_start_date",
        "claims_received",
        "closed_claims",
        ratio(c("_approved"), c("closed_claims")).alias("approval_rate_closed"),
        ratio(c("_rejected"), c("closed_claims")).alias("rejected_rate_closed"),
        F.coalesce(c("_payout"), zero_amount()).alias("total_payout_nok"),
        ratio(c("_days"), c("closed_claims")).alias("avg_processing_days_closed"),
    )


def region_kpi(claims: DataFrame) -> DataFrame:
    """Claim-region grain, one grouped aggregation with filtered aggregates
    (batch or streaming claims)."""
    per_region = claims.groupBy("region").agg(
        *_kpis(is_closed(), is_closed() & has_dates(), F.count(F.lit(1)))
    )
    return _finish(per_region, ["region"])


def v1_monthly_kpi(m: ClaimsModel) -> DataFrame:
    return monthly_kpi(monthly_pairs(m.claims)).orderBy("month_start_date")


def v2_region_kpi(m: ClaimsModel) -> DataFrame:
    """Region grain; claims are summed before a derived region is looked up."""
    processed = is_closed() & has_dates()
    sums = sums_by_region(m, {
        "total_claims": F.count(F.lit(1)),
        "closed_claims": count_where(is_closed()),
        "_approved": count_where(is_closed() & c("decision").isin(*APPROVED_LIKE)),
        "_payout": F.sum(F.when(is_closed(), c("claim_amount_nok"))),
        "_days": F.sum(F.when(processed, days())),
        "_processed": count_where(processed),
    })
    return _finish(sums.withColumn("_payout", c("_payout").cast(AMOUNT_SUM_T)), ["region"])


def v3_provider_summary(m: ClaimsModel) -> DataFrame:
    """Provider grain; providers without claims keep a row (0 claims, NULL rates).

    Claims are aggregated per provider id *before* the outer join, so the join
    moves one row per provider instead of every claim.
    """
    has_claim = c("claim_id").isNotNull()
    closed = has_claim & is_closed()
    joined = preagg_left_join(
        m.providers.select("provider_id", "provider_name", "provider_type", "region"),
        m.claims.select("claim_id", "provider_id", "status", "decision", "claim_amount_nok",
                        "received_date", "decision_date"),
        "provider_id",
        _kpis(closed, closed & has_dates(), F.count("claim_id")),
        fills={"total_claims": F.lit(0).cast("bigint"), "closed_claims": F.lit(0).cast("bigint"),
               "_approved": F.lit(0).cast("bigint"), "_processed": F.lit(0).cast("bigint")},
    )
    return _finish(joined, ["provider_id", "provider_name", "provider_type", "region"])


VIEWS = {
    "vw_monthly_kpi": v1_monthly_kpi,
    "vw_region_kpi": v2_region_kpi,
    "vw_provider_summary": v3_provider_summary,
}


def published_rollup(m: ClaimsModel) -> DataFrame:
    """The three views published by name and read back in SQL: their claims and payout."""
    published = publish_views(m.spark, m)
    return m.spark.sql(" UNION ALL ".join(
        f"SELECT '{name}' AS view_name, CAST(SUM({claims}) AS BIGINT) AS claims, "
        f"CAST(SUM(total_payout_nok) AS DECIMAL(22,2)) AS payout FROM {name}"
        for name, claims in zip(published, ("claims_received", "total_claims", "total_claims"))
    ))


def publish_views(spark: SparkSession, m: ClaimsModel, path: str | None = None) -> dict[str, DataFrame]:
    """Register the three views as temporary views; with ``path``, also write
    each one as Parquet (the extract a BI tool imports)."""
    out = {}
    for name, fn in VIEWS.items():
        df = fn(m)
        df.createOrReplaceTempView(name)
        if path is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            df = spark.read.parquet(f"{path}/{name}")
        out[name] = df
    return out
