"""The report queries: dataset sanity, basic reports, intermediate reports,
and the load-verification checks.

Every function takes a :class:`ClaimsModel` and returns a lazy DataFrame whose
rows are sorted the way the report presents them (ties broken by the group
key so the order is total).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions import (
    AMOUNT_SUM_T,
    count_where,
    days_between,
    month_start,
    pct,
    rounded_avg,
    sum_where,
)
from claimlens.operators import (
    count_by,
    distinct_count,
    number_rows,
    row_numbers,
    outcome_rate,
    row_count,
    row_counts,
    share_of_total,
    summary_stats,
    table_profile,
    top_k,
    top_k_with_lookup,
    top_per_group,
    violation_counts,
    with_total,
)
from claimlens.operators.quality import Rule
from claimlens.schemas import CLOSED
from claimlens.plans.regions import count_by_region, sums_by_region
from claimlens.sources.model import ClaimsModel

c = F.col


def is_closed():
    return c("status") == CLOSED


def processed():
    """Closed claims with a decision date: the ones processing time is measured on."""
    return is_closed() & c("decision_date").isNotNull()


def processing_days():
    return days_between("decision_date", "received_date")


# --- sanity -----------------------------------------------------------------

def q00_dataset_sanity(m: ClaimsModel) -> DataFrame:
    """Table sizes and date ranges in one row (one scan per table)."""
    return m.claims.agg(
        F.count(F.lit(1)).alias("claims_count"),
        F.min("received_date").alias("min_received_date"),
        F.max("received_date").alias("max_received_date"),
        F.min("decision_date").alias("min_decision_date"),
        F.max("decision_date").alias("max_decision_date"),
    ).select(
        "claims_count",
        row_count(m.providers).alias("providers_count"),
        row_count(m.medical_codes).alias("medical_codes_count"),
        row_count(m.claim_medical_codes).alias("claim_medical_codes_count"),
        row_count(m.injury_types).alias("injury_types_count"),
        row_count(m.claim_injuries).alias("claim_injuries_count"),
        "min_received_date",
        "max_received_date",
        "min_decision_date",
        "max_decision_date",
    )


def i00a_row_counts(m: ClaimsModel) -> DataFrame:
    return row_counts(m.tables()).orderBy("table_name")


def t_table_profile(m: ClaimsModel) -> DataFrame:
    """Rows of every table and distinct values of the columns reports group by."""
    return table_profile(m.tables(), {
        "claims": ["status", "care_level", "patient_sex", "provider_id"],
        "claim_medical_codes": ["medical_code_id", "code_role"],
        "providers": ["provider_type"],
    })


def n_claim_numbers(m: ClaimsModel) -> DataFrame:
    """Every claim with its consecutive number by claim id, and the number of claims."""
    return with_total(number_rows(m.claims.select("claim_id"), "claim_id", name="claim_number"), "total_claims")


def n_claims_by_amount(m: ClaimsModel) -> DataFrame:
    """Claims numbered by decision, amount and reference: NULLs last, many ties in the first keys, a string last."""
    rows = m.claims.select("claim_id", "decision", "claim_amount_nok", "claim_reference")
    return number_rows(rows, "decision", F.col("claim_amount_nok").desc(), "claim_reference", name="place").select("claim_id", "place")


def n_row_numbers(m: ClaimsModel) -> DataFrame:
    """Every table's rows numbered in no order: how many numbers there are, and their range."""
    frames = [
        row_numbers(df.select(df.columns[0]), "n").agg(
            F.count(F.lit(1)).alias("row_count"), F.count_distinct("n").alias("numbers"), F.min("n").alias("first"), F.max("n").alias("last")
        ).select(F.lit(t).alias("table_name"), "row_count", "numbers", "first", "last")
        for t, df in m.tables().items()
    ]
    return functools.reduce(DataFrame.unionByName, frames)


def i00b_distinct_counts(m: ClaimsModel) -> DataFrame:
    return m.claims.agg(F.count_distinct("provider_id").alias("distinct_providers")).select(
        "distinct_providers",
        distinct_count(m.claim_medical_codes, "medical_code_id").alias("distinct_codes"),
        distinct_count(m.claim_injuries, "injury_type_id").alias("distinct_injuries"),
    )


# --- basic reports ----------------------------------------------------------

def q01_claims_per_month(m: ClaimsModel) -> DataFrame:
    return count_by(m.claims, [month_start("received_date").alias("month")]).orderBy("month")


def q02_status_share(m: ClaimsModel) -> DataFrame:
    return share_of_total(
        m.claims, ["status"], dp=2, count_name="claims_count", pct_name="pct_of_claims"
    ).orderBy(c("claims_count").desc(), "status")


def q03_decision_share_closed(m: ClaimsModel) -> DataFrame:
    return share_of_total(
        m.claims, ["decision"], where=is_closed(), dp=2, count_name="closed_count", pct_name="pct_of_closed"
    ).orderBy(c("closed_count").desc(), c("decision").asc_nulls_last())


def q04_amount_by_decision(m: ClaimsModel) -> DataFrame:
    return summary_stats(
        m.claims, ["decision"], c("claim_amount_nok"), ["count", "avg", "sum", "max"], dp=2,
        where=is_closed() & c("decision").isNotNull(),
        names={"count": "claim_count", "avg": "avg_amount_nok", "sum": "sum_amount_nok",
               "max": "max_amount_nok"},
    ).orderBy(c("claim_count").desc(), "decision")


def q05_claims_by_region(m: ClaimsModel) -> DataFrame:
    return count_by_region(m).orderBy(c("claims_count").desc(), "region")


def q06_claims_by_care_level(m: ClaimsModel) -> DataFrame:
    return count_by(m.claims, ["care_level"]).orderBy(c("claims_count").desc(), "care_level")


def q07_claims_by_sex(m: ClaimsModel) -> DataFrame:
    return count_by(m.claims, ["patient_sex"]).orderBy(c("claims_count").desc(), "patient_sex")


def q08_top_providers(m: ClaimsModel, k: int = 10) -> DataFrame:
    """Top providers by claim count, grouped by provider *name and region*.

    Claims are counted per provider id first (partial aggregation), the
    per-provider counts are joined to the provider names, and the counts are
    re-summed by (name, region) before the top-k.
    """
    per_provider = count_by(m.claims, ["provider_id"])
    named = per_provider.join(
        m.providers.select("provider_id", "provider_name", c("region").alias("provider_region")),
        "provider_id",
    )
    per_name = named.groupBy("provider_name", "provider_region").agg(
        F.sum("claims_count").alias("claims_count")
    )
    return top_k(per_name, [c("claims_count").desc(), c("provider_name"), c("provider_region")], k)


def q09a_avg_days_overall(m: ClaimsModel) -> DataFrame:
    return summary_stats(m.claims, [], processing_days(), ["avg"], dp=2, where=processed(),
                         names={"avg": "avg_processing_days"}, integral=True)


def q09b_avg_days_by_region(m: ClaimsModel) -> DataFrame:
    sums = sums_by_region(
        m, {"closed_claims": F.count(F.lit(1)), "_n": F.count(processing_days()), "_days": F.sum(processing_days())},
        where=processed())
    return sums.select(
        "region", "closed_claims", rounded_avg(c("_days"), c("_n"), 2).alias("avg_processing_days"),
    ).orderBy(c("avg_processing_days").desc_nulls_first(), c("closed_claims").desc(), "region")


def q10_top_codes(m: ClaimsModel, k: int = 10) -> DataFrame:
    from claimlens.operators import dimension_usage

    return dimension_usage(
        m.claim_medical_codes,
        m.medical_codes,
        "medical_code_id",
        ["code_system", "code", "code_title"],
        [c("usage_count").desc(), c("code_system"), c("code"), c("medical_code_id")],
        k,
    ).select("medical_code_id", "code_system", "code", "code_title", "usage_count")


def q11_top_injuries(m: ClaimsModel, k: int = 10) -> DataFrame:
    """Top injury types; grouped by (group, name), the unique key of the type."""
    per_type = m.claim_injuries.groupBy("injury_type_id").agg(F.count(F.lit(1)).alias("usage_count"))
    named = per_type.join(m.injury_types.select("injury_type_id", "injury_group", "injury_name"),
                          "injury_type_id")
    per_name = named.groupBy("injury_group", "injury_name").agg(F.sum("usage_count").alias("usage_count"))
    return top_k(per_name, [c("usage_count").desc(), c("injury_group"), c("injury_name")], k)


# --- intermediate reports ---------------------------------------------------

def i01_monthly_kpi(m: ClaimsModel) -> DataFrame:
    """Received-month basis; approval counts 'Approved' only."""
    approved = is_closed() & (c("decision") == "Approved")
    return (
        m.claims.groupBy(month_start("received_date").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("claims_received"),
            count_where(is_closed()).alias("closed_count"),
            count_where(approved).alias("approved_closed"),
            sum_where(is_closed(), "claim_amount_nok").alias("payout"),
        )
        .select(
            "month",
            "claims_received",
            "closed_count",
            pct(c("approved_closed"), c("closed_count"), 1).alias("approval_rate_closed_pct"),
            F.round(c("payout"), 2).cast(AMOUNT_SUM_T).alias("total_payout_nok"),
        )
        .orderBy("month")
    )


def i02_approval_by_region(m: ClaimsModel) -> DataFrame:
    counts = sums_by_region(
        m, {"closed_count": F.count(F.lit(1)), "approved_count": count_where(c("decision") == "Approved")},
        where=is_closed())
    return counts.withColumn("approval_rate_pct", pct(c("approved_count"), c("closed_count"), 1)).orderBy(c("approval_rate_pct").desc_nulls_first(), c("closed_count").desc(), "region")


def i03_days_by_care_level(m: ClaimsModel) -> DataFrame:
    return summary_stats(
        m.claims, ["care_level"], processing_days(), ["count", "min", "avg", "max"], dp=1, where=processed(),
        names={"count": "closed_count", "min": "min_days", "avg": "avg_days", "max": "max_days"},
        integral=True,
    ).orderBy(c("avg_days").desc_nulls_first(), "care_level")


def i04_backlog_by_region(m: ClaimsModel) -> DataFrame:
    """Open work per region; regions without backlog stay (with zeros)."""
    status = c("status")
    return sums_by_region(m, {
        "inreview_count": count_where(status == "InReview"),
        "received_count": count_where(status == "Received"),
        "backlog_total": count_where(status.isin("InReview", "Received")),
    }).orderBy(c("backlog_total").desc(), "region")


def i05_top_provider_per_region(m: ClaimsModel) -> DataFrame:
    """Provider with the most closed claims in each claim region (ties: lowest id).

    Closed claims are counted per (region, provider) and the counts meet the
    provider names before the ranking, so a provider id without a provider never
    takes a region's place. A partial WindowGroupLimit keeps one row per region
    and task before the ranking shuffle.
    """
    counts = count_by_region(m, "closed_claims", ["provider_id"], where=is_closed())
    named = counts.join(m.providers.select("provider_id", "provider_name"), "provider_id")
    best = top_per_group(named, ["region"], [c("closed_claims").desc(), c("provider_id")], k=1)
    return best.select("region", "provider_name", "provider_id", "closed_claims").orderBy(
        c("closed_claims").desc(), "region"
    )


def i06_top_code_per_region(m: ClaimsModel) -> DataFrame:
    """Most used medical code per claim region (dense rank 1; ties: lowest id).

    claims ⋈ codes-bridge on claim id (sort-merge; AQE splits a claim with an
    outsized number of codes; no exchange at all on a bucketed model),
    aggregated per (region, code); the counts meet the code dimension before
    the ranking, so an unknown code never takes a region's place. Here the
    region is looked up per claim, before the bridge multiplies the rows.
    """
    uses = (
        m.claims.select("claim_id", "region")
        .join(m.claim_medical_codes.select("claim_id", "medical_code_id"), "claim_id")
        .groupBy("region", "medical_code_id")
        .agg(F.count(F.lit(1)).alias("code_uses"))
    )
    known = uses.join(
        m.medical_codes.select("medical_code_id", "code_system", "code", "code_title"), "medical_code_id"
    )
    best = top_per_group(known, ["region"], [c("code_uses").desc(), c("medical_code_id")], k=1, method="dense_rank")
    return best.select(
        "region", "medical_code_id", "code_system", "code", "code_title", "code_uses"
    ).orderBy(c("code_uses").desc(), "region")


def i07_rejection_by_care_level(m: ClaimsModel) -> DataFrame:
    return outcome_rate(
        m.claims, ["care_level"], is_closed(), c("decision") == "Rejected", dp=1,
        base_name="closed_count", hit_name="rejected_count", rate_name="rejection_rate_pct",
    ).orderBy(c("rejection_rate_pct").desc_nulls_first(), c("closed_count").desc(), "care_level")


def i08_top_payouts(m: ClaimsModel, k: int = 20) -> DataFrame:
    """The k largest claims of known providers (ties: claim id) with the provider's name.

    The largest claims are taken first (no shuffle of the claims); those rows
    alone are looked up in the providers and, where the model derives it, the region.
    """
    claims, regions = m.region_source or (m.claims, None)
    place = "region" if regions is None else "region_key"
    top = top_k_with_lookup(
        claims.select("claim_id", "claim_reference", "received_date", "status", "decision",
                      "claim_amount_nok", place, "provider_id"),
        [c("claim_amount_nok").desc_nulls_last(), c("claim_id")],
        k,
        m.providers.select("provider_id", "provider_name"),
        "provider_id",
    )
    if regions is not None:
        top = top.join(regions, "region_key", "left")
    return top.select(
        "claim_id", "claim_reference", "received_date", "status", "decision",
        "claim_amount_nok", "region", "provider_name",
    ).orderBy(c("claim_amount_nok").desc(), "claim_id")


def i09_rules() -> list[Rule]:
    return [
        Rule("closed_with_decision_null", ~(is_closed() & c("decision").isNull())),
        Rule("decision_before_received",
             ~(c("decision_date").isNotNull() & (c("decision_date") < c("received_date")))),
        Rule("rejected_with_positive_amount",
             ~((c("decision") == "Rejected") & (c("claim_amount_nok") > 0))),
    ]


def i09_dq_summary(m: ClaimsModel) -> DataFrame:
    """Three violation counts (expected 0); NULL over an empty table, like the SQL sums."""
    return violation_counts(m.claims, i09_rules(), null_on_empty=True)


# --- load verification ------------------------------------------------------

def s1_row_counts(m: ClaimsModel) -> DataFrame:
    return i00a_row_counts(m)


def s2_status_pct(m: ClaimsModel) -> DataFrame:
    return share_of_total(m.claims, ["status"], dp=1, count_name="n", pct_name="pct").orderBy(
        c("n").desc(), "status"
    )


def s3_open_with_decision(m: ClaimsModel) -> DataFrame:
    rule = Rule("decisions_when_not_closed", ~((c("status") != CLOSED) & c("decision").isNotNull()))
    return violation_counts(m.claims, [rule], null_on_empty=True)


def s4_received_range(m: ClaimsModel) -> DataFrame:
    return summary_stats(m.claims, [], c("received_date"), ["min", "max"],
                         names={"min": "min_received_date", "max": "max_received_date"})


def s5_amount_stats(m: ClaimsModel) -> DataFrame:
    """Over all claims, zero amounts included."""
    return summary_stats(m.claims, [], c("claim_amount_nok"), ["min", "max", "avg"], dp=2,
                         names={"min": "min_amount", "max": "max_amount", "avg": "avg_amount"})
