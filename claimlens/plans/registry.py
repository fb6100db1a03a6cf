"""Name -> report function over a :class:`ClaimsModel`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimlens.plans import checks, loads, presentation, reports, views
from claimlens.sources import synth
from claimlens.sources.faulty import over_faults
from claimlens.sources.model import ClaimsModel
from claimlens.sources.tpch import derive_model

ModelQuery = Callable[[ClaimsModel], DataFrame]

REPORTS: dict[str, ModelQuery] = {
    name: getattr(reports, name)
    for name in [
        "q00_dataset_sanity", "q01_claims_per_month", "q02_status_share", "q03_decision_share_closed",
        "q04_amount_by_decision", "q05_claims_by_region", "q06_claims_by_care_level", "q07_claims_by_sex",
        "q08_top_providers", "q09a_avg_days_overall", "q09b_avg_days_by_region", "q10_top_codes",
        "q11_top_injuries", "i00a_row_counts", "i00b_distinct_counts", "i01_monthly_kpi",
        "i02_approval_by_region", "i03_days_by_care_level", "i04_backlog_by_region",
        "i05_top_provider_per_region", "i06_top_code_per_region", "i07_rejection_by_care_level",
        "i08_top_payouts", "i09_dq_summary", "s1_row_counts", "s2_status_pct", "s3_open_with_decision",
        "s4_received_range", "s5_amount_stats",
    ]
}
REPORTS.update({
    "v1_monthly_kpi": views.v1_monthly_kpi,
    "v2_region_kpi": views.v2_region_kpi,
    "v3_provider_summary": views.v3_provider_summary,
    "v_published_rollup": views.published_rollup,
})
REPORTS.update({
    name: getattr(presentation, name)
    for name in [
        "p1_latest_month_kpis", "p2_monthly_trends", "p3_region_table", "p4_top_providers_by_rate",
        "p5_top_providers_by_payout", "p6_sliced_provider_table", "p7_reaggregate",
    ]
})
# The presentation queries' other modes.
REPORTS.update({
    "p1_latest_received_month": lambda m: presentation.p1_latest_month_kpis(m, require_received=True),
    "p6_slice_of_three_regions": lambda m: presentation.p6_sliced_provider_table(
        m, regions=["Oslo", "Viken", "Vestland"], provider_types=["Clinic", "GP"]),
    "p7_reaggregate_weighted": lambda m: presentation.p7_reaggregate(m, weighted=True),
})
REPORTS.update({
    name: getattr(reports, name) for name in ["t_table_profile", "n_claim_numbers", "n_claims_by_amount", "n_row_numbers"]
})
# Reports that build a set in the shared folder and read it back.
LOADS = ["l_load_replayed", "l_reloaded_rows", "k_arriving_keys", "v_maintained_views", "c_cascade_written"]
REPORTS.update({name: getattr(loads, name) for name in LOADS})
REPORTS.update({
    name: getattr(checks, name)
    for name in [
        "c_not_null", "c_whitelist", "c_range", "c_claim_rules", "c_decision_after_received",
        "c_closed_iff_decision", "c_rejected_zero_amount", "c_nonneg_amount", "c_primary_key", "c_unique",
        "c_foreign_key", "c_cascade_delete", "c_month_spine_reconcile", "c_defaults", "c_quarantine",
    ]
})
# The same checks over a model with known faults, so that every rule has something to find.
REPORTS.update({
    f"{name}_faulty": over_faults(REPORTS[name])
    for name in [
        "c_not_null", "c_whitelist", "c_range", "c_decision_after_received", "c_closed_iff_decision",
        "c_rejected_zero_amount", "c_nonneg_amount", "c_primary_key", "c_unique", "c_foreign_key", "c_quarantine",
        "i09_dq_summary", "s3_open_with_decision",
    ]
})


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run one report over the claims model derived from the driver tables in ``sf_dir``.

    The model is planned anew each time (only the tables the report reads), so
    files that have arrived since count.
    """
    return REPORTS[name](derive_model(spark, sf_dir))


def _without_audit(df: DataFrame) -> DataFrame:
    return df.drop("created_at")


# Generator outputs; claim ids are the driver's order keys (+1), so the volume
# follows the orders table.
GENERATED: dict[str, ModelQuery] = {
    "g4_claims": lambda m: _without_audit(m.claims),
    "g5_claim_medical_codes": lambda m: _without_audit(m.claim_medical_codes),
    "g6_claim_injuries": lambda m: _without_audit(m.claim_injuries),
}


def run_generated(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    model = synth.generated_from_table(spark, synth.orders_ids(spark, sf_dir))
    return GENERATED[name](model)


ALL = list(REPORTS) + list(GENERATED)


def run_any(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in GENERATED:
        return run_generated(spark, sf_dir, name)
    return run(spark, sf_dir, name)
