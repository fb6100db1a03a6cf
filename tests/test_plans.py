"""Plan shapes the design relies on for scale, checked on the physical plans."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL

import __spark_entry__ as entry
from claimlens.plans import reports, views
from claimlens.plans.registry import ALL, REPORTS
from claimlens.sources import ClaimsModel, derive_model


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, small_model, tmp_path_factory) -> ClaimsModel:
    return small_model.materialize(str(tmp_path_factory.mktemp("model")))


@pytest.mark.parametrize("name", sorted(ALL))
def test_no_cartesian_no_python(spark, name):
    plan = physical(entry.queries()[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, (name, bad)


def test_v3_aggregates_before_outer_join(stored):
    lines = optimized(views.v3_provider_summary(stored)).splitlines()
    join = next(i for i, ln in enumerate(lines) if "Join LeftOuter" in ln)
    aggs = [i for i, ln in enumerate(lines) if "Aggregate [provider_id" in ln]
    assert aggs and all(i > join for i in aggs), "\n".join(lines)


def test_v1_scans_claims_once(stored):
    plan = optimized(views.v1_monthly_kpi(stored))
    assert plan.count("Relation [") == 1, plan
    assert "Join" not in plan


def test_top_k_is_take_ordered(stored):
    for df in (reports.q08_top_providers(stored), reports.q10_top_codes(stored), reports.i08_top_payouts(stored)):
        assert "TakeOrderedAndProject" in physical(df)


def test_top_per_group_limits_before_shuffle(stored):
    plan = physical(reports.i05_top_provider_per_region(stored))
    assert "WindowGroupLimit" in plan, plan


def test_i08_takes_the_top_before_any_exchange(spark, stored):
    for model in (stored, derive_model(spark, SF_SMALL)):
        lines = physical(reports.i08_top_payouts(model)).splitlines()
        at = [i for i, ln in enumerate(lines) if "TakeOrderedAndProject" in ln and "claim_amount_nok" in ln]
        below = lines[at[-1] + 1:]  # the top claims, before any lookup
        scan = next(i for i, ln in enumerate(below) if "FileScan" in ln and ("orders.parquet" in ln or "/claims]" in ln))
        own = [ln for ln in below[:scan] if "Subquery" not in ln]
        start = next((i for i, ln in enumerate(own) if "AdaptiveSparkPlan" in ln), len(own))  # the supplier count's own plan
        assert not any("Exchange" in ln or "Join" in ln for ln in own[:start]), "\n".join(lines)


@pytest.mark.parametrize("report", ["q05_claims_by_region", "q09b_avg_days_by_region", "i02_approval_by_region",
                                    "i04_backlog_by_region", "v2_region_kpi", "i05_top_provider_per_region"])
def test_region_reports_sum_before_the_lookup(spark, report):
    lines = optimized(REPORTS[report](derive_model(spark, SF_SMALL))).splitlines()
    join = next(i for i, ln in enumerate(lines) if "Join LeftOuter" in ln)
    assert "Aggregate [region_key" in lines[join + 1], "\n".join(lines)


def test_share_of_total_has_no_fact_sized_join(stored):
    plan = optimized(reports.q02_status_share(stored))
    assert "Join" not in plan


def test_report_without_region_skips_customer_lookup(spark):
    plan = physical(entry.queries()["q07_claims_by_sex"](spark, SF_SMALL))
    assert "customer.parquet" not in plan and "Join" not in plan
    assert "ReadSchema: struct<o_custkey:bigint>" in plan


def test_bridge_counts_skip_first_code_flag(spark):
    plan = optimized(entry.queries()["q10_top_codes"](spark, SF_SMALL))
    assert "LeftOuter" not in plan


def test_filters_and_columns_reach_the_scan(stored):
    plan = physical(reports.q04_amount_by_decision(stored))
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,Closed), IsNotNull(decision)]" in plan, plan
    assert "ReadSchema: struct<status:string,decision:string,claim_amount_nok:decimal(12,2)>" in plan


def test_bucketed_model_joins_claims_and_bridge_without_shuffle(spark, small_model, tmp_path):
    small_model.save_bucketed("claims_bucketed", str(tmp_path / "tables"), buckets=4)
    bucketed = ClaimsModel.from_tables(spark, "claims_bucketed")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    saved = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        df = reports.i06_top_code_per_region(bucketed)
        plan = df._jdf.queryExecution().sparkPlan().toString()
        lines = plan.splitlines()
        join = next(i for i, ln in enumerate(lines) if "SortMergeJoin [claim_id" in ln)
        below = lines[join + 1:]
        claims_scan = next(i for i, ln in enumerate(below) if "claims_bucketed.claims[" in ln)
        bridge_scan = next(i for i, ln in enumerate(below) if "claims_bucketed.claim_medical_codes[" in ln)
        assert not any("Exchange" in ln for ln in below[: max(claims_scan, bridge_scan)]), plan
        assert "Bucketed: true" in below[claims_scan] and "Bucketed: true" in below[bridge_scan]
        plain = sorted(map(tuple, reports.i06_top_code_per_region(small_model).collect()))
        assert sorted(map(tuple, df.collect())) == plain
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_claim_is_split_by_adaptive_skew_join(spark, small_model):
    """One claim holding a third of all bridge rows: the claims-bridge join is
    planned as a skew join (the hot partition is split over several tasks)."""
    from pyspark.sql import functions as F

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    saved = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        bridge = small_model.claim_medical_codes.select("claim_id", "medical_code_id")
        hot = spark.range(1, bridge.count() // 2 + 1).select(
            F.lit(0).cast("long").alias("claim_id"), F.col("id").alias("medical_code_id"))
        skewed = small_model.replace(claim_medical_codes=bridge.unionByName(hot))
        df = reports.i06_top_code_per_region(skewed)
        rows = df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "SortMergeJoin(skew=true) [claim_id" in final, final
        assert len(rows) >= 1
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.mark.parametrize("report", [reports.i05_top_provider_per_region, reports.i06_top_code_per_region])
def test_ranks_counts_that_met_the_dimension(stored, report):
    """Ranking, below it the lookup (orphans take no rank), below that the counts (no raw row is looked up)."""
    lines = optimized(report(stored)).splitlines()
    window = next(i for i, ln in enumerate(lines) if "Window [" in ln)
    lookup = next(i for i, ln in enumerate(lines) if "Join Inner" in ln)
    counted = next(i for i, ln in enumerate(lines) if "Aggregate [region" in ln)
    assert window < lookup < counted, "\n".join(lines)


@pytest.mark.parametrize("name", ["q02_status_share", "q03_decision_share_closed", "s2_status_pct"])
def test_share_of_total_reads_the_fact_once(spark, name):
    """The total is a scalar subquery over the grouped counts; the main query
    must reuse its shuffle rather than scan and aggregate the claims again."""
    df = entry.queries()[name](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and "FileScan parquet" not in final, final


def _indent(line: str) -> int:
    stripped = line.lstrip(" :|")
    for marker in ("+- ", ":- "):
        if stripped.startswith(marker):
            return len(line) - len(stripped)
    return len(line) - len(stripped)


def _ancestors(lines: list[str], idx: int) -> list[str]:
    """Lines of the operators above ``lines[idx]`` in a printed plan tree."""
    out, level = [], _indent(lines[idx])
    for ln in reversed(lines[:idx]):
        if _indent(ln) < level:
            out.append(ln)
            level = _indent(ln)
    return out


@pytest.mark.parametrize("report", [reports.i05_top_provider_per_region, views.v3_provider_summary])
def test_bucketed_dimension_is_read_in_place(spark, small_model, tmp_path, report):
    small_model.save_bucketed("claims_dims", str(tmp_path / "tables"), buckets=4)
    bucketed = ClaimsModel.from_tables(spark, "claims_dims")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    saved = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        lines = report(bucketed)._jdf.queryExecution().executedPlan().toString().splitlines()
        scan = next(i for i, ln in enumerate(lines) if "claims_dims.providers[" in ln)
        path = []
        for ln in _ancestors(lines, scan):
            path.append(ln)
            if "SortMergeJoin" in ln:
                break
        assert "SortMergeJoin" in path[-1] and not any("Exchange" in ln for ln in path), "\n".join(lines)
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


UNUSED_SOURCE_COLUMNS = [
    "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate", "s_acctbal", "c_name", "c_acctbal", "c_mktsegment", "p_brand", "p_size",
    "p_retailprice",
]


def test_no_scan_reads_columns_the_model_never_uses(spark):
    """Column pruning reaches every Parquet scan of every registered query."""
    for name, fn in entry.queries().items():
        plan = physical(fn(spark, SF_SMALL))
        schemas = [ln[ln.index("ReadSchema:"):] for ln in plan.splitlines() if "ReadSchema:" in ln]
        assert schemas, name
        for schema in schemas:
            leaked = [c for c in UNUSED_SOURCE_COLUMNS if f"{c}:" in schema]
            assert not leaked, (name, leaked)
