"""Broken lookups, long identifiers, new files and known faults."""

from __future__ import annotations

import os
import shutil
import tempfile

import pytest
from conftest import D, SF_ORACLE, SF_SMALL, claim, make_model, provider
from pyspark.sql import functions as F

import __spark_entry__ as entry
from claimlens.functions import padded, pick
from claimlens.operators import number_rows, with_total
from claimlens.plans import checks, reports, views
from claimlens.plans.registry import REPORTS
from claimlens.sources import derive_model
from claimlens.sources.faulty import faulty_model
from claimlens.sources.tpch import keyed_claims, medical_codes, providers


def counts(df, rule):
    return {r.table_name: r.violations for r in df.filter(F.col("rule") == rule).collect()}


@pytest.fixture
def broken_dir(spark, tmp_path):
    """sf0.001 without a tenth of its customers and with one nation key lost."""
    for name in ("orders", "lineitem", "part"):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{SF_SMALL}/customer.parquet").filter("c_custkey % 10 <> 3").write.parquet(str(tmp_path / "customer.parquet"))
    spark.read.parquet(f"{SF_SMALL}/supplier.parquet").withColumn(
        "s_nationkey", F.when(F.col("s_suppkey") != 2, F.col("s_nationkey"))).write.parquet(str(tmp_path / "supplier.parquet"))
    return str(tmp_path)


def test_pick_of_null_is_null(spark):
    df = spark.range(3).select(F.when(F.col("id") > 0, F.col("id")).alias("i"))
    picked = df.select(pick(F.col("i"), ["a", "b", "c"]).alias("x"))
    assert picked.schema["x"].nullable
    assert sorted(map(str, (r.x for r in picked.collect()))) == ["None", "b", "c"]


def test_lost_customer_gives_a_null_region(spark, broken_dir):
    model = derive_model(spark, broken_dir)
    lost = spark.read.parquet(f"{SF_SMALL}/orders.parquet").filter("o_custkey % 10 = 3").count()
    assert lost and counts(checks.c_not_null(model), "not_null_region") == {"claims": lost, "providers": 1}
    assert {r.region: r.claims_count for r in reports.q05_claims_by_region(model).collect()}[None] == lost
    assert {r.region: r.total_claims for r in views.v2_region_kpi(model).collect()}[None] == lost
    stored = model.claims.filter("region IS NULL").count()
    assert stored == lost and model.providers.filter("region IS NULL").count() == 1


def test_written_model_agrees_on_lost_customers(spark, broken_dir, tmp_path):
    model = derive_model(spark, broken_dir)
    stored = model.materialize(str(tmp_path / "stored"))
    for key in ("q05_claims_by_region", "q09b_avg_days_by_region", "i02_approval_by_region", "i04_backlog_by_region",
                "i05_top_provider_per_region", "i08_top_payouts", "c_not_null", "c_whitelist", "v2_region_kpi"):
        a, b = (sorted(map(str, REPORTS[key](m).collect())) for m in (model, stored))
        assert a == b, key


def test_long_keys_stay_distinct(spark):
    keys = [12345678, 123456789, 1234567890, 12345678901, 123456789012, 5]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    text = [r.t for r in rows.select(padded(F.col("k"), 8).alias("t")).collect()]
    assert text == ["12345678", "123456789", "1234567890", "12345678901", "123456789012", "00000005"]
    suppliers = spark.createDataFrame([(900_000_001, "a", 1), (900_000_002, "b", 1), (7, "c", 1)], "s_suppkey long, s_name string, s_nationkey int")
    assert len({r.org_number for r in providers(suppliers).collect()}) == 3
    parts = spark.createDataFrame([(k, "n", "PROMO") for k in keys], "p_partkey long, p_name string, p_type string")
    assert len({r.code for r in medical_codes(parts).collect()}) == len(keys)
    orders = spark.createDataFrame([(k, 1, "F", 1.0, D(2024, 1, 1), "1-URGENT") for k in keys],
                                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string")
    claims = keyed_claims(orders, suppliers)
    assert claims.select("claim_reference").distinct().count() == len(keys)


def orphaned(spark):
    """Oslo and Viken; Oslo's most used provider and code don't exist, nor do the largest payouts' providers."""
    claims = [claim(i, D(2024, 1, 1), "Closed", "Approved", D(2024, 1, 9), amount=1000 - i, provider_id=99 if i < 9 else 1 + i % 2,
                    region="Oslo" if i % 2 else "Viken") for i in range(40)]
    links = [{"claim_id": i, "medical_code_id": 77 if i < 30 else 5, "code_role": "Primary", "created_at": None} for i in range(40)]
    code = {"medical_code_id": 5, "code_system": "ICD10", "code": "A", "code_title": "t", "active": True, "created_at": None}
    return make_model(spark, [provider(1), provider(2)], claims, [code], links)


def test_orphans_take_no_rank(spark):
    m = orphaned(spark)
    assert {r.region: r.provider_id for r in reports.i05_top_provider_per_region(m).collect()} == {"Oslo": 2, "Viken": 1}
    assert {r.region: r.medical_code_id for r in reports.i06_top_code_per_region(m).collect()} == {"Oslo": 5, "Viken": 5}
    top = reports.i08_top_payouts(m).collect()
    assert [r.claim_id for r in top] == list(range(9, 29))


def test_top_payouts_when_nearly_all_are_orphans(spark):
    claims = [claim(i, D(2024, 1, 1), amount=5000 - i, provider_id=1 if i % 500 == 499 else 99) for i in range(2000)]
    m = make_model(spark, [provider(1)], claims)
    assert [r.claim_id for r in reports.i08_top_payouts(m, k=3).collect()] == [499, 999, 1499]


def test_new_files_count_at_once(spark, tmp_path):
    for name in ("customer", "supplier"):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    os.mkdir(tmp_path / "orders.parquet")
    shutil.copy(f"{SF_SMALL}/orders.parquet", tmp_path / "orders.parquet" / "a.parquet")
    query = entry.queries()["q06_claims_by_care_level"]
    before = sum(r.claims_count for r in query(spark, str(tmp_path)).collect())
    shutil.copy(f"{SF_SMALL}/orders.parquet", tmp_path / "orders.parquet" / "b.parquet")
    assert sum(r.claims_count for r in query(spark, str(tmp_path)).collect()) == 2 * before


def test_every_rule_finds_its_faults(spark):
    model = derive_model(spark, SF_ORACLE)
    faulty = faulty_model(model)
    for check in (checks.c_not_null, checks.c_whitelist, checks.c_range, checks.c_claim_rules, checks.c_primary_key,
                  checks.c_unique, checks.c_foreign_key):
        found = check(faulty).collect()
        assert all(r.violations > 0 for r in found), [r for r in found if not r.violations]
    assert all(x > 0 for x in reports.i09_dq_summary(faulty).first()) and reports.s3_open_with_decision(faulty).first()[0] > 0


def test_foreign_key_check_moves_distinct_values(spark):
    """All relations meet in one exchange of values counted beforehand, without a join."""
    model = derive_model(spark, SF_SMALL).materialize(tempfile.mkdtemp(prefix="claimlens-fk-"))
    plan = checks.c_foreign_key(model)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in plan
    met = [ln for ln in plan.splitlines() if "Exchange hashpartitioning(parent" in ln]
    assert len(met) == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "partial_count_if" in plan or "partial_count(if" in plan


@pytest.mark.parametrize("buckets", [None, 1, 7, 500])
def test_numbers_are_consecutive(spark, buckets):
    keys = [5, -3, 9_000_000_000, 17, 18, 19, 4, -9_000_000_000_000]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    got = {r.k: (r.row_number, r.total_rows) for r in with_total(number_rows(df, "k", buckets=buckets)).collect()}
    assert got == {k: (i + 1, len(keys)) for i, k in enumerate(sorted(keys))}
    assert number_rows(df.limit(0), "k", buckets=buckets).count() == 0
