"""Synthetic generator: golden sizes, deterministic and partition-independent output."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimlens.plans import checks
from claimlens.sources.synth import DEFAULT_AS_OF, generate_claims_model


@pytest.fixture(scope="module")
def gen(spark):
    return generate_claims_model(spark, n=1200)


def test_golden_sizes(gen):
    sizes = {name: df.count() for name, df in gen.tables().items()}
    assert sizes == {"providers": 39, "claims": 1200, "medical_codes": 84, "claim_medical_codes": 2400,
                     "injury_types": 16, "claim_injuries": 1800}


def test_round_robin_providers(gen):
    per = {r.provider_id: r["count"] for r in gen.claims.groupBy("provider_id").count().collect()}
    assert all(per[p] == 31 for p in range(1, 31)) and all(per[p] == 30 for p in range(31, 40))


def test_dimension_rules(gen):
    assert {r.provider_type for r in gen.providers.select("provider_type").distinct().collect()} == \
        {"Clinic", "GP", "Hospital"}
    sev = {(r.injury_group, r.severity) for r in gen.injury_types.select("injury_group", "severity").collect()}
    assert sev == {("Diagnostic", 1), ("Infection", 2), ("Medication", 3), ("Other", 4), ("Surgical", 5)}
    codes = {r.code for r in gen.medical_codes.filter("code_system = 'ICD10'").collect()}
    assert "I01.7" in codes and "I21.7" in codes


def test_bridges_pick_distinct_active_members(gen):
    inactive = gen.medical_codes.filter(~F.col("active")).select("medical_code_id")
    assert gen.claim_medical_codes.join(inactive, "medical_code_id").count() == 0
    per_claim = gen.claim_medical_codes.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("medical_code_id").alias("d"),
        F.count_if(F.col("code_role") == "Primary").alias("p"))
    bad = per_claim.filter((F.col("n") != F.col("claim_id") % 3 + 1) | (F.col("d") != F.col("n")) | (F.col("p") != 1))
    assert bad.count() == 0


def test_partition_independent(spark):
    a = generate_claims_model(spark, n=3000, num_partitions=1)
    b = generate_claims_model(spark, n=3000, num_partitions=7)
    for name in ("claims", "claim_medical_codes", "claim_injuries"):
        x, y = a.tables()[name], b.tables()[name]
        assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0, name


def test_generated_data_passes_quality_rules(gen):
    for report in (checks.c_whitelist, checks.c_range, checks.c_claim_rules, checks.c_not_null,
                   checks.c_primary_key, checks.c_unique, checks.c_foreign_key):
        bad = [r for r in report(gen).collect() if r.violations]
        assert not bad, (report.__name__, bad)


def test_dates_and_shares(spark):
    m = generate_claims_model(spark, n=20000)
    r = m.claims.agg(F.min("received_date"), F.max("received_date"),
                     F.avg((F.col("status") == "Closed").cast("double")).alias("closed")).collect()[0]
    assert r[0] >= DEFAULT_AS_OF - dt.timedelta(days=1095) and r[1] <= DEFAULT_AS_OF
    assert abs(r.closed - 0.70) < 0.02
    cumulative = generate_claims_model(spark, n=20000, draws="cumulative")
    share = cumulative.claims.agg(F.avg((F.col("region") == "Oslo").cast("double"))).collect()[0][0]
    chained = m.claims.agg(F.avg((F.col("region") == "Viken").cast("double"))).collect()[0][0]
    assert abs(share - 0.18) < 0.02 and abs(chained - 0.3116) < 0.02


def test_samples_from_a_dimension_of_any_size(spark):
    from claimlens.sources.synth import sample_per_claim

    claims = spark.range(1, 2001).withColumnRenamed("id", "claim_id")
    dim = spark.range(0, 300_000).select((F.col("id") * 7 + 3).alias("medical_code_id"), (F.col("id") % 3 != 0).alias("active"))
    rows = sample_per_claim(claims, dim, "medical_code_id", F.lit(3), 3, 7, "x").collect()
    assert len(rows) == 6000 and all((r.medical_code_id - 3) // 7 % 3 for r in rows)
    assert len({(r.claim_id, r.medical_code_id) for r in rows}) == 6000 and len({r.medical_code_id for r in rows}) > 5800
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, sample_per_claim(
        claims.repartition(3), dim.repartition(5), "medical_code_id", F.lit(3), 3, 7, "x").collect()))
