"""Data-quality rules: one injected violation per rule is counted once and quarantined."""

from __future__ import annotations

import pytest
from conftest import D, claim, make_model, provider
from pyspark.sql import functions as F

from claimlens.operators import foreign_key_counts, quarantine, write_quarantined
from claimlens.plans import checks

GOOD = dict(cid=1, received=D(2024, 1, 2), status="Closed", decision="Approved",
            decision_date=D(2024, 1, 5), amount=10)


def good_claim(cid=1, **kw):
    args = dict(GOOD)
    args["cid"] = cid
    args.update(kw)
    return claim(**args)


BAD_CLAIMS = {
    "allowed_patient_sex": dict(patient_sex="Q"),
    "allowed_region": dict(region="Atlantis"),
    "allowed_status": dict(status="Lost", decision=None),
    "allowed_decision": dict(decision="Maybe"),
    "allowed_care_level": dict(care_level="Moon"),
    "range_patient_age": dict(patient_age=121),
    "decision_after_received": dict(decision_date=D(2024, 1, 1)),
    "closed_iff_decision": dict(decision=None),
    "rejected_zero_amount": dict(decision="Rejected", amount=5),
    "nonneg_amount": dict(amount=-1),
    "not_null_claim_reference": dict(claim_reference=None),
}


@pytest.mark.parametrize("rule", sorted(BAD_CLAIMS))
def test_each_claim_rule_counts_one(spark, rule):
    m = make_model(spark, providers=[provider(1)],
                   claims=[good_claim(1), good_claim(2, **BAD_CLAIMS[rule]), good_claim(3)])
    reports = [checks.c_whitelist(m), checks.c_range(m), checks.c_claim_rules(m), checks.c_not_null(m)]
    found = {}
    for df in reports:
        for r in df.filter(F.col("table_name") == "claims").collect():
            found[r.rule] = r.violations
    assert found[rule] == 1
    assert sum(found.values()) == 1, {k: v for k, v in found.items() if v}
    good, bad = quarantine(m.claims, checks.all_row_rules("claims"))
    bad_rows = bad.collect()
    assert [r.claim_id for r in bad_rows] == [2]
    assert bad_rows[0].failed_rules == [rule]
    assert sorted(r.claim_id for r in good.collect()) == [1, 3]


def test_other_tables_rules(spark):
    m = make_model(
        spark,
        providers=[provider(1, ptype="Vet")],
        injury_types=[{"injury_type_id": 1, "injury_group": "Other", "injury_name": "x", "severity": 9,
                       "active": True, "created_at": None}],
        medical_codes=[{"medical_code_id": 1, "code_system": "XYZ", "code": "c", "code_title": "t",
                        "active": True, "created_at": None}],
        claim_medical_codes=[{"claim_id": 1, "medical_code_id": 1, "code_role": "Tertiary", "created_at": None}],
    )
    wl = {(r.table_name, r.rule): r.violations for r in checks.c_whitelist(m).collect()}
    assert wl[("providers", "allowed_provider_type")] == 1
    assert wl[("medical_codes", "allowed_code_system")] == 1
    assert wl[("claim_medical_codes", "allowed_code_role")] == 1
    rg = {(r.table_name, r.rule): r.violations for r in checks.c_range(m).collect()}
    assert rg[("injury_types", "range_severity")] == 1
    nn = {(r.table_name, r.rule): r.violations for r in checks.c_not_null(m).collect()}
    assert nn[("medical_codes", "not_null_created_at")] == 1


def test_keys_and_foreign_keys(spark):
    m = make_model(
        spark,
        providers=[provider(1, "Same"), provider(2, "Same"), provider(2, "Other")],
        claims=[good_claim(1, provider_id=1), good_claim(1, provider_id=9, claim_reference="CLM-x"),
                good_claim(3, provider_id=2)],
        claim_injuries=[{"claim_id": 3, "injury_type_id": 1, "is_primary": True},
                        {"claim_id": 77, "injury_type_id": 1, "is_primary": True}],
        injury_types=[{"injury_type_id": 1, "injury_group": "Other", "injury_name": "x", "severity": 1,
                       "active": True}],
    )
    pk = {(r.table_name, r.rule): r.violations for r in checks.c_primary_key(m).collect()}
    assert pk[("providers", "primary_key_duplicate")] == 1
    assert pk[("claims", "primary_key_duplicate")] == 1
    assert pk[("claim_injuries", "primary_key_duplicate")] == 0
    uq = {(r.table_name, r.rule): r.violations for r in checks.c_unique(m).collect()}
    assert uq[("providers", "unique_provider_name_region")] == 1
    fk = {r.rule: r.violations for r in checks.c_foreign_key(m).collect()}
    assert fk["fk_provider_id_providers"] == 1
    assert fk["fk_claim_id_claims"] >= 1


def test_cascade_delete(spark):
    m = make_model(
        spark, providers=[provider(1)],
        claims=[good_claim(1), good_claim(2, decision="Rejected", amount=0)],
        claim_injuries=[{"claim_id": 1, "injury_type_id": 1, "is_primary": True},
                        {"claim_id": 2, "injury_type_id": 1, "is_primary": True},
                        {"claim_id": 2, "injury_type_id": 2, "is_primary": False}],
    )
    after = checks.cascade_delete_claims(m, F.col("decision") == "Rejected")
    assert [r.claim_id for r in after.claims.collect()] == [1]
    assert [r.claim_id for r in after.claim_injuries.collect()] == [1]
    counts = {r.table_name: r.row_count for r in checks.c_cascade_delete(m).collect()}
    assert counts == {"claims": 1, "claim_medical_codes": 0, "claim_injuries": 1}


def test_defaults_only_fill_absent_columns(spark):
    df = spark.createDataFrame([(1, 5, None)], "claim_id long, injury_type_id long, created_at timestamp")
    out = checks.apply_defaults(df, "claim_injuries").collect()[0]
    assert out.is_primary is False
    assert out.created_at is None  # explicit NULL is kept, and then flagged by c_not_null


def test_write_quarantined_single_pass(spark, tmp_path):
    m = make_model(spark, providers=[provider(1)],
                   claims=[good_claim(1), good_claim(2, patient_age=-4)])
    path = str(tmp_path / "q")
    write_quarantined(m.claims, checks.all_row_rules("claims"), path)
    back = spark.read.parquet(path)
    assert [r.claim_id for r in back.filter("dq_status = 'quarantine'").collect()] == [2]
    assert back.filter("dq_status = 'pass'").count() == 1


def test_i09_and_s3_on_violations(spark):
    from claimlens.plans import reports

    m = make_model(spark, providers=[provider(1)], claims=[
        good_claim(1, decision=None),
        good_claim(2, decision_date=D(2023, 1, 1)),
        good_claim(3, decision="Rejected", amount=3),
        good_claim(4, status="InReview", decision="Approved"),
    ])
    r = reports.i09_dq_summary(m).collect()[0]
    assert (r.closed_with_decision_null, r.decision_before_received, r.rejected_with_positive_amount) == (1, 1, 1)
    assert reports.s3_open_with_decision(m).collect()[0].decisions_when_not_closed == 1


def test_enforced_write_keeps_rule_breakers_out(spark, tmp_path):
    from claimlens.sources import ClaimsModel

    m = make_model(spark, providers=[provider(1), provider(2, ptype="Vet")],
                   claims=[good_claim(1), good_claim(2, patient_age=130), good_claim(3, decision=None)])
    path = str(tmp_path / "enforced")
    m.write_enforced(path)
    back = ClaimsModel.read_enforced(spark, path)
    assert [r.claim_id for r in back.claims.collect()] == [1]
    assert [r.provider_id for r in back.providers.collect()] == [1]
    rejected = {r.claim_id: r.failed_rules for r in ClaimsModel.read_quarantine(spark, path, "claims").collect()}
    assert rejected == {2: ["range_patient_age"], 3: ["closed_iff_decision"]}
    assert [f.name for f in back.claims.schema] == [f.name for f in m.claims.schema]


def test_foreign_keys_of_one_type_are_not_made_text(spark):
    """Values of one type stay as they are; where types differ, they meet as text."""
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    child = spark.createDataFrame([(1, "2"), (3, "3"), (3, None), (None, "1")], "a long, b string")
    tables = {"p": parent, "c": child}
    same = foreign_key_counts(tables, [("c", "a", "p", "id")])
    assert [tuple(r) for r in same.collect()] == [("c", "fk_a_p", 2)]
    assert "string" not in same._jdf.queryExecution().analyzed().toString().lower().split("aggregate [parent")[1]
    mixed = foreign_key_counts(tables, [("c", "a", "p", "id"), ("c", "b", "p", "id")])
    assert [tuple(r) for r in mixed.collect()] == [("c", "fk_a_p", 2), ("c", "fk_b_p", 1)]
