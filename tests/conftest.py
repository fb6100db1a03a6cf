from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from claimlens import schemas as S  # noqa: E402
from claimlens.session import build_session, shared_dir  # noqa: E402
from claimlens.sources import ClaimsModel, derive_model  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", app_name="claimlens-tests", shuffle_partitions=4,
        conf={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="claimlens-test-warehouse-")},
    )
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="claimlens-test-ckpt-"))
    shared_dir(session)
    yield session


@pytest.fixture(scope="session")
def small_model(spark) -> ClaimsModel:
    return derive_model(spark, SF_SMALL)


# --- hand-written fixtures ----------------------------------------------------

D = dt.date
TS = dt.datetime(2024, 1, 1)


def _dec(x) -> decimal.Decimal:
    return decimal.Decimal(str(x)).quantize(decimal.Decimal("0.01"))


def provider(pid: int, name: str | None = None, ptype: str = "Clinic", region: str = "Oslo", **kw) -> dict:
    row = {"provider_id": pid, "provider_name": name or f"P{pid}", "org_number": None,
           "provider_type": ptype, "region": region, "active": True, "created_at": TS}
    row.update(kw)
    return row


def claim(cid: int, received: dt.date, status: str = "Received", decision: str | None = None,
          decision_date: dt.date | None = None, amount=0, provider_id: int = 1, region: str = "Oslo",
          care_level: str = "Primary", **kw) -> dict:
    row = {"claim_id": cid, "claim_reference": f"CLM-{cid}", "patient_age": 40, "patient_sex": "F",
           "region": region, "received_date": received, "decision_date": decision_date, "status": status,
           "decision": decision, "care_level": care_level, "claim_amount_nok": _dec(amount),
           "provider_id": provider_id, "created_at": TS}
    row.update(kw)
    return row


def make_model(spark, providers=(), claims=(), medical_codes=(), claim_medical_codes=(),
               injury_types=(), claim_injuries=()) -> ClaimsModel:
    given = {
        "providers": providers, "claims": claims, "medical_codes": medical_codes,
        "claim_medical_codes": claim_medical_codes, "injury_types": injury_types,
        "claim_injuries": claim_injuries,
    }
    frames = {}
    for name, rows in given.items():
        schema = S.SCHEMAS[name]
        # Fixtures may hold invalid rows (DQ tests), so the schema is relaxed to nullable.
        relaxed = type(schema)([type(f)(f.name, f.dataType, True) for f in schema.fields])
        data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
        frames[name] = spark.createDataFrame(data, relaxed)
    return ClaimsModel(**frames)
