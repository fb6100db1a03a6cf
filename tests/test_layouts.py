"""Reports give the same rows on every storage layout of the same model."""

from __future__ import annotations

import pytest

from claimlens.plans.registry import REPORTS
from claimlens.sources import ClaimsModel

KEYS = [
    "q00_dataset_sanity", "q04_amount_by_decision", "q08_top_providers", "q10_top_codes", "q11_top_injuries",
    "i01_monthly_kpi", "i05_top_provider_per_region", "i06_top_code_per_region", "i08_top_payouts",
    "v1_monthly_kpi", "v3_provider_summary", "p7_reaggregate", "c_not_null", "c_primary_key", "c_foreign_key",
]


@pytest.fixture(scope="module")
def layouts(spark, small_model, tmp_path_factory):
    base = tmp_path_factory.mktemp("layouts")
    small_model.write_enforced(str(base / "enforced"))
    small_model.save_bucketed("claims_layouts", str(base / "bucketed"), buckets=3)
    return {
        "parquet": small_model.materialize(str(base / "plain")),
        "enforced": ClaimsModel.read_enforced(spark, str(base / "enforced")),
        "bucketed": ClaimsModel.from_tables(spark, "claims_layouts"),
    }


def _rows(df):
    out = []
    for r in df.collect():
        out.append(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("key", KEYS)
def test_same_rows_on_every_layout(small_model, layouts, key):
    want = _rows(REPORTS[key](small_model))
    for name, model in layouts.items():
        assert _rows(REPORTS[key](model)) == want, (key, name)
