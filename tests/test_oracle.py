"""Every registered query equals its DuckDB statement (names, types, rows, values)."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL
from harness import compare, duck

import __spark_entry__ as entry
from claimlens.plans.registry import ALL

QUERIES = {name: entry.queries()[name] for name in ALL}
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    result = compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name])
    assert result["columns_match"], result
    assert not result["type_diff"], result["type_diff"]
    assert result["spark_rows"] == result["oracle_rows"], result
    assert result["values_match"], result["first_mismatches"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == [
        "month_start_date", "claims_received", "closed_claims", "approval_rate_closed",
        "rejected_rate_closed", "total_payout_nok", "avg_processing_days_closed",
    ]
