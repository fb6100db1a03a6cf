"""The driver's entry without the training-data part, or without a library that it needs."""

from __future__ import annotations

import subprocess
import sys

import pytest
from conftest import ROOT

LIBRARIES = ["tiktoken", "zstandard", "xxhash", "public_tokenizers", "pyarrow", "numpy"]


@pytest.mark.parametrize("library", LIBRARIES)
def test_a_missing_library_removes_only_its_queries(library):
    code = f"""
import sys, warnings
sys.path.insert(0, {ROOT!r})
sys.modules[{library!r}] = None
warnings.simplefilter("ignore")
import __spark_entry__ as entry
from claimlens.plans.registry import ALL
names, statements = set(entry.queries()), set(entry.oracle_sql())
assert names == set(ALL) and statements <= names and "v1_monthly_kpi" in statements, sorted(names - set(ALL))
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-1500:]


def test_all_claims_queries_have_a_statement():
    import __spark_entry__ as entry
    from claimlens.plans.registry import ALL

    assert set(ALL) <= set(entry.queries()) and set(ALL) <= set(entry.oracle_sql())
