"""Lost tasks are recomputed with identical results (deterministic lineage)."""

from __future__ import annotations

import os
import subprocess
import sys

from conftest import SF_SMALL


def test_retried_tasks_reproduce_the_same_rows():
    script = os.path.join(os.path.dirname(os.path.abspath(__file__)), "scripts", "retry_check.py")
    run = subprocess.run([sys.executable, script, SF_SMALL], capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stdout.strip().endswith("OK")
