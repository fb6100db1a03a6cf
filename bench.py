"""Benchmark: wall time of every registered query.

Environment:
  BENCH_SF_DIR   driver tables (default /root/testdata/sf0.1)
  BENCH_CPUS     local cores (default 8)
  BENCH_RUNS     timed runs per query, the median is reported (default 3)
  BENCH_QUERIES  comma-separated subset of query keys (default: all)

Prints one JSON line. ``value`` is the sum over queries of the median wall
seconds of the end-to-end path (driver tables -> derived claims model ->
report), exactly what ``queries()`` runs: the lazy model plans are built once
per session and every run reads the driver files. Each run executes the whole
query into Spark's ``noop`` sink: every row is computed, nothing is shipped
to Python (which would time the driver's row conversion, not the engine).
``loads`` holds the keys that build a load set (one run each, apart from the value).
``materialized`` holds the load-once path: the seconds to write the derived
model as Parquet and the median seconds of each report over the written tables.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from claimlens.plans.registry import ALL, LOADS, REPORTS, run_any  # noqa: E402
from claimlens.session import build_session, shared_path  # noqa: E402
from claimlens.sources import ClaimsModel, derive_model  # noqa: E402


def timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return time.perf_counter() - t


def execute(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = max(1, int(os.environ.get("BENCH_RUNS", "3")))
    subset = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    names = [k for k in subset or ALL if k not in LOADS]
    loads = [k for k in subset or ALL if k in LOADS]

    eventlog = tempfile.mkdtemp(prefix="claimlens-bench-events-")
    spark = build_session(
        f"local[{cpus}]",
        app_name="claimlens-bench",
        shuffle_partitions=2 * cpus,
        conf={
            "spark.driver.memory": "8g",
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": eventlog,
        },
    )

    # Warm the JVM (class loading, codegen caches) once before timing.
    execute(run_any(spark, sf_dir, "q01_claims_per_month"))

    per_query: dict[str, float] = {}
    for name in names:
        samples = [timed(lambda: execute(run_any(spark, sf_dir, name))) for _ in range(runs)]
        per_query[name] = round(statistics.median(samples), 4)

    # Whole sets loaded, changed and read back: some twenty writes each, timed once, not part of the value.
    per_load = {name: round(timed(lambda: execute(run_any(spark, sf_dir, name))), 4) for name in loads}

    # Load once, query many: write the derived model, then query the files.
    model_path = shared_path(spark, "bench-model", create_local=True)
    load_sec = timed(lambda: derive_model(spark, sf_dir).write(model_path))
    stored = ClaimsModel.read(spark, model_path)
    on_files: dict[str, float] = {}
    for name in names:
        if name not in REPORTS:
            continue  # generator keys do not read a model
        samples = [timed(lambda: execute(REPORTS[name](stored))) for _ in range(runs)]
        on_files[name] = round(statistics.median(samples), 4)

    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(per_query.values()), 3),
        "unit": "sec",
        "queries": per_query,
        "loads": per_load,
        "sf": sf,
        "cpus": cpus,
        "runs": runs,
        "materialized": {
            "load_sec": round(load_sec, 3),
            "value": round(sum(on_files.values()), 3),
            "queries": on_files,
        },
        "spark": spark.version,
        "event_log": eventlog,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
