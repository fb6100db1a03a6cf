"""Scale check: generate a large synthetic model, write it, time every report on it.

Usage: python tools/scale_run.py [n_claims] [cpus]

Prints one JSON line: generation+write seconds, table sizes and the median
(of 2 runs) seconds of each report executed into the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from claimlens.plans.registry import REPORTS  # noqa: E402
from claimlens.session import build_session, shared_path  # noqa: E402
from claimlens.sources import ClaimsModel  # noqa: E402
from claimlens.sources.synth import generate_claims_model  # noqa: E402


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 10_000_000
    cpus = int(sys.argv[2]) if len(sys.argv) > 2 else 8
    spark = build_session(f"local[{cpus}]", app_name="claimlens-scale", shuffle_partitions=4 * cpus,
                          conf={"spark.driver.memory": "12g"})
    path = shared_path(spark, f"scale-{n}", create_local=True)
    t = time.perf_counter()
    generate_claims_model(spark, n=n, num_partitions=4 * cpus).write(path)
    gen_sec = time.perf_counter() - t
    model = ClaimsModel.read(spark, path)
    sizes = {name: df.count() for name, df in model.tables().items()}
    times = {}
    for name, fn in REPORTS.items():
        samples = []
        for _ in range(2):
            t = time.perf_counter()
            fn(model).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t)
        times[name] = round(statistics.median(samples), 3)
    print(json.dumps({"claims": n, "cpus": cpus, "generate_and_write_sec": round(gen_sec, 1), "sizes": sizes,
                      "total_sec": round(sum(times.values()), 1), "queries": times}))
    spark.stop()


if __name__ == "__main__":
    main()
