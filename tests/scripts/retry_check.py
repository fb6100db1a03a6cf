"""Run in its own process: a session whose tasks may be retried (local[4,4]).

A pass-through stage fails the first attempt of one partition, as a lost
executor would; Spark recomputes that partition from lineage. The output
must equal a clean run. Prints OK on success.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from claimlens.plans import views  # noqa: E402
from claimlens.sources import derive_model  # noqa: E402
from claimlens.sources.synth import generate_claims_model  # noqa: E402


def flaky(batches):
    ctx = TaskContext.get()
    if ctx.attemptNumber() == 0 and ctx.partitionId() == 1:
        raise RuntimeError("simulated executor loss")
    yield from batches


def main() -> None:
    spark = (SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    generated = generate_claims_model(spark, n=4000, num_partitions=4).claim_medical_codes
    derived = views.v3_provider_summary(derive_model(spark, sys.argv[1])).repartition(4)
    for df in (generated, derived):
        clean = sorted(map(tuple, df.collect()), key=str)
        retried = sorted(map(tuple, df.mapInPandas(flaky, schema=df.schema).collect()), key=str)
        assert clean == retried, "retried output differs"
    print("OK")
    spark.stop()


if __name__ == "__main__":
    main()
