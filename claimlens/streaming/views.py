"""Keep the reporting views current while claim files keep arriving.

The BI layer reads the month and region views. When new claim files land in
a folder, a Structured Streaming query folds them into the running
aggregates instead of recomputing the views from all claims:

* the file source reads only new files each trigger, with the fixed claims
  schema (no inference);
* the aggregates are the same conditional counts and sums as the batch
  views; Spark keeps one state row per month / region in the state store,
  so state stays small however many claims arrive;
* in complete mode every micro-batch carries the whole (small) aggregate;
  ``foreachBatch`` finishes the view, writes it to the next of a few folders
  and then appends the batch id to the view's list of commits. ``read_view``
  reads the folder of the last commit, so a reader never sees a half-written
  view, and a replayed batch after a failure rewrites its own folder. Offsets
  and state live in the checkpoint folder, which must be on shared storage (by
  default under ``spark.checkpoint.dir``); use one checkpoint per output folder
  (folders follow its batch ids).

The streams are insert-only: a claim counts each time it arrives, so a later
status change or a repeated claim belongs in the batch layer. The provider
view (an outer join after aggregation, which streaming does not support) is
refreshed by the batch job.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimlens import schemas as S
from claimlens.plans.views import monthly_kpi, monthly_pairs, region_kpi
from claimlens.session import shared_path


def read_claims_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(S.CLAIMS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


# What the stream aggregates, and how a batch of it becomes the view.
STREAMED_VIEWS = {
    "vw_monthly_kpi": (monthly_pairs, monthly_kpi),
    "vw_region_kpi": (region_kpi, lambda view: view),
}

#: Folders a view's versions take in turn; readers of the last ones are not disturbed.
SLOTS = 4


def _slot(view_dir: str, batch_id: int) -> str:
    return os.path.join(view_dir, f"slot={batch_id % SLOTS}")


def _publish(view_dir: str, finish):
    """foreachBatch sink: the version first, then its commit."""

    def write(batch: DataFrame, batch_id: int) -> None:
        finish(batch).write.mode("overwrite").parquet(_slot(view_dir, batch_id))
        commit = batch.sparkSession.range(batch_id, batch_id + 1, numPartitions=1).withColumnRenamed("id", "batch_id")
        commit.write.mode("append").parquet(os.path.join(view_dir, "commits"))

    return write


def read_view(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """The newest complete version of a streamed view."""
    view_dir = os.path.join(out_dir, name)
    commits = spark.read.schema("batch_id long").parquet(os.path.join(view_dir, "commits"))
    return spark.read.parquet(_slot(view_dir, commits.agg(F.max("batch_id")).first()[0]))


def start_view_refresh(
    spark: SparkSession,
    source_dir: str,
    out_dir: str,
    checkpoint_dir: str | None = None,
    available_now: bool = False,
    processing_time: str = "1 minute",
) -> list[StreamingQuery]:
    """Start one streaming query per view; each keeps ``out_dir/<view>`` current
    (read it with :func:`read_view`).

    ``available_now=True`` processes every file present now and stops (a
    catch-up run); otherwise the queries trigger every ``processing_time``.
    """
    base = checkpoint_dir or shared_path(spark, "streaming")
    queries = []
    for name, (build, finish) in STREAMED_VIEWS.items():
        view = build(read_claims_stream(spark, source_dir))
        writer = (
            view.writeStream.outputMode("complete")
            .foreachBatch(_publish(os.path.join(out_dir, name), finish))
            .option("checkpointLocation", os.path.join(base, name))
            .queryName(f"refresh_{name}")
        )
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
        queries.append(writer.start())
    return queries
