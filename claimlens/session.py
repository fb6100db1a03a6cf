"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. ANSI mode keeps overflow and division by zero
# loud; AQE coalesces small shuffles, splits skewed join partitions and turns
# joins into broadcasts when a side's *measured* size is small.
BASE_CONF: dict[str, str] = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "claimlens",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the engine's base settings.

    On a cluster leave ``master`` unset and pass ``shuffle_partitions`` sized so
    each shuffle partition holds ~128-256 MB at the target scale; AQE coalesces
    from there.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(BASE_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(
    largest_shuffle_bytes: int,
    total_cores: int,
    target_partition_bytes: int = 200 << 20,
) -> dict[str, str]:
    """Size-dependent settings for a cluster run.

    ``largest_shuffle_bytes`` is the biggest shuffle a job writes (for these
    reports: the claims-bridge join or a key check, roughly the bridge's
    projected size). Shuffle partitions are chosen so each holds about
    ``target_partition_bytes`` and rounded up to whole waves of the cluster's
    cores; AQE then coalesces small ones and splits skewed ones. The same
    number is the bucket count to use with ``ClaimsModel.save_bucketed`` so
    aggregates line up with the buckets.
    """
    partitions = max(total_cores, -(-largest_shuffle_bytes // target_partition_bytes))
    partitions = -(-partitions // total_cores) * total_cores
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession, create_local: bool = False) -> str:
    """The cluster-wide folder for checkpoints and materialised tables.

    Read from ``spark.checkpoint.dir``. Only when it is unset *and*
    ``create_local`` is true (tests, local runs) is a fresh temporary folder
    chosen, one for the application, so a cluster run never silently
    falls back to a machine-local path.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not create_local:
            raise RuntimeError(
                "spark.checkpoint.dir is not set; configure a shared folder for the cluster"
            )
        # Kept here: the setting can't be changed in a running session.
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="claimlens-ckpt-")
        current = _LOCAL_DIRS[app]
    spark.sparkContext.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, *parts: str, create_local: bool = False) -> str:
    return os.path.join(shared_dir(spark, create_local=create_local), *parts)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once under the shared folder and read back: later stages and retries
    read the same files, whatever happens to executors. Files stay until the folder is emptied."""
    spark = df.sparkSession
    local = spark.sparkContext.master.partition("[")[0] == "local"
    path = shared_path(spark, f"{what}-{uuid.uuid4().hex}", create_local=local)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
