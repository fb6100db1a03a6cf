"""The claims star schema as six DataFrames, plus load / write helpers."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens import schemas as S


# Bucket key of each table in the bucketed layout: the fact and both bridges
# by claim id (their join), the large dimensions by their own key (the
# lookups of aggregated or ranked rows). The 16 injury types stay unbucketed.
BUCKET_KEYS = {
    "claims": "claim_id",
    "claim_medical_codes": "claim_id",
    "claim_injuries": "claim_id",
    "providers": "provider_id",
    "medical_codes": "medical_code_id",
}


@dataclass(frozen=True)
class ClaimsModel:
    providers: DataFrame
    claims: DataFrame
    medical_codes: DataFrame
    claim_medical_codes: DataFrame
    injury_types: DataFrame
    claim_injuries: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.injury_types.sparkSession

    @property
    def region_source(self) -> tuple[DataFrame, DataFrame] | None:
        """Claims with ``region_key`` in place of the region, and (region_key, region) with
        unique keys, for a model that looks the region up; None where claims store it.

        Reports sum claims per key before the lookup, so no claim is moved for it.
        """
        return None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def replace(self, **tables: DataFrame) -> "ClaimsModel":
        current = self.tables()
        current.update(tables)
        return ClaimsModel(**current)

    def register(self, prefix: str = "") -> "ClaimsModel":
        """Publish each table as a temporary view (``<prefix><table>``)."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)
        return self

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Write the six tables as Parquet under ``path`` (rerunnable: overwrite).

        Claims are range-clustered by (received month, claim id) and sorted by
        region and status inside each file, the layout the source indexes
        served; Parquet min/max statistics then skip row groups for month,
        region or status filters. The claim id in the range key splits a month
        holding a large share of all claims over several files.
        """
        for name, df in self.tables().items():
            out = df
            if name == "claims":
                month = F.trunc("received_date", "month")
                out = df.repartitionByRange(month, F.col("claim_id")).sortWithinPartitions(
                    "received_date", "region", "status"
                )
            out.write.mode(mode).parquet(os.path.join(path, name))

    @staticmethod
    def read(spark: SparkSession, path: str) -> "ClaimsModel":
        """Read a model written by :meth:`write` with the fixed schemas."""
        return ClaimsModel(**{
            name: spark.read.schema(S.SCHEMAS[name]).parquet(os.path.join(path, name))
            for name in S.TABLE_NAMES
        })

    def save_bucketed(self, database: str, path: str, buckets: int, mode: str = "overwrite") -> None:
        """Write the six tables as catalog tables under ``path``, bucketed and
        sorted into ``buckets`` buckets by the keys in ``BUCKET_KEYS``.

        Joins of claims with a bridge on ``claim_id`` (the top code per region,
        foreign-key and cascade checks) then read matching buckets side by side:
        a sort-merge join with no shuffle of either table. Lookups of aggregated
        or ranked rows in the providers or codes read the dimension's buckets in
        place and shuffle only the small side. Pick ``buckets`` so a bucket of the
        largest bridge is ~200-500 MB, and set ``spark.sql.shuffle.partitions`` to
        the same number so aggregates line up with the buckets.
        """
        spark = self.claims.sparkSession
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        for name, df in self.tables().items():
            writer = df.write.mode(mode).format("parquet").option("path", os.path.join(path, name))
            if name in BUCKET_KEYS:
                writer = writer.bucketBy(buckets, BUCKET_KEYS[name]).sortBy(BUCKET_KEYS[name])
            writer.saveAsTable(f"{database}.{name}")

    @staticmethod
    def from_tables(spark: SparkSession, database: str) -> "ClaimsModel":
        """Read a model saved by :meth:`save_bucketed` through the catalog (keeps the bucketing)."""
        return ClaimsModel(**{
            name: spark.table(f"{database}.{name}").select(*[f.name for f in S.SCHEMAS[name].fields])
            for name in S.TABLE_NAMES
        })

    def write_enforced(self, path: str, mode: str = "overwrite") -> None:
        """Write the six tables with their row rules enforced, as the source
        database does at insert: one pass per table splits rows into
        ``dq_status=pass`` and ``dq_status=quarantine`` partitions, the latter
        carrying ``failed_rules``. Key and foreign-key rules are set-level and
        are reported by the ``c_*`` checks instead.
        """
        from claimlens.operators.quality import write_quarantined
        from claimlens.plans.checks import all_row_rules

        for name, df in self.tables().items():
            write_quarantined(df, all_row_rules(name), os.path.join(path, name), mode=mode)

    @staticmethod
    def read_enforced(spark: SparkSession, path: str) -> "ClaimsModel":
        """The rows of a :meth:`write_enforced` model that passed every row rule
        (partition pruning reads only the ``pass`` folders)."""
        return ClaimsModel(**{
            name: _read_enforced_table(spark, path, name)
            .filter(F.col("dq_status") == "pass")
            .select(*[f.name for f in S.SCHEMAS[name].fields])
            for name in S.TABLE_NAMES
        })

    @staticmethod
    def read_quarantine(spark: SparkSession, path: str, table: str) -> DataFrame:
        """Rejected rows of one table with the names of the rules they broke."""
        return _read_enforced_table(spark, path, table).filter(F.col("dq_status") == "quarantine")

    def materialize(self, path: str) -> "ClaimsModel":
        """Write, then re-read: cuts lineage so later reports start from files."""
        self.write(path)
        spark = self.claims.sparkSession
        return ClaimsModel.read(spark, path)


def _read_enforced_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    schema = T.StructType(
        list(S.SCHEMAS[name].fields)
        + [T.StructField("failed_rules", T.ArrayType(T.StringType()), True),
           T.StructField("dq_status", T.StringType(), True)]
    )
    return spark.read.schema(schema).parquet(os.path.join(path, name))


def empty_model(spark: SparkSession) -> ClaimsModel:
    return ClaimsModel(**{
        name: spark.createDataFrame([], S.SCHEMAS[name]) for name in S.TABLE_NAMES
    })
