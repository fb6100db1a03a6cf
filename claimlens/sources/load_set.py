"""The claims model as a set that is loaded, added to, corrected and deleted from, always whole.

Every change writes new folders and then one commit row; readers take the folders that the last
commit lists, so a change that fails half-way is never seen: the set before it stays, in all six
tables. Each change carries a batch id, and a batch whose id is committed is not loaded again.

* ``reload`` replaces all six tables (truncate + reload).
* ``insert`` adds the rows whose keys are new. Keys are looked up through stored filters
  (``operators.key_filter``), so history isn't moved. A row that is there already, with all its values,
  is a repetition; one with the key of another row is set aside, and so is one without a key.
* ``correct`` replaces claims by newer versions, ``delete`` removes claims with their bridge rows (ON DELETE
  CASCADE). Claims and bridges lie in buckets of the claim id: the buckets with changed ids
  are written anew, all others keep their files.

The reporting views are kept as sums that add up (per month pair, region and provider), committed
together with the rows: each change adds the sums of the rows that came and takes off those of the rows
that went; ``views`` finishes them without reading a claim.

One load at a time: two writers at once aren't told apart. Folders of old versions stay until they are
removed by hand.

Layout: ``data/<part>/<table>/bucket=<n>``, ``data/<part>/<table>.keys`` (filters), ``data/<part>/report``,
``manifests/<version>-<part>`` (the folders of a version: one row per part and bucket), ``commits`` (one row a version).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens import schemas as S
from claimlens.operators.key_filter import build_filters, filter_words, known_keys, suspected
from claimlens.plans import maintained
from claimlens.sources.model import ClaimsModel

#: What a table's buckets are made from: facts and bridges lie together.
BUCKET_BY = {
    "providers": "provider_id", "claims": "claim_id", "medical_codes": "medical_code_id",
    "claim_medical_codes": "claim_id", "injury_types": "injury_type_id", "claim_injuries": "claim_id",
}
BRIDGES = ["claim_medical_codes", "claim_injuries"]

def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_TEXT, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()
COMMIT = _schema(version=_LONG, manifest=_TEXT, batch_id=_TEXT, kind=_TEXT)
ENTRY = _schema(table=_TEXT, part=_TEXT, bucket=_INT, rows=_LONG)
REPORT = _schema(table_name=_TEXT, arrived=_LONG, inserted=_LONG, repeated=_LONG, clashed=_LONG, rejected=_LONG)

#: Not compared when a row comes again: set at load.
AUDIT = "created_at"


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


class LoadSet:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        """``buckets`` is fixed for a set: choose it so that a bucket of the largest bridge is some 500 MB."""
        self.spark, self.path, self.buckets = spark, path, buckets

    # --- commits ----------------------------------------------------------------

    def _folder(self, *parts: str) -> str:
        return os.path.join(self.path, *parts)

    def _exists(self, *parts: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(*parts))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def commits(self) -> list[Row]:
        """Committed changes in order, one row each."""
        if not self._exists("commits"):
            return []
        return self.spark.read.schema(COMMIT).parquet(self._folder("commits")).orderBy("version").collect()

    def _state(self, commits: Sequence[Row], version: int | None = None) -> list[Row]:
        """(table, part, bucket, rows) of a version, by default the last."""
        done = [c for c in commits if version is None or c["version"] <= version]
        if not done:
            return []
        return self.spark.read.schema(ENTRY).parquet(self._folder("manifests", done[-1]["manifest"])).collect()

    def _commit(self, commits: Sequence[Row], batch_id: str, kind: str, part: str, state: Sequence[tuple]) -> int:
        version = max((c["version"] for c in commits), default=0) + 1
        manifest = f"{version}-{part}"
        self.spark.createDataFrame([tuple(e) for e in state], ENTRY).coalesce(1).write.parquet(self._folder("manifests", manifest))
        # One row in one file: it is there or it isn't.
        self.spark.createDataFrame([(version, manifest, batch_id, kind)], COMMIT).coalesce(1).write.mode("append").parquet(self._folder("commits"))
        return version

    def _begin(self, batch_id: str) -> tuple[list[Row], int | None]:
        """The commits so far, and the version that holds the batch already."""
        commits = self.commits()
        return commits, next((c["version"] for c in commits if c["batch_id"] == batch_id), None)

    # --- reading ----------------------------------------------------------------

    def _rows(self, state: Sequence, table: str, buckets: set[int] | None = None) -> DataFrame:
        schema = _nullable(maintained.SCHEMAS.get(table) or S.SCHEMAS[table])
        folders = [self._folder("data", e["part"], table, f"bucket={e['bucket']}")
                   for e in state if e["table"] == table and (buckets is None or e["bucket"] in buckets)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> ClaimsModel:
        """The six tables of a version, by default the last; empty tables before the first load."""
        state = self._state(self.commits(), version)
        return ClaimsModel(**{name: self._rows(state, name) for name in S.TABLE_NAMES})

    def views(self, version: int | None = None) -> dict[str, DataFrame]:
        """The reporting views of a version, from their stored sums."""
        state = self._state(self.commits(), version)
        return maintained.finished({name: self._rows(state, name) for name in maintained.SUMS}, self._rows(state, "providers"))

    def report(self) -> DataFrame:
        """(batch_id, table_name, arrived, inserted, repeated, clashed, rejected) of every inserted batch."""
        frames = [
            self.spark.read.schema(REPORT).parquet(self._folder("data", c["manifest"].split("-", 1)[1], "report")).select(
                F.lit(c["batch_id"]).alias("batch_id"), "*")
            for c in self.commits() if c["kind"] == "insert"
        ]
        out = self.spark.createDataFrame([], T.StructType([T.StructField("batch_id", T.StringType()), *REPORT.fields]))
        for f in frames:
            out = out.unionByName(f)
        return out

    def rejected(self, batch_id: str, table: str) -> DataFrame:
        """Rows of a batch that were set aside, with the ``reason``."""
        part = next(c["manifest"].split("-", 1)[1] for c in self.commits() if c["batch_id"] == batch_id)
        schema = T.StructType([*_nullable(S.SCHEMAS[table]).fields, T.StructField("reason", T.StringType())])
        if not self._exists("data", part, f"{table}.rejected"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._folder("data", part, f"{table}.rejected"))

    # --- writing ----------------------------------------------------------------

    def _bucket(self, table: str):
        return F.pmod(F.xxhash64(BUCKET_BY[table]), F.lit(self.buckets)).cast("int")

    def _write(self, part: str, table: str, rows: DataFrame, sizes: dict[int, int] | None = None) -> list[tuple]:
        """Writes a part of a table and the filters of its keys; (table, part, bucket, rows) entries.
        ``sizes``: rows a bucket, where they are known."""
        folder = self._folder("data", part, table)
        # Rebalanced: small buckets share tasks, and a large one is split over several.
        rows.withColumn("bucket", self._bucket(table)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
        schema = T.StructType([*_nullable(S.SCHEMAS[table]).fields, T.StructField("bucket", T.IntegerType())])
        written = self.spark.read.schema(schema).parquet(folder)
        if sizes is None:
            sizes = {r["bucket"]: r["n"] for r in written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a bucket
        if sizes:
            keys = S.PRIMARY_KEYS[table]
            words = filter_words(max(sizes.values()))
            build_filters(written.dropna(subset=keys), keys, "bucket", self.buckets, words).write.parquet(self._folder("data", part, f"{table}.keys"))
        return [(table, part, b, n) for b, n in sizes.items()]

    def _filters(self, state: Sequence, table: str) -> DataFrame | None:
        """The filters of all live parts of a table (a part whose bucket was written anew is out)."""
        live: dict[str, list[int]] = {}
        for e in state:
            if e["table"] == table:
                live.setdefault(e["part"], []).append(e["bucket"])
        frames = [self.spark.read.schema("bucket int, slice int, slices int, words array<long>").parquet(self._folder("data", p, f"{table}.keys")).filter(
            F.col("bucket").isin(b)) for p, b in live.items()]
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f)
        return out

    def _sums(self, state: Sequence, came: DataFrame | None, went: DataFrame | None, part: str, anew: bool = False) -> list[tuple]:
        def write(name: str) -> list[tuple]:
            held = self.spark.createDataFrame([], maintained.SCHEMAS[name]) if anew else self._rows(state, name)
            maintained.changed(name, held, came, went).write.parquet(self._folder("data", part, name, "bucket=0"))
            return [(name, part, 0, -1)]

        return self._together(write, maintained.SUMS)

    @staticmethod
    def _together(write: Callable[[str], list[tuple]], tables: Iterable[str]) -> list[tuple]:
        """The tables' jobs side by side; a failure of one is raised when all have ended."""
        with ThreadPoolExecutor(len(S.TABLE_NAMES)) as pool:
            return [e for entries in pool.map(write, tables) for e in entries]

    def reload(self, batch_id: str, model: ClaimsModel) -> int:
        """Replaces all six tables; the version that holds the batch."""
        commits, version = self._begin(batch_id)
        if version is not None:
            return version
        part, tables = uuid.uuid4().hex, model.tables()

        def write(table: str) -> list[tuple]:
            written = self._write(part, table, tables[table])
            if table == "claims":  # while the bridges are still written
                written += self._sums([], self._rows([_entry(e) for e in written], "claims"), None, part, anew=True)
            return written

        return self._commit(commits, batch_id, "reload", part, self._together(write, tables))

    def insert(self, batch_id: str, tables: dict[str, DataFrame]) -> int:
        """Adds the rows with new keys; the version that holds the batch."""
        commits, version = self._begin(batch_id)
        if version is not None:
            return version
        state, part, told = self._state(commits), uuid.uuid4().hex, []

        def add(table: str) -> list[tuple]:
            new, counts, sizes = self._new_rows(state, part, table, tables[table])
            told.append((table, *counts))
            return self._write(part, table, new, sizes) if sizes else []

        entries = self._together(add, tables)
        self.spark.createDataFrame(told, REPORT).coalesce(1).write.parquet(self._folder("data", part, "report"))
        kept = [tuple(e) for e in state]
        if any(e[0] == "claims" for e in entries):
            kept = [e for e in kept if e[0] not in maintained.SUMS]
            entries += self._sums(state, self._rows([_entry(e) for e in entries], "claims"), None, part)
        return self._commit(commits, batch_id, "insert", part, kept + entries)

    def _new_rows(self, state: Sequence, part: str, table: str, rows: DataFrame) -> tuple[DataFrame, tuple[int, ...], dict[int, int]]:
        """The rows to add; how many arrived, are added, repeat, clash and have no key; and how many are added a bucket."""
        names, keys = [f.name for f in S.SCHEMAS[table].fields], S.PRIMARY_KEYS[table]
        present = F.lit(True)
        for k in keys:
            present = present & F.col(k).isNotNull()
        # Equal rows are one row with a count, before any key meets another.
        value = F.xxhash64(*[n for n in names if n != AUDIT])
        kinds = rows.select(*names).groupBy(*[n for n in names if n != AUDIT]).agg(F.min(AUDIT).alias(AUDIT), F.count(F.lit(1)).alias("__n"))
        folder = self._folder("data", part, f"{table}.arrived")
        kinds.select(*names, "__n", value.alias("__value"), present.alias("__present"), self._bucket(table).alias("__bucket")).write.parquet(folder)
        kinds = self.spark.read.parquet(folder)
        keyed = kinds.filter("__present")
        first = keyed.groupBy(*keys).agg(F.min("__value").alias("__first"))
        filters = self._filters(state, table)
        if filters is not None:
            doubtful = suspected(keyed.select(*keys, "__bucket").distinct(), keys, "__bucket", filters)
            held = known_keys(doubtful, keys, self._rows(state, table).select(*keys, value.alias("__held")))
            first = first.join(held.groupBy(*keys).agg(F.min("__held").alias("__held")), keys, "left")
        else:
            first = first.withColumn("__held", F.lit(None).cast("long"))
        judged = kinds.join(first, keys, "left")  # rows without a key meet none
        folder = self._folder("data", part, f"{table}.judged")
        judged.select(
            *names, "__n", "__present", "__bucket", F.col("__held").isNotNull().alias("__known"),
            F.coalesce(F.col("__value") == F.coalesce("__held", "__first"), F.lit(False)).alias("__chosen")).write.parquet(folder)
        judged = self.spark.read.parquet(folder)
        added = F.col("__chosen") & ~F.col("__known")
        counted = judged.groupBy("__bucket").agg(
            F.sum("__n").alias("arrived"), F.count_if(added).alias("added"),
            *[F.sum(F.when(cond, F.col("__n")).otherwise(0)).alias(name) for name, cond in (
                ("clashed", F.col("__present") & ~F.col("__chosen")), ("nameless", ~F.col("__present")))]).collect()  # a row a bucket
        n = {k: sum(r[k] for r in counted) for k in ("arrived", "added", "clashed", "nameless")}
        if n["clashed"] + n["nameless"]:
            judged.filter(~F.col("__chosen")).select(*names, F.when(F.col("__present"), "clash").otherwise("no key").alias("reason")).write.parquet(
                self._folder("data", part, f"{table}.rejected"))
        repeated = n["arrived"] - n["added"] - n["clashed"] - n["nameless"]
        return judged.filter(added).select(*names), (n["arrived"], n["added"], repeated, n["clashed"], n["nameless"]), {
            r["__bucket"]: r["added"] for r in counted if r["added"]}

    def _touched(self, ids: DataFrame) -> set[int]:
        """Buckets that hold a claim of ``ids`` (one row a bucket)."""
        return {r["b"] for r in ids.select(self._bucket("claims").alias("b")).distinct().collect()}

    def _replace(self, batch_id: str, kind: str, ids: DataFrame, newer: DataFrame | None, tables: Sequence[str]) -> int:
        """Writes anew the buckets that hold ``ids``: without those claims, with their newer versions."""
        commits, version = self._begin(batch_id)
        if version is not None:
            return version
        state, part = self._state(commits), uuid.uuid4().hex
        folder = self._folder("data", part, "changed")
        ids.select("claim_id").dropna().distinct().write.parquet(folder)
        ids = self.spark.read.schema("claim_id long").parquet(folder)
        touched = self._touched(ids)
        went = self._rows(state, "claims", touched).join(ids, "claim_id", "left_semi")
        came = newer.join(went.select("claim_id").distinct(), "claim_id", "left_semi") if newer is not None else None

        def write(table: str) -> list[tuple]:
            rows = self._rows(state, table, touched).join(ids, "claim_id", "left_anti")
            if table == "claims" and came is not None:
                rows = rows.unionByName(came)
            return self._write(part, table, rows.select(*[f.name for f in S.SCHEMAS[table].fields]))

        kept = [tuple(e) for e in state if e["table"] not in maintained.SUMS and not (e["table"] in tables and e["bucket"] in touched)]
        entries = self._together(write, tables) + self._sums(state, came, went, part)
        return self._commit(commits, batch_id, kind, part, kept + entries)

    def correct(self, batch_id: str, claims: DataFrame) -> int:
        """Replaces the claims that the set has by the given versions (one a claim: of several, the one with the
        smallest hash); versions of unknown claims are left out."""
        names = [f.name for f in S.SCHEMAS["claims"].fields]
        one = claims.groupBy("claim_id").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("r")).select("r.*")
        return self._replace(batch_id, "correct", claims, one, ["claims"])

    def delete(self, batch_id: str, ids: DataFrame) -> int:
        """Removes the claims with these ``claim_id`` and their bridge rows."""
        return self._replace(batch_id, "delete", ids, None, ["claims", *BRIDGES])

    def files(self, table: str) -> list[str]:
        """Data files of a table in the last version."""
        return sorted(self._rows(self._state(self.commits()), table).inputFiles())


def _entry(e: tuple) -> Row:
    return Row(table=e[0], part=e[1], bucket=e[2], rows=e[3])
