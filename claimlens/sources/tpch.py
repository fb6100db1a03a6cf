"""Derive the claims star schema from the driver's TPC-H-like tables.

The mapping is pure integer arithmetic and CASE logic, so it is map-only apart
from two joins and two aggregations:

* ``claims`` looks up the customer's nation (orders LEFT JOIN customers keyed
  by customer id; a sort-merge join on two large tables at scale, where AQE
  splits a hot customer) and needs the supplier count (a one-value scalar
  subquery). Because the customer side is grouped by its key, the join is
  provably at most one match per order, and Catalyst removes it entirely from
  every report that does not read the claim region.
* the two bridges are ``DISTINCT`` pairs from ``lineitem`` (partial
  aggregation before the shuffle). The "first code of the claim" flag is a
  per-claim ``min`` computed by aggregation and left-joined back, not by a
  window, so one claim with a huge number of codes never lands in a single
  task; when a report does not select the flag, Catalyst drops the join. A
  claim's injuries are aggregated to one row of bits.

Every function returns a lazy DataFrame: nothing is computed until a report
runs, and only the columns a report needs are read from Parquet.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens import schemas as S
from claimlens.functions import padded, pick
from claimlens.sources.model import ClaimsModel

# Constant audit timestamp of derived rows (no report reads ``created_at``).
CREATED_AT = "2000-01-01 00:00:00"

# ---------------------------------------------------------------------------
# Fixed values of the derivation (they define the derived data set and are
# mirrored by the SQL oracle).
# provider_type by supplier key % 5, i.e. the provider types in sorted order.
SORTED_PROVIDER_TYPES = ["Clinic", "GP", "Hospital", "Other", "Specialist"]
# injury_group by (id - 1) % 5, the injury groups in sorted order.
SORTED_INJURY_GROUPS = ["Diagnostic", "Infection", "Medication", "Other", "Surgical"]
# code_system by part type.
CODE_SYSTEM_BY_PART_TYPE = {
    "ICD10": ["ECONOMY", "PROMO"],
    "NCSP": ["STANDARD", "SMALL"],
    "ICPC2": ["MEDIUM"],
}
N_INJURY_TYPES = 16
#: Lines that a task makes distinct pairs of; fewer than PLAIN_LINES in all are left to the planner.
LINES_PER_TASK = 500_000
PLAIN_LINES = 16 * LINES_PER_TASK
# ---------------------------------------------------------------------------


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table with its fixed schema."""
    return spark.read.schema(S.SOURCE_SCHEMAS[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _created_at() -> Column:
    return F.lit(CREATED_AT).cast(T.TimestampType()).alias("created_at")


def _region(nation_key: str) -> Column:
    return pick(F.col(nation_key) % len(S.REGIONS), S.REGIONS)


def providers(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(
        k.alias("provider_id"),
        F.col("s_name").alias("provider_name"),
        F.concat(F.lit("NO"), padded(F.lit(100000000) + k, 9)).alias("org_number"),
        pick(k % 5, SORTED_PROVIDER_TYPES).alias("provider_type"),
        _region("s_nationkey").alias("region"),
        (k % 12 != 0).alias("active"),
        _created_at(),
    )


def regions_of_customers(customer: DataFrame) -> DataFrame:
    """(region_key, region), one row per customer id."""
    nation_of = customer.groupBy("c_custkey").agg(F.max("c_nationkey").alias("c_nationkey"))
    return nation_of.select(F.col("c_custkey").alias("region_key"), _region("c_nationkey").alias("region"))


def claims(orders: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """The claims with the region of their customer (NULL without one)."""
    keyed = keyed_claims(orders, supplier)
    columns = [F.col(f.name) for f in S.CLAIMS.fields]
    return keyed.join(regions_of_customers(customer), "region_key", "left").select(*columns)


def keyed_claims(orders: DataFrame, supplier: DataFrame) -> DataFrame:
    """The claims with the customer id as ``region_key`` in place of the region; map-only."""
    # Providers are numbered 0..n-1; claims go round the first n-1, so the last
    # provider never has a claim (it exercises the outer join of the provider view).
    # Needs at least two suppliers: with one, ANSI mode raises on the modulo by 0.
    n_providers = supplier.select(F.count(F.lit(1))).scalar()
    key = F.col("o_orderkey")
    cust = F.col("o_custkey")
    closed = F.col("o_orderstatus") == "F"
    received = F.to_date(F.col("o_orderdate"))
    decision_bucket = key % 20
    decision = (
        F.when(decision_bucket < 11, "Approved")
        .when(decision_bucket < 17, "Rejected")
        .otherwise("PartiallyApproved")
    )
    sex_bucket = cust % 100
    priority = F.substring(F.col("o_orderpriority"), 1, 1)
    paid = closed & (decision != "Rejected")
    return orders.select(
        key.alias("claim_id"),
        F.concat(
            F.lit("CLM-"), F.date_format(received, "yyyyMMdd"), F.lit("-"), padded(key, 10)
        ).alias("claim_reference"),
        (cust % 91).cast(T.ShortType()).alias("patient_age"),
        F.when(sex_bucket < 49, "M").when(sex_bucket < 98, "F").when(sex_bucket < 99, "X")
        .otherwise("U").alias("patient_sex"),
        cust.alias("region_key"),
        received.alias("received_date"),
        F.when(closed, F.date_add(received, (F.lit(1) + (key * 37) % 180).cast("int"))).alias("decision_date"),
        F.when(closed, "Closed").when(F.col("o_orderstatus") == "O", "InReview")
        .otherwise("Received").alias("status"),
        F.when(closed, decision).alias("decision"),
        F.when(priority.isin("1", "2"), "Primary").when(priority.isin("3", "4"), "Specialist")
        .otherwise("Hospital").alias("care_level"),
        F.when(paid, F.col("o_totalprice").cast(S.CLAIMS["claim_amount_nok"].dataType))
        .otherwise(F.lit(0).cast(S.CLAIMS["claim_amount_nok"].dataType)).alias("claim_amount_nok"),
        (cust % (n_providers - 1)).alias("provider_id"),
        _created_at(),
    )


def medical_codes(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    ptype = F.col("p_type")
    system = F.lit("Other")
    for name, types in reversed(list(CODE_SYSTEM_BY_PART_TYPE.items())):
        system = F.when(ptype.isin(*types), name).otherwise(system)
    return part.select(
        k.alias("medical_code_id"),
        system.alias("code_system"),
        F.concat(F.lit("C"), padded(k, 8)).alias("code"),
        F.col("p_name").alias("code_title"),
        (k % 20 != 0).alias("active"),
        _created_at(),
    )


def _pairs_of_claims(lines: DataFrame, item: str, n_lines: int) -> DataFrame:
    """(claim_id, item, is_first): the distinct pairs; ``is_first``: the pair holds the smallest ``item`` of its claim.

    The per-claim minimum is an aggregation of the lines (partial, then shuffled by claim). It meets
    the pairs on claim and item, by which they lie already, so the pairs are moved once and a claim
    with an outsized number of pairs is spread over the tasks. Being a left join against a grouped
    (unique) key it is removed by the optimizer when the flag is unused. A pair with a NULL is
    neither first nor not.
    """
    pairs = _distinct_pairs(lines, n_lines)
    known = lines.filter(F.col("claim_id").isNotNull() & F.col(item).isNotNull())
    firsts = known.groupBy("claim_id").agg(F.min(item).alias("_first")).withColumnRenamed("claim_id", "_claim")
    if n_lines > PLAIN_LINES:
        firsts = firsts.hint("shuffle_hash")  # LINES_PER_TASK of them in a task at most
    met = pairs.join(firsts, (F.col("claim_id") == F.col("_claim")) & (F.col(item) == F.col("_first")), "left")
    flag = F.when(F.col("claim_id").isNotNull() & F.col(item).isNotNull(), F.col("_claim").isNotNull())
    return met.select("claim_id", item, flag.alias("is_first"))


def _distinct_pairs(pairs: DataFrame, n_lines: int) -> DataFrame:
    """The distinct rows. Of many lines (``n_lines``, 0 if not known) each task gets about ``LINES_PER_TASK``:
    the planner goes by compressed bytes, of which ids have few, and a line is rarely like another, so
    a task would keep many millions of them."""
    if n_lines > PLAIN_LINES:
        pairs = pairs.repartition(-(-n_lines // LINES_PER_TASK), *pairs.columns)
    return pairs.distinct()


def claim_medical_codes(lineitem: DataFrame, n_lines: int = 0) -> DataFrame:
    lines = lineitem.select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("medical_code_id"))
    return _pairs_of_claims(lines, "medical_code_id", n_lines).select(
        "claim_id",
        "medical_code_id",
        F.when(F.col("is_first"), "Primary").otherwise("Secondary").alias("code_role"),
        _created_at(),
    )


def injury_types(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    group = pick((i - 1) % 5, SORTED_INJURY_GROUPS)
    return spark.range(1, N_INJURY_TYPES + 1, numPartitions=1).select(
        i.alias("injury_type_id"),
        group.alias("injury_group"),
        F.concat(group, F.lit(" issue "), i.cast("string")).alias("injury_name"),
        (F.lit(1) + (i - 1) % 5).cast(T.ShortType()).alias("severity"),
        F.lit(True).alias("active"),
        _created_at(),
    )


def claim_injuries(lineitem: DataFrame, n_lines: int = 0) -> DataFrame:
    """A remainder has few values, so a claim's distinct injuries are the bits of one number: however many
    lines a claim has, it is one row until its pairs are listed. Many lines are dealt as in ``_distinct_pairs``."""
    least, ids = 2 - N_INJURY_TYPES, 2 * N_INJURY_TYPES - 1  # of a negative part key the remainder is negative
    assert ids < 63, "bits of a long"
    one, bit = F.lit(1).cast("long"), F.col("_bit")
    item = F.lit(1) + F.col("l_partkey") % N_INJURY_TYPES
    place = F.coalesce((item - least).cast("int"), F.lit(ids))  # NULL has the highest bit
    lines = lineitem.select(F.col("l_orderkey").alias("claim_id"), F.call_function("shiftleft", one, place).alias("_bits"))
    if n_lines > PLAIN_LINES:
        lines = lines.repartition(-(-n_lines // LINES_PER_TASK), "claim_id")
    of_claim = lines.groupBy("claim_id").agg(F.bit_or("_bits").alias("_bits"))
    own = F.call_function("shiftleft", one, bit)
    pairs = of_claim.withColumn("_bit", F.explode(F.array(*[F.lit(i) for i in range(ids + 1)]))).filter(F.col("_bits").bitwiseAND(own) != 0)
    known = F.col("claim_id").isNotNull() & (bit < ids)
    return pairs.select(
        "claim_id", F.when(bit < ids, (bit + least).cast("long")).alias("injury_type_id"),
        F.when(known, F.col("_bits").bitwiseAND(-F.col("_bits")) == own).alias("is_primary"), _created_at())


class DerivedModel(ClaimsModel):
    """The six tables over the driver tables in ``sf_dir``; each is planned when first asked for,
    so a report plans and lists only the files it reads."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        object.__setattr__(self, "_spark", spark)
        object.__setattr__(self, "_dir", sf_dir)

    def _read(self, name: str) -> DataFrame:
        return read_source(self._spark, self._dir, name)

    @cached_property
    def _n_lines(self) -> int:
        """Lines in the files' footers."""
        return self._read("lineitem").count()

    @cached_property
    def providers(self) -> DataFrame:
        return providers(self._read("supplier"))

    @cached_property
    def claims(self) -> DataFrame:
        return claims(self._read("orders"), self._read("customer"), self._read("supplier"))

    @cached_property
    def medical_codes(self) -> DataFrame:
        return medical_codes(self._read("part"))

    @cached_property
    def claim_medical_codes(self) -> DataFrame:
        return claim_medical_codes(self._read("lineitem"), self._n_lines)

    @cached_property
    def injury_types(self) -> DataFrame:
        return injury_types(self._spark)

    @cached_property
    def claim_injuries(self) -> DataFrame:
        return claim_injuries(self._read("lineitem"), self._n_lines)

    @cached_property
    def region_source(self) -> tuple[DataFrame, DataFrame]:
        return keyed_claims(self._read("orders"), self._read("supplier")), regions_of_customers(self._read("customer"))


def derive_model(spark: SparkSession, sf_dir: str) -> ClaimsModel:
    """The six claims tables, lazily derived from the driver tables in ``sf_dir``."""
    return DerivedModel(spark, sf_dir)
