"""Explicit schemas and value domains of the claims star schema.

Every table is read with one of these ``StructType``s; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the domain lists of the claims schema
# (CHECK constraints) for the reports, data-quality rules and generator to
# agree with it. Lists are in the order the schema declares them.
# ---------------------------------------------------------------------------
PROVIDER_TYPES = ["Hospital", "Clinic", "GP", "Specialist", "Other"]
REGIONS = [
    "Oslo", "Viken", "Vestland", "Rogaland", "Trondelag", "Nordland",
    "Innlandet", "Agder", "MoreOgRomsdal", "Telemark", "Troms", "Finnmark", "Other",
]
PATIENT_SEXES = ["M", "F", "X", "U"]
STATUSES = ["Received", "InReview", "Closed"]
DECISIONS = ["Approved", "Rejected", "PartiallyApproved"]
CARE_LEVELS = ["Primary", "Specialist", "Hospital"]
CODE_SYSTEMS = ["ICD10", "NCSP", "ICPC2", "Other"]
CODE_ROLES = ["Primary", "Secondary"]
INJURY_GROUPS = ["Surgical", "Medication", "Infection", "Diagnostic", "Other"]
PATIENT_AGE_RANGE = (0, 120)
SEVERITY_RANGE = (1, 5)
# ---------------------------------------------------------------------------

CLOSED = "Closed"
APPROVED_LIKE = ["Approved", "PartiallyApproved"]

TABLE_NAMES = [
    "providers", "claims", "medical_codes", "claim_medical_codes",
    "injury_types", "claim_injuries",
]


def _f(name: str, dtype: T.DataType, nullable: bool = False) -> T.StructField:
    return T.StructField(name, dtype, nullable)


PROVIDERS = T.StructType([
    _f("provider_id", T.LongType()),
    _f("provider_name", T.StringType()),
    _f("org_number", T.StringType(), True),
    _f("provider_type", T.StringType()),
    _f("region", T.StringType()),
    _f("active", T.BooleanType()),
    _f("created_at", T.TimestampType()),
])

CLAIMS = T.StructType([
    _f("claim_id", T.LongType()),
    _f("claim_reference", T.StringType()),
    _f("patient_age", T.ShortType()),
    _f("patient_sex", T.StringType()),
    _f("region", T.StringType()),
    _f("received_date", T.DateType()),
    _f("decision_date", T.DateType(), True),
    _f("status", T.StringType()),
    _f("decision", T.StringType(), True),
    _f("care_level", T.StringType()),
    _f("claim_amount_nok", T.DecimalType(12, 2)),
    _f("provider_id", T.LongType()),
    _f("created_at", T.TimestampType()),
])

MEDICAL_CODES = T.StructType([
    _f("medical_code_id", T.LongType()),
    _f("code_system", T.StringType()),
    _f("code", T.StringType()),
    _f("code_title", T.StringType()),
    _f("active", T.BooleanType()),
    _f("created_at", T.TimestampType()),
])

CLAIM_MEDICAL_CODES = T.StructType([
    _f("claim_id", T.LongType()),
    _f("medical_code_id", T.LongType()),
    _f("code_role", T.StringType()),
    _f("created_at", T.TimestampType()),
])

INJURY_TYPES = T.StructType([
    _f("injury_type_id", T.LongType()),
    _f("injury_group", T.StringType()),
    _f("injury_name", T.StringType()),
    _f("severity", T.ShortType()),
    _f("active", T.BooleanType()),
    _f("created_at", T.TimestampType()),
])

CLAIM_INJURIES = T.StructType([
    _f("claim_id", T.LongType()),
    _f("injury_type_id", T.LongType()),
    _f("is_primary", T.BooleanType()),
    _f("created_at", T.TimestampType()),
])

SCHEMAS: dict[str, T.StructType] = {
    "providers": PROVIDERS,
    "claims": CLAIMS,
    "medical_codes": MEDICAL_CODES,
    "claim_medical_codes": CLAIM_MEDICAL_CODES,
    "injury_types": INJURY_TYPES,
    "claim_injuries": CLAIM_INJURIES,
}

# Primary and unique keys, used by the data-quality jobs.
PRIMARY_KEYS: dict[str, list[str]] = {
    "providers": ["provider_id"],
    "claims": ["claim_id"],
    "medical_codes": ["medical_code_id"],
    "claim_medical_codes": ["claim_id", "medical_code_id"],
    "injury_types": ["injury_type_id"],
    "claim_injuries": ["claim_id", "injury_type_id"],
}

UNIQUE_KEYS: dict[str, list[str]] = {
    "providers": ["provider_name", "region"],
    "claims": ["claim_reference"],
    "medical_codes": ["code_system", "code"],
    "injury_types": ["injury_group", "injury_name"],
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("claims", "provider_id", "providers", "provider_id"),
    ("claim_medical_codes", "claim_id", "claims", "claim_id"),
    ("claim_medical_codes", "medical_code_id", "medical_codes", "medical_code_id"),
    ("claim_injuries", "claim_id", "claims", "claim_id"),
    ("claim_injuries", "injury_type_id", "injury_types", "injury_type_id"),
]

# Source tables of the driver data set (TPC-H-like), read with fixed schemas.
SUPPLIER = T.StructType([
    _f("s_suppkey", T.LongType(), True),
    _f("s_name", T.StringType(), True),
    _f("s_nationkey", T.IntegerType(), True),
    _f("s_acctbal", T.DoubleType(), True),
])
CUSTOMER = T.StructType([
    _f("c_custkey", T.LongType(), True),
    _f("c_name", T.StringType(), True),
    _f("c_nationkey", T.IntegerType(), True),
    _f("c_acctbal", T.DoubleType(), True),
    _f("c_mktsegment", T.StringType(), True),
])
ORDERS = T.StructType([
    _f("o_orderkey", T.LongType(), True),
    _f("o_custkey", T.LongType(), True),
    _f("o_orderstatus", T.StringType(), True),
    _f("o_totalprice", T.DoubleType(), True),
    _f("o_orderdate", T.TimestampNTZType(), True),
    _f("o_orderpriority", T.StringType(), True),
])
LINEITEM = T.StructType([
    _f("l_orderkey", T.LongType(), True),
    _f("l_partkey", T.LongType(), True),
    _f("l_suppkey", T.LongType(), True),
    _f("l_linenumber", T.IntegerType(), True),
    _f("l_quantity", T.DoubleType(), True),
    _f("l_extendedprice", T.DoubleType(), True),
    _f("l_discount", T.DoubleType(), True),
    _f("l_tax", T.DoubleType(), True),
    _f("l_returnflag", T.StringType(), True),
    _f("l_linestatus", T.StringType(), True),
    _f("l_shipdate", T.TimestampNTZType(), True),
])
PART = T.StructType([
    _f("p_partkey", T.LongType(), True),
    _f("p_name", T.StringType(), True),
    _f("p_brand", T.StringType(), True),
    _f("p_type", T.StringType(), True),
    _f("p_size", T.IntegerType(), True),
    _f("p_retailprice", T.DoubleType(), True),
])

SOURCE_SCHEMAS: dict[str, T.StructType] = {
    "supplier": SUPPLIER,
    "customer": CUSTOMER,
    "orders": ORDERS,
    "lineitem": LINEITEM,
    "part": PART,
}
