"""A claims model with known faults, for the checks to find.

Faults are set by key: a row whose key has a certain remainder gets one fault, so
the same rows are faulty in every run and at every size. Besides faulty values,
some rows come twice (duplicate keys), and some come a second time without their
key (NULL keys).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens import schemas as S
from claimlens.sources.model import ClaimsModel


@dataclass(frozen=True)
class Faults:
    """``key`` is the expression whose remainder by ``modulus`` picks the fault."""

    key: str
    modulus: int
    #: column -> (remainder, SQL value) pairs
    values: dict[str, list[tuple[int, str]]]
    twice: int
    without_key: int


# Fixed values of the faulty model; the SQL oracle reads the same table.
FAULTS: dict[str, Faults] = {
    "providers": Faults("provider_id", 17, {
        "provider_name": [(1, "NULL")],
        "provider_type": [(2, "NULL"), (3, "'Spa'")],
        "region": [(4, "NULL"), (5, "'Atlantis'")],
        "active": [(6, "NULL")],
        "created_at": [(7, "NULL")],
    }, 8, 9),
    "claims": Faults("claim_id", 101, {
        "claim_reference": [(1, "NULL")],
        "patient_age": [(2, "150"), (3, "NULL")],
        "patient_sex": [(4, "'Q'"), (5, "NULL")],
        "region": [(6, "'Atlantis'"), (7, "NULL")],
        "received_date": [(8, "NULL")],
        "status": [(9, "'Lost'"), (10, "NULL"), (20, "'Closed'"), (21, "'Closed'"), (22, "'Received'")],
        "decision": [(11, "'Maybe'"), (20, "NULL"), (21, "'Rejected'"), (22, "'Approved'")],
        "care_level": [(12, "'None'"), (13, "NULL")],
        "claim_amount_nok": [(14, "NULL"), (15, "-5"), (21, "10")],
        "created_at": [(16, "NULL")],
        "provider_id": [(17, "NULL"), (18, "-1")],
        "decision_date": [(19, "DATE '1900-01-01'")],
    }, 23, 24),
    "medical_codes": Faults("medical_code_id", 53, {
        "code_system": [(1, "NULL"), (2, "'XXX'")],
        "code": [(3, "NULL")],
        "code_title": [(4, "NULL")],
        "active": [(5, "NULL")],
        "created_at": [(6, "NULL")],
    }, 7, 8),
    "claim_medical_codes": Faults("(claim_id + medical_code_id)", 97, {
        "code_role": [(1, "'Third'"), (2, "NULL")],
        "medical_code_id": [(3, "-1"), (4, "NULL")],
        "claim_id": [(5, "-1")],
        "created_at": [(6, "NULL")],
    }, 7, 8),
    "injury_types": Faults("injury_type_id", 16, {
        "injury_group": [(1, "NULL"), (2, "'Magic'")],
        "severity": [(3, "9"), (4, "NULL")],
        "injury_name": [(5, "NULL")],
        "active": [(6, "NULL")],
        "created_at": [(7, "NULL")],
    }, 8, 9),
    "claim_injuries": Faults("(claim_id * 3 + injury_type_id)", 89, {
        "is_primary": [(1, "NULL")],
        "created_at": [(2, "NULL")],
        "injury_type_id": [(3, "-1"), (4, "NULL")],
        "claim_id": [(5, "-1")],
    }, 7, 8),
}


def _with_faults(df: DataFrame, table: str) -> DataFrame:
    faults = FAULTS[table]
    at = F.expr(f"{faults.key} % {faults.modulus}")
    columns = []
    for field in S.SCHEMAS[table].fields:
        value = F.col(field.name)
        for remainder, bad in faults.values.get(field.name, []):
            value = F.when(at == remainder, F.expr(f"CAST({bad} AS {field.dataType.simpleString()})")).otherwise(value)
        columns.append(value.alias(field.name))
    # One scan: a row's copies are made beside it (0: itself, 1: again, 2: again without its key).
    copies = F.when(at == faults.twice, F.array(F.lit(0), F.lit(1))).when(at == faults.without_key, F.array(F.lit(0), F.lit(2))).otherwise(
        F.array(F.lit(0)))
    key = S.PRIMARY_KEYS[table][0]
    return df.select(*columns, F.explode(copies).alias("_copy")).select(
        *[F.when(F.col("_copy") != 2, F.col(f.name)).alias(f.name) if f.name == key else F.col(f.name) for f in S.SCHEMAS[table].fields])


def faulty_model(m: ClaimsModel) -> ClaimsModel:
    return ClaimsModel(**{name: _with_faults(df, name) for name, df in m.tables().items()})


def over_faults(report: Callable[[ClaimsModel], DataFrame]) -> Callable[[ClaimsModel], DataFrame]:
    """The report over the faulty version of a model."""
    return lambda m: report(faulty_model(m))
