"""Data-quality jobs for the constraints of the claims schema.

Spark does not enforce CHECK, UNIQUE or FOREIGN KEY on Parquet, so each
constraint becomes a rule evaluated by a job. Every ``c_*`` report returns
rows of ``(table_name, rule, violations)``; all rules of one table are
evaluated in a single scan of that table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import schemas as S
from claimlens.operators import (
    Rule,
    cascade_delete,
    duplicate_keys,
    foreign_key_counts,
    key_violations,
    not_null_rules,
    row_counts,
    violation_report,
)
from claimlens.plans.regions import count_by_region
from claimlens.plans.views import v1_monthly_kpi, v2_region_kpi, v3_provider_summary
from claimlens.sources.model import ClaimsModel

c = F.col


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _in(column: str, values: list[str]) -> Rule:
    return Rule(f"allowed_{column}", c(column).isin(*values))


# Row rules per table (CHECK constraints of the schema plus the report-level
# rules the reports and README rely on).
def whitelist_rules() -> dict[str, list[Rule]]:
    return {
        "providers": [_in("provider_type", S.PROVIDER_TYPES), _in("region", S.REGIONS)],
        "claims": [
            _in("patient_sex", S.PATIENT_SEXES),
            _in("region", S.REGIONS),
            _in("status", S.STATUSES),
            _in("decision", S.DECISIONS),
            _in("care_level", S.CARE_LEVELS),
        ],
        "medical_codes": [_in("code_system", S.CODE_SYSTEMS)],
        "claim_medical_codes": [_in("code_role", S.CODE_ROLES)],
        "injury_types": [_in("injury_group", S.INJURY_GROUPS)],
    }


def range_rules() -> dict[str, list[Rule]]:
    return {
        "claims": [Rule("range_patient_age", c("patient_age").between(*S.PATIENT_AGE_RANGE))],
        "injury_types": [Rule("range_severity", c("severity").between(*S.SEVERITY_RANGE))],
    }


def claim_rules() -> list[Rule]:
    is_closed = c("status") == S.CLOSED
    return [
        Rule("decision_after_received",
             c("decision_date").isNull() | (c("decision_date") >= c("received_date"))),
        Rule("closed_iff_decision",
             ((c("status") != S.CLOSED) & c("decision").isNull())
             | (is_closed & c("decision").isNotNull())),
        Rule("rejected_zero_amount", ~((c("decision") == "Rejected") & (c("claim_amount_nok") > 0))),
        Rule("nonneg_amount", c("claim_amount_nok") >= 0),
    ]


def all_row_rules(table: str) -> list[Rule]:
    """Every row rule of ``table`` (used by :func:`quarantine`)."""
    required = [f.name for f in S.SCHEMAS[table].fields if not f.nullable]
    rules = not_null_rules(required) + whitelist_rules().get(table, []) + range_rules().get(table, [])
    if table == "claims":
        rules += claim_rules()
    return rules


def _reports(m: ClaimsModel, rules_by_table: dict[str, list[Rule]]) -> DataFrame:
    tables = m.tables()
    return _union(violation_report(tables[t], rules, t) for t, rules in rules_by_table.items() if rules)


def _reports_and_region(m: ClaimsModel, rules_by_table: dict[str, list[Rule]], region_rule: str) -> DataFrame:
    """``_reports``, with the claims' region rule on the claims counted per region: where
    the region is looked up, no claim is moved for it."""
    own = next(r for r in rules_by_table["claims"] if r.name == region_rule)
    rest = {**rules_by_table, "claims": [r for r in rules_by_table["claims"] if r.name != region_rule]}
    broken = count_by_region(m, "n").filter(own.violated()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    return _reports(m, rest).unionByName(
        broken.select(F.lit("claims").alias("table_name"), F.lit(region_rule).alias("rule"), "violations"))


def c_not_null(m: ClaimsModel) -> DataFrame:
    return _reports_and_region(m, {
        t: not_null_rules([f.name for f in S.SCHEMAS[t].fields if not f.nullable])
        for t in S.TABLE_NAMES
    }, "not_null_region")


def c_whitelist(m: ClaimsModel) -> DataFrame:
    return _reports_and_region(m, whitelist_rules(), "allowed_region")


def c_range(m: ClaimsModel) -> DataFrame:
    return _reports(m, range_rules())


def c_claim_rules(m: ClaimsModel) -> DataFrame:
    """Date order, closed-iff-decision, rejected-zero-amount, non-negative amount."""
    return _reports(m, {"claims": claim_rules()})


def _single_claim_rule(rule_name: str):
    def report(m: ClaimsModel) -> DataFrame:
        rules = [r for r in claim_rules() if r.name == rule_name]
        return _reports(m, {"claims": rules})

    report.__name__ = f"c_{rule_name}"
    report.__doc__ = f"Violations of the claims rule ``{rule_name}``."
    return report


c_decision_after_received = _single_claim_rule("decision_after_received")
c_closed_iff_decision = _single_claim_rule("closed_iff_decision")
c_rejected_zero_amount = _single_claim_rule("rejected_zero_amount")
c_nonneg_amount = _single_claim_rule("nonneg_amount")


def _key_report(table: str, rule: str, dupes: DataFrame) -> DataFrame:
    return dupes.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "violations"
    )


def c_primary_key(m: ClaimsModel) -> DataFrame:
    """Per table: key values held by more than one row, and rows with a NULL
    key part -- both from one grouped pass over the table."""
    tables = m.tables()
    frames = []
    for t, keys in S.PRIMARY_KEYS.items():
        both = key_violations(tables[t], keys)
        frames.append(
            both.select(
                F.lit(t).alias("table_name"),
                F.explode(F.array(
                    F.struct(F.lit("primary_key_duplicate").alias("rule"), F.col("duplicates").alias("violations")),
                    F.struct(F.lit("primary_key_null").alias("rule"), F.col("null_keys").alias("violations")),
                )).alias("r"),
            ).select("table_name", "r.rule", "r.violations")
        )
    return _union(frames)


def c_unique(m: ClaimsModel) -> DataFrame:
    tables = m.tables()
    return _union(
        _key_report(t, "unique_" + "_".join(keys), duplicate_keys(tables[t], keys))
        for t, keys in S.UNIQUE_KEYS.items()
    )


def c_foreign_key(m: ClaimsModel) -> DataFrame:
    """Rows whose key has no parent, for all foreign keys in one exchange."""
    return foreign_key_counts(m.tables(), S.FOREIGN_KEYS)


def cascade_delete_claims(m: ClaimsModel, deleted: Column) -> ClaimsModel:
    """Delete the claims matching ``deleted`` and, as ON DELETE CASCADE does,
    every bridge row that references them."""
    gone = m.claims.filter(deleted).select("claim_id")
    return m.replace(
        claims=m.claims.filter(~F.coalesce(deleted, F.lit(False))),
        claim_medical_codes=cascade_delete(m.claim_medical_codes, gone, "claim_id"),
        claim_injuries=cascade_delete(m.claim_injuries, gone, "claim_id"),
    )


def c_cascade_delete(m: ClaimsModel) -> DataFrame:
    """Row counts left after purging every Rejected claim with its bridge rows."""
    after = cascade_delete_claims(m, c("decision") == "Rejected")
    return row_counts({
        "claims": after.claims,
        "claim_medical_codes": after.claim_medical_codes,
        "claim_injuries": after.claim_injuries,
    })


def c_month_spine_reconcile(m: ClaimsModel) -> DataFrame:
    """The three views account for every claim exactly once."""
    from claimlens.operators import row_count

    v1 = v1_monthly_kpi(m)
    return v1.agg(F.sum("claims_received").alias("monthly_received")).select(
        "monthly_received",
        v2_region_kpi(m).select(F.sum("total_claims")).scalar().alias("region_total"),
        v3_provider_summary(m).select(F.sum("total_claims")).scalar().alias("provider_total"),
        row_count(m.claims).alias("claims_count"),
    )


def c_quarantine(m: ClaimsModel) -> DataFrame:
    """Per table the rows that pass every row rule and the rows set aside, in one pass over it."""
    frames = []
    for name, df in m.tables().items():
        broken = functools.reduce(lambda a, r: a | r.violated(), all_row_rules(name), F.lit(False))
        counted = df.agg(F.count_if(~broken).alias("passed"), F.count_if(broken).alias("quarantined"))
        frames.append(counted.unpivot([], ["passed", "quarantined"], "outcome", "row_count").select(
            F.lit(name).alias("table_name"), "outcome", "row_count"))
    return _union(frames)


def c_defaults(m: ClaimsModel) -> DataFrame:
    """Loads every table without its defaulted columns: rows filled per column, and
    rows left without a value (none)."""
    frames = []
    for name, columns in defaults().items():
        filled = apply_defaults(m.tables()[name].drop(*columns), name)
        rules = [Rule(column, c(column).isNotNull()) for column in columns]
        wide = filled.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(r.violated()).alias(r.name) for r in rules])
        frames.append(wide.unpivot(["_rows"], list(columns), "column_name", "missing").select(
            F.lit(name).alias("table_name"), "column_name", c("_rows").alias("filled_rows"), "missing"))
    return _union(frames)


# Column defaults of the schema, applied when a loaded file lacks the column.
def defaults() -> dict[str, dict[str, Column]]:
    return {
        "providers": {"active": F.lit(True), "created_at": F.current_timestamp()},
        "claims": {"claim_amount_nok": F.lit(0).cast("decimal(12,2)"), "created_at": F.current_timestamp()},
        "medical_codes": {"active": F.lit(True), "created_at": F.current_timestamp()},
        "claim_medical_codes": {"created_at": F.current_timestamp()},
        "injury_types": {"active": F.lit(True), "created_at": F.current_timestamp()},
        "claim_injuries": {"is_primary": F.lit(False), "created_at": F.current_timestamp()},
    }


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """Add defaulted columns that are *absent*; an explicit NULL stays a violation."""
    for name, value in defaults()[table].items():
        if name not in df.columns:
            df = df.withColumn(name, value.cast(S.SCHEMAS[table][name].dataType))
    return df.select(*[f.name for f in S.SCHEMAS[table].fields])
