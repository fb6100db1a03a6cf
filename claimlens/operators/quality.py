"""Data-quality rules as Spark jobs.

A rule is a CHECK predicate: a row passes when the predicate is TRUE *or
UNKNOWN* (SQL CHECK semantics), so a violation is ``NOT coalesce(check, true)``.

* ``violation_counts`` evaluates any number of row rules in one aggregate pass.
* ``quarantine`` tags each row with the names of the rules it breaks and
  splits good from bad rows (``write_quarantined`` does it in one written pass).
* ``duplicate_keys`` / ``orphans`` check keys with a partial aggregation and an
  anti join (AQE splits a skewed key on the big side).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAILED = "failed_rules"


@dataclass(frozen=True)
class Rule:
    name: str
    check: Column  # TRUE (or NULL) for a valid row

    def violated(self) -> Column:
        return ~F.coalesce(self.check, F.lit(True))


def not_null_rules(columns: Sequence[str]) -> list[Rule]:
    return [Rule(f"not_null_{c}", F.col(c).isNotNull()) for c in columns]


def violation_counts(df: DataFrame, rules: Sequence[Rule], null_on_empty: bool = False) -> DataFrame:
    """One row, one violation count per rule, from a single scan.

    ``null_on_empty`` reproduces ``SUM(CASE ...)`` (NULL over an empty table).
    """
    if null_on_empty:
        aggs = [F.sum(F.when(r.violated(), 1).otherwise(0)).cast("bigint").alias(r.name) for r in rules]
    else:
        aggs = [F.count_if(r.violated()).alias(r.name) for r in rules]
    return df.agg(*aggs)


def violation_report(df: DataFrame, rules: Sequence[Rule], table: str) -> DataFrame:
    """(table_name, rule, violations) rows: ``violation_counts`` unpivoted."""
    wide = violation_counts(df, rules)
    return wide.unpivot([], [r.name for r in rules], "rule", "violations").select(
        F.lit(table).alias("table_name"), "rule", "violations"
    )


def tag_failures(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    names = F.array(*[F.when(r.violated(), F.lit(r.name)) for r in rules])
    return df.withColumn(FAILED, F.filter(names, lambda x: x.isNotNull()))


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``failed_rules``)."""
    tagged = tag_failures(df, rules)
    good = tagged.filter(F.size(FAILED) == 0).drop(FAILED)
    bad = tagged.filter(F.size(FAILED) > 0)
    return good, bad


def write_quarantined(df: DataFrame, rules: Sequence[Rule], path: str, mode: str = "overwrite") -> None:
    """Write good and bad rows in one pass, split by a ``dq_status`` partition
    column (``pass`` / ``quarantine``), so each side is its own folder."""
    status = F.when(F.size(FAILED) > 0, "quarantine").otherwise("pass")
    tagged = tag_failures(df, rules).withColumn("dq_status", status)
    tagged.write.mode(mode).partitionBy("dq_status").parquet(path)


def duplicate_keys(df: DataFrame, keys: Sequence[str], count_name: str = "copies") -> DataFrame:
    """Key values held by more than one row (rows with a NULL key never clash)."""
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    return (
        df.filter(present)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(count_name))
        .filter(F.col(count_name) > 1)
    )


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (duplicates, null_keys) for a primary key, from a single scan.

    Groups by the key *including* NULLs (one partial-aggregated shuffle):
    ``duplicates`` = key values without NULL parts held by more than one row,
    ``null_keys`` = rows with a NULL key part.
    """
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_null", any_null)
    return groups.agg(
        F.count_if(~F.col("_null") & (F.col("_copies") > 1)).alias("duplicates"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("_copies"))), F.lit(0)).cast("bigint").alias("null_keys"),
    )


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-NULL ``column`` has no parent row (foreign-key break)."""
    keys = parent.select(F.col(parent_column).alias("_parent_key"))
    return child.filter(F.col(column).isNotNull()).join(
        keys, F.col(column) == F.col("_parent_key"), "left_anti"
    )


def orphan_counts(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows per non-NULL value of ``column`` without a parent row: (value, n).

    The child is counted per value first (partial aggregation), so the join moves
    its distinct values, however often one of them occurs. An outer join that keeps
    the rows without a match, as the optimizer moves an anti join below the count.
    """
    values = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(F.col(parent_column).alias("_parent_key"), F.lit(True).alias("_known"))
    return values.join(keys, F.col("_value") == F.col("_parent_key"), "left").filter(F.col("_known").isNull()).select("_value", "n")


def foreign_key_counts(tables: dict[str, DataFrame], relations: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """(table_name, rule, violations) of every (child, column, parent, parent column): child rows whose non-NULL
    ``column`` has no parent row.

    All relations meet in one exchange. Each table is read once and tells its rows' values: those of a
    foreign key as rows of its relation, those of a key as known. Grouped by (parent, value), a value is
    counted in the task that read it, so a hot value moves one row a task. Values are compared as they
    are, as text only where their types differ.
    """
    names = list(tables)
    types = {tables[t].schema[c].dataType for child, column, parent, pcol in relations for t, c in ((child, column), (parent, pcol))}
    alike = types.pop() if len(types) == 1 else T.StringType()
    kinds = [f"_r{i}" for i in range(len(relations))]
    frames = []
    for t, df in tables.items():
        told = [(parent, column, i) for i, (child, column, parent, _) in enumerate(relations) if child == t]
        told += [(t, c, -1) for c in dict.fromkeys(pcol for _, _, parent, pcol in relations if parent == t)]
        if told:
            facts = F.array(*[F.struct(
                F.lit(names.index(parent)).alias("parent"), F.col(c).cast(alike).alias("value"), F.lit(i).alias("relation")) for parent, c, i in told])
            frames.append(df.select(F.explode(facts).alias("_f")).select("_f.*"))
    facts = frames[0]
    for f in frames[1:]:
        facts = facts.unionByName(f)
    met = facts.filter(F.col("value").isNotNull()).groupBy("parent", "value").agg(
        F.max(F.col("relation") == -1).alias("_known"), *[F.count_if(F.col("relation") == i).alias(k) for i, k in enumerate(kinds)])
    broken = met.filter(~F.col("_known")).agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds])
    rows = F.array(*[
        F.struct(F.lit(child).alias("table_name"), F.lit(f"fk_{column}_{parent}").alias("rule"), F.col(k).alias("violations"))
        for (child, column, parent, _), k in zip(relations, kinds)])
    return broken.select(F.explode(rows).alias("r")).select("r.*")


def cascade_delete(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows that survive deleting the parents listed in ``deleted``."""
    return child.join(deleted.select(key), key, "left_anti")


# Names used in the design notes for the same operators.
violations = violation_counts
check_unique = duplicate_keys
check_fk = orphans
