"""Side-by-side check of a Spark result against a DuckDB statement.

Compares column names, declared types (mapped across engines), row counts and
values, ignoring row order. Floats compare with a relative tolerance of 1e-12.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "embeddings", "benchmark", "labels",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def spark_type_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    return {
        T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT",
        T.DoubleType: "DOUBLE", T.StringType: "VARCHAR", T.DateType: "DATE",
        T.BooleanType: "BOOLEAN", T.TimestampType: "TIMESTAMP WITH TIME ZONE",
        T.TimestampNTZType: "TIMESTAMP", T.FloatType: "FLOAT",
    }.get(type(dtype), dtype.simpleString())


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return v
    if isinstance(v, decimal.Decimal):
        return v.normalize() if v != 0 else decimal.Decimal(0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _sort_key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0)
                 for x in row)


def _eq(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        a, b = float(a), float(b)
        return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> dict:
    s_cols = df.columns
    s_types = {f.name: spark_type_name(f.dataType) for f in df.schema.fields}
    s_rows = [tuple(_norm(r[c]) for c in sorted(s_cols)) for r in df.collect()]
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_types = {d[0]: str(d[1]) for d in cur.description}
    raw = cur.fetchall()
    idx = {c: i for i, c in enumerate(d_cols)}
    out = {
        "columns_match": sorted(s_cols) == sorted(d_cols),
        "spark_columns": s_cols,
        "oracle_columns": d_cols,
        "spark_rows": len(s_rows),
        "oracle_rows": len(raw),
    }
    type_diff = {
        c: (s_types[c], d_types[c]) for c in s_cols if c in d_types and s_types[c] != d_types[c]
    }
    out["type_diff"] = type_diff
    if not out["columns_match"]:
        out["values_match"] = False
        return out
    d_rows = [tuple(_norm(r[idx[c]]) for c in sorted(s_cols)) for r in raw]
    s_sorted = sorted(s_rows, key=_sort_key)
    d_sorted = sorted(d_rows, key=_sort_key)
    mism = []
    if len(s_sorted) == len(d_sorted):
        for a, b in zip(s_sorted, d_sorted):
            if not all(_eq(x, y) for x, y in zip(a, b)):
                mism.append((a, b))
                if len(mism) >= 3:
                    break
    out["values_match"] = len(s_sorted) == len(d_sorted) and not mism
    out["first_mismatches"] = mism
    out["columns_sorted"] = sorted(s_cols)
    return out
