"""The queries that SQL can express equal their DuckDB statements."""

import duckdb
import pytest
from harness import compare

import __spark_entry__ as entry
from claimlens.llm.oracle import ORACLE
from claimlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    result = compare(QUERIES[name](spark, SF), con, ORACLE[name])
    assert result["columns_match"] and not result["type_diff"], result
    assert result["spark_rows"] == result["oracle_rows"] > 0 and result["values_match"], result["first_mismatches"]


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_clashing_and_missing_columns(spark, tmp_path):
    """Every query over tables with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for c in ("id", "t", "fp", "h", "cell", "spans", "score", "train", "batch", "length", "component_id", "text_hash", "words"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.withColumn("lang", F.when(F.col("doc_id") % 9 != 0, F.col("lang"))).withColumn(
        "text", F.when(F.col("doc_id") % 13 != 0, F.col("text"))).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").withColumn("text", F.lit("y")).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumn("id", F.lit(1)).withColumn("row", F.lit(2)).write.parquet(
        str(tmp_path / "embeddings.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").withColumn("doc_id", F.lit(1)).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("text", F.lit("x")).withColumn("h", F.lit("y")).write.parquet(
        str(tmp_path / "pages.parquet"))
    n = docs.count()
    for name, query in QUERIES.items():
        rows = query(spark, str(tmp_path)).count()
        by_document = name.split("_")[0] not in ("op5", "op7", "op11", "op12", "op13")
        assert rows == n if by_document else rows > 0, name
