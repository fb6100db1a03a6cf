"""Consecutive numbers over any keys, and without an order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from claimlens.operators import number_rows, range_sizes, row_numbers

N = 20_000


def frame(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, k {kind}").repartition(6)


def outlying(rng):
    return [*range(N - 1), 10**15], "long"


def clustered(rng):
    return [rng.randrange(10**6) if rng.random() < 0.1 else 5 * 10**8 + rng.randrange(10**4) for _ in range(N)], "long"


def strings(rng):
    return ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))) for _ in range(N)], "string"


def with_nulls(rng):
    return [None if rng.random() < 0.3 else rng.random() for _ in range(N)], "double"


@pytest.mark.parametrize("kind", [outlying, clustered, strings, with_nulls])
def test_ranges_are_even_and_numbers_consecutive(spark, kind):
    values, sql = kind(random.Random(1))
    df = frame(spark, values, sql)
    sizes = range_sizes(df, "k", "id", buckets=16)
    assert sum(sizes) == N and max(sizes) <= 2 * N / 16
    got = {r["id"]: r["row_number"] for r in number_rows(df, "k", "id", buckets=16).collect()}
    order = sorted(range(N), key=lambda i: (values[i] is None, values[i] if values[i] is not None else 0, i)) if sql != "string" else sorted(
        range(N), key=lambda i: (values[i].encode(), i))
    assert [got[i] for i in order] == list(range(1, N + 1))


@pytest.mark.parametrize("value", [7, None])
def test_one_key_that_all_rows_share(spark, value):
    """Ties are cut where the rows lie, so one key makes even ranges too."""
    df = frame(spark, [value if i % 3 else i for i in range(N)], "long").select("k")
    got = number_rows(df, "k", buckets=8, unique=False)
    assert sorted(r["row_number"] for r in got.collect()) == list(range(1, N + 1))
    by = got.groupBy("k").agg(F.min("row_number").alias("a"), F.max("row_number").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] - r["a"] + 1 == r["n"] for r in by)
    ranks = sorted((r["a"], r["k"]) for r in by)
    assert [k for _, k in ranks] == sorted((k for _, k in ranks), key=lambda k: (k is None, k))
    slices = got.inputFiles()
    assert len(slices) > 1


def test_descending_and_nulls_first(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, k string")
    got = {r["id"]: r["n"] for r in number_rows(df, F.col("k").desc_nulls_first(), name="n").collect()}
    assert got == {2: 1, 3: 2, 1: 3}


def test_row_numbers_without_order(spark):
    df = spark.range(0, 5_000, numPartitions=7).filter("id % 5 <> 0 OR id > 4000")
    numbered = row_numbers(df)
    first = {r["id"]: r["row_number"] for r in numbered.collect()}
    assert sorted(first.values()) == list(range(1, len(first) + 1)) and len(first) == df.count()
    assert row_numbers(df.limit(0)).count() == 0
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan


def test_numbers_do_not_change_when_they_are_read_again(spark):
    """Also when the rows come from a shuffle, whose order differs between attempts."""
    df = spark.range(20_000).repartition(9)
    numbered = row_numbers(df)
    a, b = ({r["id"]: r["row_number"] for r in numbered.collect()} for _ in range(2))
    assert a == b


def test_retried_tasks_give_the_same_numbers(tmp_path):
    """In a session of its own, each first attempt of a task fails while the rows are written."""
    import subprocess
    import sys

    script = tmp_path / "retry.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(__import__('conftest').ROOT)!r})
from pyspark import TaskContext
from pyspark.sql import functions as F
from claimlens.operators import number_rows, row_numbers
from claimlens.session import build_session
spark = build_session("local[2,3]", shuffle_partitions=4, conf={{"spark.sql.warehouse.dir": {str(tmp_path / 'w')!r}, "spark.checkpoint.dir": {str(tmp_path / 'c')!r}}})

def flaky(batches):
    from pyspark import TaskContext
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("first attempt")
    yield from batches

rows = spark.range(3000).repartition(5).mapInPandas(flaky, "id long")
for numbered in (row_numbers(rows), number_rows(rows, F.col("id").desc())):
    got = {{r["id"]: r["row_number"] for r in numbered.collect()}}
    assert sorted(got.values()) == list(range(1, 3001))
assert got == {{i: 3000 - i for i in range(3000)}}
print("fine")
""")
    run = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=300)
    assert run.stdout.strip().endswith("fine"), run.stderr[-2000:]
