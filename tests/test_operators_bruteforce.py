"""Operators against brute force (plain pandas) on random data.

Every data set has a hot key holding a third of all rows and NULL keys, and is
spread over several Spark partitions unevenly.
"""

from __future__ import annotations

import datetime as dt
import decimal
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimlens.operators import (
    dual_date_monthly,
    duplicate_keys,
    orphans,
    outcome_rate,
    preagg_left_join,
    share_of_total,
    top_k,
    top_per_group,
)
from claimlens.functions import count_where

D = decimal.Decimal
SEEDS = [1, 2, 3]


def skewed_rows(seed: int, n: int = 600) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            key = "hot"
        elif rng.random() < 0.05:
            key = None
        else:
            key = f"k{rng.randint(0, 25)}"
        rows.append((i, key, rng.randint(0, 9), rng.random() < 0.4))
    rng.shuffle(rows)
    return rows


def frame(spark, rows, schema="id long, key string, score int, hit boolean", parts=5):
    return spark.createDataFrame(rows, schema).repartition(parts, F.col("id") % 3)


def half_up(x: D, dp: int) -> D:
    return x.quantize(D(1).scaleb(-dp), rounding=decimal.ROUND_HALF_UP)


@pytest.mark.parametrize("seed", SEEDS)
def test_share_of_total(spark, seed):
    rows = skewed_rows(seed)
    got = {r.key: (r.n, r.pct) for r in share_of_total(frame(spark, rows), ["key"], dp=2).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "key", "score", "hit"])
    counts = pdf["key"].value_counts(dropna=False)
    assert len(got) == len(counts)
    for key, n in counts.items():
        k = None if pd.isna(key) else key
        assert got[k][0] == n
        assert got[k][1] == half_up(D(100) * D(int(n)) / D(len(rows)), 2)


@pytest.mark.parametrize("seed", SEEDS)
def test_outcome_rate(spark, seed):
    rows = skewed_rows(seed)
    df = frame(spark, rows)
    got = {r.key: (r.base_count, r.hit_count, r.rate_pct)
           for r in outcome_rate(df, ["key"], F.col("score") >= 3, F.col("hit"), dp=1).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "key", "score", "hit"])
    base = pdf[pdf.score >= 3]
    for key, g in base.groupby("key", dropna=False):
        k = None if pd.isna(key) else key
        hits = int(g.hit.sum())
        assert got[k] == (len(g), hits, half_up(D(100) * D(hits) / D(len(g)), 1))
    assert len(got) == base.groupby("key", dropna=False).ngroups


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("method", ["row_number", "dense_rank"])
def test_top_per_group(spark, seed, method):
    rows = skewed_rows(seed)
    df = frame(spark, rows)
    k = 3
    got = sorted(
        (r.key or "", r.id) for r in top_per_group(df, ["key"], [F.col("score").desc(), F.col("id")], k=k,
                                                   method=method).collect()
    )
    pdf = pd.DataFrame(rows, columns=["id", "key", "score", "hit"]).fillna({"key": ""})
    want = sorted(
        (key, int(i))
        for key, g in pdf.groupby("key")
        for i in g.sort_values(["score", "id"], ascending=[False, True]).id.head(k)
    )
    # with a unique last sort key, dense_rank and row_number keep the same rows
    assert got == want


@pytest.mark.parametrize("seed", SEEDS)
def test_top_k(spark, seed):
    rows = skewed_rows(seed)
    got = [r.id for r in top_k(frame(spark, rows), [F.col("score").desc(), F.col("id")], 7).collect()]
    pdf = pd.DataFrame(rows, columns=["id", "key", "score", "hit"])
    want = list(pdf.sort_values(["score", "id"], ascending=[False, True]).id.head(7))
    assert got == want


@pytest.mark.parametrize("seed", SEEDS)
def test_preagg_left_join(spark, seed):
    rows = skewed_rows(seed)
    fact = frame(spark, rows)
    keys = sorted({r[1] for r in rows if r[1] is not None}) + ["never_used"]
    dim = spark.createDataFrame([(k, k.upper()) for k in keys], "key string, label string")
    out = preagg_left_join(dim, fact, "key", [F.count(F.lit(1)).alias("n"), count_where(F.col("hit")).alias("hits")],
                           fills={"n": F.lit(0).cast("bigint"), "hits": F.lit(0).cast("bigint")})
    got = {r.key: (r.label, r.n, r.hits) for r in out.collect()}
    pdf = pd.DataFrame(rows, columns=["id", "key", "score", "hit"])
    for k in keys:
        g = pdf[pdf.key == k]
        assert got[k] == (k.upper(), len(g), int(g.hit.sum()))
    assert len(got) == len(keys)


@pytest.mark.parametrize("seed", SEEDS)
def test_dual_date_monthly(spark, seed):
    rng = random.Random(seed)
    base = dt.date(2023, 1, 1)
    rows = []
    for i in range(500):
        opened = base + dt.timedelta(days=rng.randint(0, 400) if i % 3 else 10)  # a hot month
        closed = opened + dt.timedelta(days=rng.randint(0, 120)) if rng.random() < 0.7 else None
        rows.append((i, opened, closed, rng.random() < 0.5))
    df = spark.createDataFrame(rows, "id long, opened date, closed date, flag boolean").repartition(4)
    out = dual_date_monthly(
        df, "opened", "closed",
        {"opened_n": F.count(F.lit(1))}, {"closed_flagged": count_where(F.col("flag"))}, month_name="month",
    )
    got = {r.month: (r.opened_n or 0, r.closed_flagged or 0) for r in out.collect()}
    pdf = pd.DataFrame(rows, columns=["id", "opened", "closed", "flag"])
    month = lambda d: d.replace(day=1)
    spine = {month(d) for d in pdf.opened} | {month(d) for d in pdf.closed.dropna()}
    assert set(got) == spine
    for mth in spine:
        opened_n = sum(month(d) == mth for d in pdf.opened)
        closed_n = sum(1 for d, f in zip(pdf.closed, pdf.flag) if d is not None and not pd.isna(d)
                       and month(d) == mth and f)
        assert got[mth] == (opened_n, closed_n), mth


@pytest.mark.parametrize("seed", SEEDS)
def test_duplicate_keys_and_orphans(spark, seed):
    rows = skewed_rows(seed)
    df = frame(spark, rows)
    got = {r.key: r.copies for r in duplicate_keys(df, ["key"]).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "key", "score", "hit"])
    counts = pdf.key.dropna().value_counts()
    assert got == {k: int(v) for k, v in counts.items() if v > 1}
    parents = spark.createDataFrame([(f"k{i}",) for i in range(0, 26, 2)], "pk string")
    got_orphans = sorted(r.id for r in orphans(df, "key", parents, "pk").collect())
    valid = {f"k{i}" for i in range(0, 26, 2)}
    want = sorted(int(i) for i, k in zip(pdf.id, pdf.key) if k is not None and k not in valid)
    assert got_orphans == want
