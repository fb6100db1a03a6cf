"""Exact rounding of the column builders against Python's Decimal, on random inputs."""

from __future__ import annotations

import decimal
import random

from pyspark.sql import functions as F

from claimlens.functions import exact_avg, pct, ratio

D = decimal.Decimal


def half_up(x: D, dp: int) -> D:
    return x.quantize(D(1).scaleb(-dp), rounding=decimal.ROUND_HALF_UP)


def test_pct_is_exact_half_up(spark):
    rng = random.Random(7)
    dens = [rng.randint(1, 10**6) for _ in range(3000)]
    cases = [(rng.randint(0, d), d) for d in dens]  # a part of a whole: 0..100 %
    cases += [(1, 16), (247, 2000), (1, 8), (5, 8), (0, 3), (3, 3)]  # .x5 ties
    df = spark.createDataFrame(cases, "num long, den long")
    out = df.select("num", "den", pct(F.col("num"), F.col("den"), 1).alias("p1"),
                    pct(F.col("num"), F.col("den"), 2).alias("p2")).collect()
    decimal.getcontext().prec = 50
    for r in out:
        exact = D(100) * D(r.num) / D(r.den)
        assert r.p1 == half_up(exact, 1), r
        assert r.p2 == half_up(exact, 2), r


def test_pct_null_on_zero_denominator(spark):
    r = spark.range(1).select(pct(F.lit(3), F.lit(0), 1).alias("p"), ratio(F.lit(3), F.lit(0)).alias("r")).collect()[0]
    assert r.p is None and r.r is None


def test_exact_avg_matches_decimal(spark):
    rng = random.Random(11)
    rows = []
    for g in range(300):
        n = rng.randint(1, 40)
        for _ in range(n):
            rows.append((g, D(rng.randint(0, 10**9)) / D(100)))
    df = spark.createDataFrame(rows, "g int, amount decimal(12,2)")
    got = {r.g: r.a for r in df.groupBy("g").agg(exact_avg(F.col("amount"), 2).alias("a")).collect()}
    by_group: dict[int, list[D]] = {}
    for g, a in rows:
        by_group.setdefault(g, []).append(a)
    for g, vals in by_group.items():
        assert got[g] == half_up(sum(vals) / D(len(vals)), 2), g


def test_exact_avg_of_day_counts(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(1, 180)) for g in range(200) for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "g int, days int")
    got = {r.g: r.a for r in df.groupBy("g").agg(exact_avg(F.col("days"), 1, integral=True).alias("a")).collect()}
    by_group: dict[int, list[int]] = {}
    for g, d in rows:
        by_group.setdefault(g, []).append(d)
    for g, vals in by_group.items():
        assert got[g] == half_up(D(sum(vals)) / D(len(vals)), 1), g
