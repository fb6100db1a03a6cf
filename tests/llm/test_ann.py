import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import ann


def dot(x, y):
    total = 0.0
    for a, b in zip(x, y):
        total += a * b
    return total


def brute(rows, k, is_query):
    def ok(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    kept = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and ok(v)]
    out = []
    for q, x in kept:
        if is_query(q):
            near = sorted((-dot(x.tolist(), y.tolist()), i) for i, y in kept if i != q and len(y) == len(x))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("query_block,candidate_block", [(2048, 32768), (7, 50)])
def test_equals_brute_force(spark, query_block, candidate_block):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=9).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[4][1]) for i in range(30)]  # ties
    rows += [(20, rows[20][1]), (2000, None), (2001, []), (2002, [0.0] * 9), (2003, [1.0] * 8 + [None]), (2004, [math.nan] + [1.0] * 8),
             (2005, [math.inf] + [1.0] * 8), (None, [1.0] * 9), (2010, [1e-30] * 9), (2020, [1e30] * 9), (2030, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 3, 1.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, 6, query_block=query_block, candidate_block=candidate_block)
    plain = [(i, [None if x is None else float(np.float32(x)) for x in v] if v else v) for i, v in rows]
    seen, unique = set(), []
    for i, v in plain:  # rows equal in id and vector count once
        if (i, str(v)) not in seen:
            unique.append((i, v))
        seen.add((i, str(v)))
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(unique, 6, lambda q: q % 10 == 0)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(7)
    q, c = rng.normal(size=(20, 32)), rng.normal(size=(4096, 32))
    top = ann.TopK(np.arange(20), q, 5)
    recomputed = top.add(np.arange(100, 4196), c)
    exact = q @ c.T
    for i, heap in enumerate(top.heaps):
        assert sorted(-v - 100 for _, v in heap) == sorted(np.argsort(-exact[i])[:5].tolist())
    assert recomputed < 20 * 4096 / 20


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") == 0, 20).collect()] == [(0, 1, 1, 0.5)]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0, 20).count() == 0
