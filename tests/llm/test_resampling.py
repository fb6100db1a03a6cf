import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from claimlens.llm import resampling as R
from claimlens.llm.queries import op4_importance_resampling
from claimlens.llm.tokens import mixed, text_slices

SF = "/root/testdata/sf0.01"


def grams(text):
    """Buckets one n-gram at a time."""
    words = (text or "").encode()
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in words).split()
    h = [np.array([xxh64_intdigest(w, 0)], np.uint64) for w in words]
    out = [mixed(x, x ^ np.uint64(1)) for x in h] + [mixed(x, y) for x, y in zip(h, h[1:])]
    return [int(x[0]) >> (64 - R.BUCKET_BITS) for x in out]


def brute(rows, good):
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    n, m = sum(raw.values()), sum(target.values())
    ratio = lambda b: math.log((target[b] + 1) / (m + R.BUCKETS)) - math.log((raw[b] + 1) / (n + R.BUCKETS))
    return [sum(map(ratio, grams(t))) if m else 0.0 for _, t in rows]


ROWS = [(1, "good words here good words"), (2, "bad stuff !!!"), (3, None), (4, ""), (5, "one"), (5, "one"), (6, "Good é words " * 9_000), (None, "good words")]


def test_weights_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1.0, True) for i, t in ROWS], "doc_id long, text string, log_weight double, selected boolean")
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 1), (2, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    ratios = R.log_ratios(df, labels, F.col("quality") == 1)
    got = sorted(((r.doc_id, r.log_weight) for r in R.resample(df, ratios, 0.5).collect()), key=str)
    want = sorted(((i, w) for (i, _), w in zip(ROWS, brute(ROWS, {1, 6}))), key=str)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([w for _, w in got], [w for _, w in want], rtol=1e-9)


@pytest.mark.parametrize("k", [1, 2, 5, 777, 2000])
def test_kth_largest(spark, k):
    values = np.random.default_rng(k).integers(-(2**63), 2**63 - 1, 2000).tolist()
    values[:300] = [7] * 300
    df = spark.createDataFrame([(int(v),) for v in values], "v long")
    assert R.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_sample_size_and_noise(spark):
    df = spark.createDataFrame([(i, f"w{i % 7} x") for i in range(4000)], "doc_id long, text string")
    out = R.resample(df, np.zeros(R.BUCKETS), 0.25)
    rows = out.collect()
    assert sum(r.selected for r in rows) == 1000
    noise = np.array([r.noisy for r in rows])
    assert abs(noise.mean() - 0.5772) < 0.07 and abs(noise.var() - math.pi**2 / 6) < 0.2
    assert {r.doc_id for r in rows if r.selected} == {r.doc_id for r in R.resample(df.repartition(5), np.zeros(R.BUCKETS), 0.25).collect() if r.selected}


def test_slices_hold_every_text():
    texts = ["a", "", None, "bb" * 9, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    for most in (1, 5, 100):
        assert [(f + i, t) for f, part in text_slices(batch, 0, most) for i, t in enumerate(part)] == [
            (i, (t or "").encode()) for i, t in enumerate(texts)]


def test_empty_tables(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    ratios = R.log_ratios(df, labels, F.col("quality") == 1)
    assert not ratios.any() and R.resample(df.limit(0), ratios, 0.5).count() == 0


def test_query_equals_brute_force_and_prefers_good(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in op4_importance_resampling(spark, SF).collect()}
    want = dict(zip([i for i, _ in rows], brute(rows, {i for i, q in labels.items() if q == 1})))
    assert len(got) == len(rows) and all(math.isclose(got[i].log_weight, w, rel_tol=1e-9, abs_tol=1e-9) for i, w in want.items())
    kept = {q: np.mean([got[i].selected for i, x in labels.items() if x == q]) for q in (0, 1)}
    assert sum(r.selected for r in got.values()) == 800 and kept[1] > kept[0] + 0.3
