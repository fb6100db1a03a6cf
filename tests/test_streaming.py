"""Streaming view refresh equals the batch views after every arrival."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.plans import views
from claimlens.streaming import read_view, start_view_refresh


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float):
                assert abs(u - v) <= 1e-9 * max(1.0, abs(u))
            else:
                assert u == v


def test_streamed_views_match_batch(spark, small_model, tmp_path):
    source = str(tmp_path / "incoming")
    out = str(tmp_path / "views")
    ckpt = str(tmp_path / "ckpt")
    claims = small_model.claims.cache()
    first = claims.filter(F.col("claim_id") % 2 == 0)
    second = claims.filter(F.col("claim_id") % 2 == 1)

    first.write.mode("append").parquet(source)
    for q in start_view_refresh(spark, source, out, ckpt, available_now=True):
        q.awaitTermination(120)
    part = small_model.replace(claims=first)
    _same(_rows(read_view(spark, out, "vw_region_kpi")), _rows(views.v2_region_kpi(part)))

    second.write.mode("append").parquet(source)
    for q in start_view_refresh(spark, source, out, ckpt, available_now=True):
        q.awaitTermination(120)
    _same(_rows(read_view(spark, out, "vw_region_kpi")), _rows(views.v2_region_kpi(small_model)))
    _same(_rows(read_view(spark, out, "vw_monthly_kpi")), _rows(views.v1_monthly_kpi(small_model)))
    claims.unpersist()


def test_readers_skip_uncommitted_versions(spark, small_model, tmp_path):
    import os

    source, out, ckpt = str(tmp_path / "in"), str(tmp_path / "views"), str(tmp_path / "ck")
    small_model.claims.write.parquet(source)
    for q in start_view_refresh(spark, source, out, ckpt, available_now=True):
        q.awaitTermination(120)
    # a later version written but not committed yet
    small_model.claims.limit(3).write.parquet(os.path.join(out, "vw_region_kpi", "slot=3"))
    got = read_view(spark, out, "vw_region_kpi")
    assert "region" in got.columns and got.count() == views.v2_region_kpi(small_model).count()
