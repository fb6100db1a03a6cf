"""The derived claims model: sizes, schemas and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import schemas as S
from claimlens.sources import tpch

# Sizes at sf0.001 (orders 1,500; supplier 10; part 200).
EXPECTED = {
    "providers": 10, "claims": 1500, "medical_codes": 200,
    "claim_medical_codes": 5942, "injury_types": 16, "claim_injuries": 5327,
}


def test_sizes(small_model):
    for name, df in small_model.tables().items():
        assert df.count() == EXPECTED[name], name


def test_schemas(small_model):
    for name, df in small_model.tables().items():
        got = [(f.name, f.dataType) for f in df.schema.fields]
        want = [(f.name, f.dataType) for f in S.SCHEMAS[name].fields]
        assert got == want, name


def test_last_provider_has_no_claims(small_model):
    used = {r.provider_id for r in small_model.claims.select("provider_id").distinct().collect()}
    ids = sorted(r.provider_id for r in small_model.providers.collect())
    assert ids[-1] not in used
    assert set(ids[:-1]) == used


def test_one_primary_code_per_claim(small_model):
    primaries = (small_model.claim_medical_codes.filter(F.col("code_role") == "Primary")
                 .groupBy("claim_id").count())
    assert primaries.filter("count <> 1").count() == 0
    claims_with_codes = small_model.claim_medical_codes.select("claim_id").distinct().count()
    assert primaries.count() == claims_with_codes


def test_model_roundtrip(spark, small_model, tmp_path):
    path = str(tmp_path / "model")
    stored = small_model.materialize(path)
    for name, df in stored.tables().items():
        assert df.count() == EXPECTED[name]
        assert df.exceptAll(small_model.tables()[name]).count() == 0, name


def test_publish_views_registers_and_extracts(spark, small_model, tmp_path):
    from claimlens.plans.views import publish_views, v2_region_kpi

    out = publish_views(spark, small_model, str(tmp_path / "extract"))
    assert set(out) == {"vw_monthly_kpi", "vw_region_kpi", "vw_provider_summary"}
    assert spark.table("vw_region_kpi").count() == v2_region_kpi(small_model).count()
    extract = spark.read.parquet(str(tmp_path / "extract" / "vw_provider_summary"))
    assert extract.count() == 10 and "approval_rate_closed" in extract.columns
    small_model.register(prefix="t_")
    assert spark.sql("SELECT COUNT(*) AS n FROM t_claims").collect()[0].n == 1500


def test_table_profile(small_model):
    from claimlens.operators import table_profile

    prof = table_profile(
        {"claims": small_model.claims, "injury_types": small_model.injury_types},
        distinct={"claims": ["provider_id", "region"]},
    ).collect()
    got = {(r.table_name, r.column_name): (r.row_count, r.distinct_count) for r in prof}
    assert got[("claims", "provider_id")] == (1500, 9)
    assert got[("claims", "region")][0] == 1500 and got[("claims", "region")][1] <= 13
    assert got[("injury_types", None)] == (16, None)


def test_cluster_conf_sizes_partitions_in_whole_waves():
    from claimlens.session import cluster_conf

    conf = cluster_conf(largest_shuffle_bytes=10 * 2**40, total_cores=8000)  # a 10 TiB shuffle
    parts = int(conf["spark.sql.shuffle.partitions"])
    assert parts % 8000 == 0 and parts * (200 << 20) >= 10 * 2**40
    small = cluster_conf(largest_shuffle_bytes=1 << 20, total_cores=8)
    assert small["spark.sql.shuffle.partitions"] == "8"


def test_shared_dir_never_falls_back_silently():
    import pytest as _pytest

    from claimlens.session import shared_dir

    class _Conf:
        def get(self, key, default=None):
            return default

    class _Context:
        def getConf(self):
            return _Conf()

    class _Session:  # a cluster session without spark.checkpoint.dir
        conf = _Conf()
        sparkContext = _Context()

    with _pytest.raises(RuntimeError, match="spark.checkpoint.dir is not set"):
        shared_dir(_Session())


def test_local_runs_share_one_folder_without_the_setting():
    """The setting can't be changed in a running session, so the chosen folder is kept beside it."""
    from claimlens.session import shared_dir

    class _Conf:
        def get(self, key, default=None):
            return default

    class _Context:
        def __init__(self, app):
            self.applicationId = app

        def getConf(self):
            return _Conf()

        def setCheckpointDir(self, path):
            self.path = path

    class _Session:
        conf = _Conf()

        def __init__(self, app):
            self.sparkContext = _Context(app)

    first, again, other = (shared_dir(_Session(a), create_local=True) for a in ("one", "one", "two"))
    assert first == again != other


def test_many_lines_are_dealt_by_their_number(spark, monkeypatch):
    """Each task gets about LINES_PER_TASK lines, whatever their bytes; the pairs are the same."""
    rows = [(i % 40, i % 7) for i in range(300)] + [(None, 1), (None, 1), (3, None), (None, None)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long")
    for make in (tpch.claim_medical_codes, tpch.claim_injuries):
        plain = make(lines)
        monkeypatch.setattr(tpch, "LINES_PER_TASK", 10)
        monkeypatch.setattr(tpch, "PLAIN_LINES", 100)
        dealt = make(lines, len(rows))
        assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
        plan = dealt.select("claim_id")._jdf.queryExecution().executedPlan().toString()
        assert ", 31), REPARTITION_BY_NUM" in plan


def test_bridges_move_their_lines_once(spark, monkeypatch):
    """Pairs aren't moved again for the first of their claim, and a claim's injuries are one row; rows with
    NULLs and negative keys are as by the definition."""
    rows = [(i % 40, i * 7 % 90 - 30) for i in range(300)] + [(None, 1), (None, 1), (None, -3), (3, None), (90, None), (90, None), (None, None)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long")
    monkeypatch.setattr(tpch, "PLAIN_LINES", 100)

    def expected(item):
        pairs = {(k, item(p)) for k, p in rows}
        least = {}
        for k, v in pairs:
            if k is not None and v is not None:
                least[k] = min(v, least.get(k, v))
        return {(k, v, None if k is None or v is None else v == least[k]) for k, v in pairs}

    def remainder(p):
        return None if p is None else 1 + (p % 16 if p >= 0 else -(-p % 16))

    codes, injuries = tpch.claim_medical_codes(lines, len(rows)), tpch.claim_injuries(lines, len(rows))
    want = expected(lambda p: p)
    assert sorted(map(str, codes.select("claim_id", "medical_code_id", "code_role").collect())) == sorted(
        str(r) for r in spark.createDataFrame([(k, v, "Primary" if f else "Secondary") for k, v, f in want],
                                              "claim_id long, medical_code_id long, code_role string").collect())
    assert injuries.count() == len(expected(remainder))
    assert {tuple(r) for r in injuries.select("claim_id", "injury_type_id", "is_primary").collect()} == expected(remainder)
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "ShuffledHashJoin [claim_id#" in plan and "SortMergeJoin" not in plan
    plan = injuries._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
