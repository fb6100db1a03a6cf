"""Load sets: replays, failures half-way, clashes, corrections, deletions, and the views kept with them."""

from __future__ import annotations

import pytest
from conftest import D, claim, make_model, provider
from pyspark.sql import functions as F

from claimlens import schemas as S
from claimlens.operators.key_filter import BITS_PER_KEY, SLICE_WORDS, arriving_clashes, build_filters, filter_words, key_bucket, suspected
from claimlens.plans import loads, views
from claimlens.sources.load_set import LoadSet


def rows(df):
    return sorted(map(str, df.drop("created_at").collect()))


def same(a, b):
    return all(rows(x) == rows(y) for x, y in zip(a.tables().values(), b.tables().values()))


def recomputed(model):
    return {name: rows(fn(model)) for name, fn in views.VIEWS.items()}


def kept(store):
    return {name: rows(df) for name, df in store.views().items()}


def close(a, b):
    return a.keys() == b.keys() and all(a[k] == b[k] for k in a)


@pytest.fixture
def store(spark, tmp_path):
    return LoadSet(spark, str(tmp_path / "set"), buckets=4)


def parts(model, chosen):
    return {t: model.tables()[t].filter(chosen) for t in ("claims", "claim_medical_codes", "claim_injuries")}


def test_replayed_batches_change_nothing(spark, store, small_model):
    assert store.read().claims.count() == 0
    v = store.reload("all", small_model.replace(**parts(small_model, F.col("claim_id") % 2 == 0)))
    again = store.reload("all", small_model)
    assert v == again == 1
    batch = parts(small_model, F.col("claim_id") % 2 == 1)
    assert store.insert("odd", batch) == 2 and same(store.read(), small_model)
    files = {t: store.files(t) for t in S.TABLE_NAMES}
    assert store.insert("odd", batch) == 2 and files == {t: store.files(t) for t in S.TABLE_NAMES}
    # The same rows under another id are known by their keys.
    assert store.insert("odd again", batch) == 3 and same(store.read(), small_model)
    told = {(r["batch_id"], r["table_name"]): r for r in store.report().collect()}
    for t, df in batch.items():
        assert told["odd", t]["inserted"] == told["odd again", t]["repeated"] == df.count()
        assert told["odd again", t]["inserted"] == 0
    assert close(kept(store), recomputed(small_model))


def test_a_reload_that_fails_is_never_seen(spark, store, small_model):
    """The job fails at the fourth table: readers have the old six, and the batch can be loaded again."""
    half = small_model.replace(**parts(small_model, F.col("claim_id") % 2 == 0))
    store.reload("half", half)
    broken = small_model.claim_medical_codes.withColumn("code_role", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.reload("whole", small_model.replace(claim_medical_codes=broken))
    assert same(store.read(), half) and close(kept(store), recomputed(half))
    with pytest.raises(Exception, match="lost"):
        store.insert("more", {"claims": small_model.claims, "claim_medical_codes": broken})
    assert same(store.read(), half) and [c["batch_id"] for c in store.commits()] == ["half"]
    store.reload("whole", small_model)
    assert same(store.read(), small_model) and same(store.read(version=1), half)


def test_clashing_repeated_and_nameless_rows(spark, store):
    model = make_model(spark, providers=[provider(1)], claims=[claim(i, D(2024, 1, i)) for i in range(1, 6)])
    store.reload("base", model)
    batch = [claim(1, D(2024, 1, 1)), claim(2, D(2024, 2, 2)), claim(7, D(2024, 1, 7)), claim(7, D(2024, 1, 7)), claim(8, D(2024, 1, 8)),
             claim(8, D(2024, 1, 9)), claim(None, D(2024, 1, 1)), claim(None, D(2024, 1, 1))]
    store.insert("more", {"claims": make_model(spark, claims=batch).claims})
    r, = store.report().collect()
    assert (r["arrived"], r["inserted"], r["repeated"], r["clashed"], r["rejected"]) == (8, 2, 2, 2, 2)
    assert sorted(r["claim_id"] for r in store.read().claims.collect()) == [1, 2, 3, 4, 5, 7, 8]
    aside = store.rejected("more", "claims").collect()
    assert sorted((x["claim_id"] or 0, x["reason"]) for x in aside) == [(0, "no key"), (2, "clash"), (8, "clash")]
    assert store.read().claims.filter("claim_id = 2").first()["received_date"] == D(2024, 1, 2)


def test_many_small_batches(spark, store):
    """Filters of several parts are all asked."""
    model = make_model(spark, providers=[provider(1)])
    store.reload("none", model)
    for k in range(3):
        store.insert(f"b{k}", {"claims": make_model(spark, claims=[claim(i, D(2024, 1, 1)) for i in range(10 * k, 10 * k + 15)]).claims})
    assert store.read().claims.count() == 35
    assert [r["inserted"] for r in store.report().orderBy("batch_id").collect()] == [15, 10, 10]


def test_views_follow_corrections_and_deletions(spark, store):
    def closed(i, month, decision, amount, **kw):
        return claim(i, D(2024, month, 3), "Closed", decision, D(2024, month + 1, 5), amount=amount, **kw)

    base = [closed(1, 1, "Approved", 100, region="Oslo"), closed(2, 1, "Rejected", 0, region="Viken", provider_id=2),
            closed(3, 5, "PartiallyApproved", 50.5, region="Troms", provider_id=3), claim(4, D(2024, 2, 1), region="Oslo")]
    providers = [provider(i, region="Oslo") for i in (1, 2, 3, 4)]
    codes = [{"claim_id": i, "medical_code_id": 5, "code_role": "Primary", "created_at": None} for i in (1, 2, 3, 4)]
    store.reload("base", make_model(spark, providers=providers, claims=base, claim_medical_codes=codes))
    newer = [closed(4, 2, "Approved", 7, region="Viken", provider_id=2), closed(1, 1, "Rejected", 0, region=None), closed(99, 1, "Approved", 1)]
    store.correct("newer", make_model(spark, claims=newer).claims)
    now = [newer[1], base[1], base[2], newer[0]]
    want = make_model(spark, providers=providers, claims=now, claim_medical_codes=codes)
    assert rows(store.read().claims) == rows(want.claims) and close(kept(store), recomputed(want))
    assert "Oslo" not in {r["region"] for r in store.views()["vw_region_kpi"].collect()}  # its last claims went
    store.delete("gone", spark.createDataFrame([(3,), (2,), (1234,), (None,)], "claim_id long"))
    want = make_model(spark, providers=providers, claims=[newer[1], newer[0]], claim_medical_codes=[codes[0], codes[3]])
    assert same(store.read(), want) and close(kept(store), recomputed(want))
    assert store.delete("gone", spark.createDataFrame([(1,)], "claim_id long")) == 3  # a replay
    assert store.read().claims.count() == 2


def test_deletion_rewrites_only_the_buckets_it_touches(spark, tmp_path, small_model):
    store = LoadSet(spark, str(tmp_path / "set"), buckets=16)
    store.reload("all", small_model)
    ids = small_model.claims.orderBy("claim_id").limit(3).select("claim_id")
    before = {t: set(store.files(t)) for t in S.TABLE_NAMES}
    store.delete("three", ids)
    hit = {r["b"] for r in ids.select(F.pmod(F.xxhash64("claim_id"), F.lit(16)).alias("b")).collect()}
    assert 1 <= len(hit) <= 3
    for t in S.TABLE_NAMES:
        after = set(store.files(t))
        gone = {f.split("bucket=")[1].split("/")[0] for f in before[t] - after}
        if t in ("claims", "claim_medical_codes", "claim_injuries"):
            assert gone == {str(b) for b in hit} and len(before[t] & after) >= 13
            left = small_model.tables()[t].join(ids, "claim_id", "left_anti")
            assert rows(store.read().tables()[t]) == rows(left)
        else:
            assert after == before[t]


def test_filters_rule_out_nearly_all_other_keys(spark):
    """No key of history is missed; of others about one in a hundred is suspected."""
    keys, buckets = ["a", "b"], 4
    history = spark.range(40_000).select(F.col("id").alias("a"), F.concat(F.lit("x"), F.col("id") % 7).alias("b"))
    placed = history.withColumn("bucket", key_bucket(keys, buckets))
    filters = build_filters(placed, keys, "bucket", buckets, filter_words(11_000)).cache()
    assert filters.count() == buckets and filters.selectExpr("max(size(words))").first()[0] == filter_words(11_000) >= 11_000 * BITS_PER_KEY // 64
    assert suspected(placed, keys, "bucket", filters).count() == 40_000
    others = spark.range(40_000, 140_000).select(F.col("id").alias("a"), F.concat(F.lit("x"), F.col("id") % 7).alias("b")).withColumn(
        "bucket", key_bucket(keys, buckets))
    rate = suspected(others, keys, "bucket", filters).count() / 100_000
    assert rate < 0.02


def test_large_filters_lie_in_slices(spark):
    """However many keys a bucket has, no row of its filter is larger than a slice, and no joined row carries one."""
    def placed(a, b):
        return spark.range(a, b).select(F.col("id").alias("k"), F.lit(0).alias("bucket"))

    large = build_filters(placed(0, 60_000), ["k"], "bucket", 1, 4 * SLICE_WORDS)
    small = build_filters(placed(60_000, 61_000), ["k"], "bucket", 1, filter_words(1_000))
    assert [(r["slice"], r["n"]) for r in large.selectExpr("slice", "size(words) AS n").orderBy("slice").collect()] == [(i, SLICE_WORDS) for i in range(4)]
    filters = large.unionByName(small).cache()
    assert suspected(placed(0, 61_000), ["k"], "bucket", filters).count() == 61_000
    found = suspected(placed(61_000, 161_000), ["k"], "bucket", filters)
    assert found.count() < 4_000 and found.columns == ["k", "bucket"]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "LeftSemi" in plan and "exists(" not in plan


def test_arriving_clashes_leave_history_where_it_is(spark, tmp_path):
    history = spark.range(5_000).selectExpr("id AS k", "id % 3 AS v")
    history.write.parquet(str(tmp_path / "h"))
    history = spark.read.parquet(str(tmp_path / "h"))
    filters = build_filters(history.withColumn("bucket", key_bucket(["k"], 4)), ["k"], "bucket", 4, filter_words(2_000))
    batch = spark.createDataFrame([(4_999,), (5_000,), (5_000,), (5_001,), (None,), (None,), (17,), (17,)], "k long")
    inside, known = arriving_clashes(batch, history, ["k"], filters, 4)
    assert sorted((r["k"], r["copies"]) for r in inside.collect()) == [(17, 2), (5_000, 2)]
    assert sorted(r["k"] for r in known.collect()) == [17, 4_999]
    plan = known._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # Only the few rows that matched are shuffled (for the distinct), never history itself.
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_sets_and_batches(spark, store, small_model):
    empty = small_model.replace(**{t: df.limit(0) for t, df in small_model.tables().items()})
    store.reload("empty", empty)
    store.insert("nothing", {"claims": small_model.claims.limit(0)})
    assert all(df.count() == 0 for df in store.read().tables().values())
    assert all(df.count() == 0 for df in store.views().values())
    store.delete("nobody", spark.createDataFrame([], "claim_id long"))
    store.correct("none", small_model.claims.limit(5))
    assert store.read().claims.count() == 0
    store.insert("some", {"claims": small_model.claims})
    assert rows(store.read().claims) == rows(small_model.claims)


def test_filter_words_are_sorted_without_a_function(spark):
    """``array_sort`` calls a comparing function for every two words of a slice; ``sort_array`` doesn't."""
    filters = build_filters(spark.range(100).withColumn("bucket", F.lit(0)), ["id"], "bucket", 1, 16)
    assert "lambda" not in filters._jdf.queryExecution().optimizedPlan().toString()
    assert [len(r["words"]) for r in filters.collect()] == [16]


def test_cascade_stores_only_the_claims_beside_its_set(spark, small_model, monkeypatch):
    """The bridges are read once, so they go straight into the set."""
    written = []
    monkeypatch.setattr(loads, "stored", lambda df, what: written.append(what) or df)
    left = {r[0]: r[1] for r in loads.c_cascade_written(small_model).collect()}
    gone = small_model.claims.filter("decision = 'Rejected'").select("claim_id")
    assert written == ["rest-claims"]
    for t in ("claims", "claim_medical_codes", "claim_injuries"):
        assert left[t] == small_model.tables()[t].join(gone, "claim_id", "left_anti").count()


def test_filters_hold_every_word_and_shuffle_no_blank_ones(spark):
    """A key travels as two numbers; words and filters without a key are made where the filter is listed."""
    rows = spark.createDataFrame([(i, i % 2) for i in range(40)], "k long, bucket int")
    filters = build_filters(rows, ["k"], "bucket", 3, 4 * SLICE_WORDS)
    plan = filters._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and f"Range (0, {3 * 4}," in plan
    found = filters.collect()
    assert sorted((r["bucket"], r["slice"]) for r in found) == [(b, s) for b in range(3) for s in range(4)]
    assert all(len(r["words"]) == SLICE_WORDS for r in found)
    marked = {b: sum(w != 0 for r in found if r["bucket"] == b for w in r["words"]) for b in range(3)}
    assert 0 < marked[0] <= 20 and 0 < marked[1] <= 20 and marked[2] == 0
    assert suspected(rows, ["k"], "bucket", filters).count() == 40


def test_sums_are_kept_while_bridges_are_written(spark, store, small_model, monkeypatch):
    """The claims' sums don't wait for the bridges."""
    done, sums = [], store._sums
    monkeypatch.setattr(store, "_sums", lambda *a, **kw: (sums(*a, **kw), done.append("sums"))[0])
    together = store._together
    monkeypatch.setattr(store, "_together", lambda write, tables: (together(write, tables), done.append(len(list(tables))))[0])
    store.reload("all", small_model)
    assert done == [3, "sums", 6] and close(kept(store), recomputed(small_model))
