"""Reports over a load set: what is there after reloads, replayed and clashing batches, corrections and deletions.

Each report builds a set of its own in the shared folder from the whole model and reads it back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import schemas as S
from claimlens.operators import row_counts
from claimlens.operators.key_filter import arriving_clashes, build_filters, filter_words, key_bucket
from claimlens.session import shared_path, stored
from claimlens.sources.load_set import BRIDGES, LoadSet
from claimlens.sources.model import ClaimsModel

c = F.col


def new_set(m: ClaimsModel, buckets: int = 8) -> LoadSet:
    local = m.spark.sparkContext.master.partition("[")[0] == "local"
    return LoadSet(m.spark, shared_path(m.spark, f"load-set-{uuid.uuid4().hex}", create_local=local), buckets)


def _at_rest(m: ClaimsModel, tables: Iterable[str] = S.TABLE_NAMES) -> ClaimsModel:
    """The model with these tables written once, as several batches are cut from them."""
    with ThreadPoolExecutor(len(S.TABLE_NAMES)) as pool:
        return m.replace(**dict(zip(tables, pool.map(lambda t: stored(m.tables()[t], f"rest-{t}"), tables))))


def _claims_of(m: ClaimsModel, chosen: Column) -> dict[str, DataFrame]:
    return {t: m.tables()[t].filter(chosen) for t in ("claims", *BRIDGES)}


def l_load_replayed(m: ClaimsModel) -> DataFrame:
    """A quarter of the claims reloaded; a batch loaded, the same batch again, a batch half of old rows, and one with
    repeated, clashing and nameless rows: what each did, and the rows stored in the end."""
    m = _at_rest(m)
    part, store = c("claim_id") % 4, new_set(m)
    store.reload("base", m.replace(**_claims_of(m, part == 0)))
    store.insert("a", _claims_of(m, part == 1))
    store.insert("a", _claims_of(m, part == 1))
    store.insert("b", _claims_of(m, part.isin(1, 2)))
    last = m.claims.filter(part == 3)
    other_amount = m.claims.filter(c("claim_id") % 20 == 0).withColumn("claim_amount_nok", (c("claim_amount_nok") + 1).cast("decimal(12,2)"))
    nameless = m.claims.filter(c("claim_id") % 50 == 7).withColumn("claim_id", F.lit(None).cast("long"))
    store.insert("c", {"claims": last.unionByName(last.filter(c("claim_id") % 10 == 3)).unionByName(other_amount).unionByName(nameless)})
    model = store.read()
    rows = [
        df.agg(F.count(F.lit(1)).alias("arrived")).select(
            F.lit("stored").alias("batch_id"), F.lit(t).alias("table_name"), "arrived",
            df.select(*S.PRIMARY_KEYS[t]).distinct().select(F.count(F.lit(1))).scalar().alias("inserted"),
            *[F.lit(0).cast("long").alias(n) for n in ("repeated", "clashed", "rejected")])
        for t, df in model.tables().items() if t in ("claims", *BRIDGES)
    ]
    out = store.report()
    for r in rows:
        out = out.unionByName(r)
    return out


def l_reloaded_rows(m: ClaimsModel) -> DataFrame:
    """Rows of the six tables after a load of half the claims, a reload of all, and the first load's replay."""
    m = _at_rest(m)
    store = new_set(m)
    half = m.replace(**_claims_of(m, c("claim_id") % 2 == 0))
    store.reload("first", half)
    store.reload("second", m)
    store.reload("first", half)
    return row_counts(store.read().tables()).orderBy("table_name")


#: Key sets of ``k_arriving_keys``: table, keys, and the column whose remainder deals rows to history and batch.
ARRIVING = [
    ("claims", ["claim_id"], "claim_id"), ("claims", ["claim_reference"], "claim_id"),
    ("medical_codes", ["code_system", "code"], "medical_code_id"), ("claim_medical_codes", ["claim_id", "medical_code_id"], "claim_id"),
]


def k_arriving_keys(m: ClaimsModel, buckets: int = 8) -> DataFrame:
    """Key clashes of an arriving batch, in itself and with history, which is only read through its stored key
    filters and for suspected keys. A tenth of the rows arrives, some twice, with a tenth that history has."""
    m = _at_rest(m, sorted({table for table, *_ in ARRIVING}))
    frames, histories = [], {}
    for table, keys, dealt in ARRIVING:
        rows = m.tables()[table]
        if table not in histories:
            histories[table] = stored(rows.filter(c(dealt) % 10 != 3), f"history-{table}")
        history = histories[table]
        batch = rows.filter((c(dealt) % 10).isin(3, 4)).unionByName(rows.filter(c(dealt) % 30 == 3))
        placed = history.dropna(subset=keys).withColumn("__bucket", key_bucket(keys, buckets))
        most = placed.groupBy("__bucket").count().agg(F.max("count")).first()[0] or 1
        filters = stored(build_filters(placed, keys, "__bucket", buckets, filter_words(most)), f"filters-{table}")
        inside, known = arriving_clashes(batch, history, keys, filters, buckets)
        frames.append(inside.agg(F.count(F.lit(1)).alias("batch_clashes")).select(
            F.lit(table).alias("table_name"), F.lit("_".join(keys)).alias("rule"), "batch_clashes",
            known.select(F.count(F.lit(1))).scalar().alias("history_clashes")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def corrected_claims(claims: DataFrame) -> DataFrame:
    """Newer versions of some claims, for the maintained views: closed after thirty days."""
    return claims.filter(c("claim_id") % 7 == 3).withColumns({
        "status": F.lit("Closed"), "decision": F.lit("PartiallyApproved"), "decision_date": F.date_add("received_date", 30),
        "claim_amount_nok": F.lit("1000.00").cast("decimal(12,2)")})


def v_maintained_views(m: ClaimsModel) -> DataFrame:
    """The three views from sums that were kept through a load, an insert, a correction and a deletion."""
    m = _at_rest(m, ["claims", "providers"])
    store, part = new_set(m), c("claim_id") % 3
    bare = m.replace(**{t: m.tables()[t].limit(0) for t in BRIDGES})
    store.reload("base", bare.replace(claims=m.claims.filter(part != 0)))
    store.insert("rest", {"claims": m.claims.filter(part == 0)})
    store.correct("newer", corrected_claims(m.claims))
    store.delete("gone", m.claims.filter(c("claim_id") % 11 == 5).select("claim_id"))
    views = store.views()
    keys = {"vw_monthly_kpi": "month_start_date", "vw_region_kpi": "region", "vw_provider_summary": "provider_id"}
    frames = [
        df.select(
            F.lit(name).alias("view_name"), c(keys[name]).cast("string").alias("group_key"),
            c("claims_received" if name == "vw_monthly_kpi" else "total_claims").alias("claims"), "closed_claims", "approval_rate_closed",
            "total_payout_nok", "avg_processing_days_closed")
        for name, df in views.items()
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def c_cascade_written(m: ClaimsModel) -> DataFrame:
    """Row counts left after every Rejected claim was deleted from a stored set, with its bridge rows."""
    m = _at_rest(m, ["claims"])  # read twice; the other tables go straight into the set
    store = new_set(m)
    store.reload("base", m)
    store.delete("purge", m.claims.filter(c("decision") == "Rejected").select("claim_id"))
    after = store.read().tables()
    return row_counts({t: after[t] for t in ("claims", *BRIDGES)})
