"""Synthetic claims data, generated as a Spark job at any size.

Randomness is a hash, not a random stream: a draw is 8 hex digits of
``md5("<seed>:<id>:<salt>")`` / 2^32, and one digest yields four draws (hex
digits 1-8, 9-16, 17-24, 25-32). A row's values therefore depend only on its
id, never on partitioning, task order or retries (a lost executor recomputes
identical rows), and any SQL engine with ``md5`` can reproduce them. Digests
are computed in their own projection, once per row and salt group; Spark
does not collapse a projection when that would repeat a costly expression.

Tables:

* ``providers`` (13 regions x 3), ``medical_codes`` (4 systems x 21),
  ``injury_types`` (16): small fixed dimensions from ``spark.range``.
* ``claims``: one row per id of an id column (``spark.range`` or any table's
  key), map-only.
* the two bridges: each claim samples k active codes / injury types without
  replacement. The sorted active ids travel as one array (a scalar subquery
  over the dimension, whose size is fixed by construction); the first k steps
  of a Fisher-Yates shuffle of that array, unrolled into ``element_at`` and
  CASE expressions, pick a uniformly random k-subset in random order from k
  draws per claim. Map-only, no join, no per-claim LIMIT, no lambda.

``draws="chained"`` reproduces the source generator, where every ``WHEN
random() < t`` of a CASE takes a fresh draw (so thresholds act as
conditional probabilities); ``draws="cumulative"`` uses one draw per CASE
(thresholds act as cumulative shares).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens import schemas as S
from claimlens.functions import padded, pick
from claimlens.sources.model import ClaimsModel

# ---------------------------------------------------------------------------
# Fixed values of the source generator (shares, sizes, name patterns).
N_CLAIMS = 1200
PROVIDERS_PER_REGION = 3
CODES_PER_SYSTEM = 21
N_INJURY_TYPES = 16
PROVIDER_ACTIVE_SHARE = 0.92
CODE_ACTIVE_SHARE = 0.95
RECEIVED_WINDOW_DAYS = 1096
DECISION_MAX_DAYS = 180
STATUS_DRAWS = [("Closed", 0.70), ("InReview", 0.90), ("Received", None)]
AGE_SPAN = 91
SEX_DRAWS = [("M", 0.49), ("F", 0.98), ("X", 0.99), ("U", None)]
CARE_DRAWS = [("Primary", 0.55), ("Specialist", 0.85), ("Hospital", None)]
REGION_DRAWS = [
    ("Oslo", 0.18), ("Viken", 0.38), ("Vestland", 0.50), ("Rogaland", 0.60),
    ("Trondelag", 0.69), ("Innlandet", 0.76), ("Agder", 0.82), ("MoreOgRomsdal", 0.87),
    ("Nordland", 0.91), ("Telemark", 0.94), ("Troms", 0.97), ("Finnmark", 0.985), ("Other", None),
]
DECISION_DRAWS = [("Approved", 0.55), ("Rejected", 0.85), ("PartiallyApproved", None)]
AMOUNT_SMALL_SHARE = 0.95
AMOUNT_SMALL_SCALE = 250000.0
AMOUNT_LARGE_BASE = 250000.0
AMOUNT_LARGE_SPAN = 1750000.0
PROVIDER_NAME_WORD = {
    "Hospital": "Hospital", "Clinic": "Clinic", "GP": "GP Center", "Specialist": "Specialist",
}
PROVIDER_NAME_DEFAULT = "Provider"
CODE_SYSTEM_ORDER = ["ICD10", "NCSP", "ICPC2", "Other"]
CODE_PREFIX = {"ICD10": "I", "NCSP": "N", "ICPC2": "P", "Other": "O"}
CODE_TITLE = {
    "ICD10": "ICD10 demo diagnosis ", "NCSP": "NCSP demo procedure ",
    "ICPC2": "ICPC2 demo primary care code ", "Other": "Other demo code ",
}
# ---------------------------------------------------------------------------

DEFAULT_SEED = 4242
DEFAULT_AS_OF = dt.date(2024, 12, 31)
REFERENCE_WIDTH = 10  # least claim_reference digits; longer ids stay whole


SLOTS = 4  # uniforms per md5 digest


def digest(seed: int, row_id: Column, salt: str) -> Column:
    """Hex md5 of "<seed>:<id>:<salt>"."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string"), F.lit(f":{salt}")))


def from_digest(hex_digest: Column, slot: int) -> Column:
    """The ``slot``-th (0..3) uniform in [0, 1) of a digest."""
    return F.conv(F.substring(hex_digest, 8 * slot + 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform(seed: int, row_id: Column, salt: str) -> Column:
    """A single deterministic U[0,1) from (seed, id, salt)."""
    return from_digest(digest(seed, row_id, salt), 0)


def digest_groups(salt: str, n_draws: int) -> list[str]:
    """Salt groups whose digests hold ``n_draws`` draws."""
    return [f"{salt}:{g}" for g in range(-(-n_draws // SLOTS))]


def draw_u(salt: str, i: int) -> Column:
    """The i-th (0-based) draw of ``salt`` from the projected digest columns."""
    return from_digest(F.col(f"_d_{salt}:{i // SLOTS}"), i % SLOTS)


def draw(choices: Sequence[tuple[str, float | None]], salt: str, draws: str = "chained") -> Column:
    """CASE WHEN u < t1 THEN v1 WHEN u < t2 THEN v2 ... ELSE v_last.

    ``chained``: every WHEN takes a fresh draw; ``cumulative``: one draw.
    Reads the digest columns of ``salt`` (see :func:`_with_digests`).
    """
    out = F.lit(choices[-1][0])
    for i in range(len(choices) - 2, -1, -1):
        value, threshold = choices[i]
        u = draw_u(salt, i if draws == "chained" else 0)
        out = F.when(u < threshold, value).otherwise(out)
    return out


# Draws of one claim: (salt, number of draws).
CLAIM_DRAWS = [
    ("misc", 7), ("status", len(STATUS_DRAWS) - 1), ("sex", len(SEX_DRAWS) - 1),
    ("care", len(CARE_DRAWS) - 1), ("region", len(REGION_DRAWS) - 1), ("decision", len(DECISION_DRAWS) - 1),
]
# Slots of the "misc" salt.
MISC = {"received": 0, "age": 1, "decision_days": 2, "amount_kind": 3, "amount_a": 4, "amount_b": 5,
        "amount_c": 6}


def _with_digests(df: DataFrame, seed: int, row_id: str, plan: Sequence[tuple[str, int]]) -> DataFrame:
    cols = [digest(seed, F.col(row_id), g).alias(f"_d_{g}") for salt, n in plan for g in digest_groups(salt, n)]
    return df.select("*", *cols)


def _ts() -> Column:
    return F.lit("2000-01-01 00:00:00").cast(T.TimestampType())


def providers(spark: SparkSession, seed: int = DEFAULT_SEED) -> DataFrame:
    """13 regions x 3; type = sorted types[(seq - 1) % 5]; name from type, region, letter."""
    per = PROVIDERS_PER_REGION
    idx = F.col("id")  # 0-based row number in (region, seq) order
    region = pick((idx / per).cast("int"), S.REGIONS)
    seq = idx % per + 1
    ptype = pick((seq - 1) % len(S.PROVIDER_TYPES), sorted(S.PROVIDER_TYPES))
    word = F.lit(PROVIDER_NAME_DEFAULT)
    for t, w in PROVIDER_NAME_WORD.items():
        word = F.when(ptype == t, w).otherwise(word)
    pid = idx + 1
    return spark.range(0, len(S.REGIONS) * per, numPartitions=1).select(
        pid.alias("provider_id"),
        F.concat(region, F.lit(" "), word, F.lit(" "), F.chr(F.lit(64) + seq)).alias("provider_name"),
        F.concat(F.lit("NO"), padded(F.lit(100000000) + pid, 9)).alias("org_number"),
        ptype.alias("provider_type"),
        region.alias("region"),
        (uniform(seed, pid, "provider_active") < PROVIDER_ACTIVE_SHARE).alias("active"),
        _ts().alias("created_at"),
    )


def medical_codes(spark: SparkSession, seed: int = DEFAULT_SEED) -> DataFrame:
    """4 systems x 21 formatted codes and titles."""
    per = CODES_PER_SYSTEM
    idx = F.col("id")
    system = pick((idx / per).cast("int"), CODE_SYSTEM_ORDER)
    seq = idx % per + 1
    seq_s = seq.cast("string")
    prefix = {k: F.lit(v) for k, v in CODE_PREFIX.items()}
    code = (
        F.when(system == "ICD10", F.concat(prefix["ICD10"], F.lpad(seq_s, 2, "0"), F.lit("."),
                                           F.lpad(((seq * 7) % 10).cast("string"), 1, "0")))
        .when(system == "NCSP", F.concat(prefix["NCSP"], F.lpad(seq_s, 3, "0")))
        .when(system == "ICPC2", F.concat(prefix["ICPC2"], F.lpad(seq_s, 2, "0")))
        .otherwise(F.concat(prefix["Other"], F.lpad(seq_s, 3, "0")))
    )
    title = F.lit(None).cast("string")
    for s_name, prefix in CODE_TITLE.items():
        title = F.when(system == s_name, F.concat(F.lit(prefix), seq_s)).otherwise(title)
    mid = idx + 1
    return spark.range(0, len(CODE_SYSTEM_ORDER) * per, numPartitions=1).select(
        mid.alias("medical_code_id"),
        system.alias("code_system"),
        code.alias("code"),
        title.alias("code_title"),
        (uniform(seed, mid, "code_active") < CODE_ACTIVE_SHARE).alias("active"),
        _ts().alias("created_at"),
    )


def injury_types(spark: SparkSession) -> DataFrame:
    """16 types; group cycles over the sorted groups; severity = 1 + (seq - 1) % 5."""
    seq = F.col("id")
    group = pick((seq - 1) % len(S.INJURY_GROUPS), sorted(S.INJURY_GROUPS))
    return spark.range(1, N_INJURY_TYPES + 1, numPartitions=1).select(
        seq.alias("injury_type_id"),
        group.alias("injury_group"),
        F.concat(group, F.lit(" issue "), seq.cast("string")).alias("injury_name"),
        (F.lit(1) + (seq - 1) % 5).cast(T.ShortType()).alias("severity"),
        F.lit(True).alias("active"),
        _ts().alias("created_at"),
    )


def claims(
    ids: DataFrame,
    n_providers: Column | int,
    seed: int = DEFAULT_SEED,
    as_of: dt.date = DEFAULT_AS_OF,
    draws: str = "chained",
    id_col: str = "seq",
) -> DataFrame:
    """One claim per id in ``ids[id_col]`` (ids >= 1); map-only.

    ``n_providers`` is the provider count; claims go round-robin over
    provider ids 1..n.
    """
    seq = F.col(id_col)
    u = lambda name: draw_u("misc", MISC[name])
    as_of_lit = F.lit(as_of)
    received = F.date_sub(as_of_lit, F.floor(u("received") * RECEIVED_WINDOW_DAYS).cast("int"))
    status = draw(STATUS_DRAWS, "status", draws)
    closed = status == "Closed"
    decision = draw(DECISION_DRAWS, "decision", draws)
    amount = F.when(
        u("amount_kind") < AMOUNT_SMALL_SHARE,
        u("amount_a") * u("amount_b") * F.lit(AMOUNT_SMALL_SCALE),
    ).otherwise(F.lit(AMOUNT_LARGE_BASE) + u("amount_c") * F.lit(AMOUNT_LARGE_SPAN))
    amount_t = S.CLAIMS["claim_amount_nok"].dataType
    n = n_providers if isinstance(n_providers, Column) else F.lit(n_providers)
    return _with_digests(ids.select(id_col), seed, id_col, CLAIM_DRAWS).select(
        seq.cast("bigint").alias("claim_id"),
        F.concat(F.lit("CLM-"), F.lit(as_of.strftime("%Y%m%d")), F.lit("-"),
                 padded(seq, REFERENCE_WIDTH)).alias("claim_reference"),
        F.floor(u("age") * AGE_SPAN).cast(T.ShortType()).alias("patient_age"),
        draw(SEX_DRAWS, "sex", draws).alias("patient_sex"),
        draw(REGION_DRAWS, "region", draws).alias("region"),
        received.alias("received_date"),
        F.when(closed, F.date_add(received, (F.lit(1) + F.floor(u("decision_days") * DECISION_MAX_DAYS))
                                  .cast("int"))).alias("decision_date"),
        status.alias("status"),
        F.when(closed, decision).alias("decision"),
        draw(CARE_DRAWS, "care", draws).alias("care_level"),
        F.when(closed & (decision != "Rejected"), amount.cast(amount_t))
        .otherwise(F.lit(0).cast(amount_t)).alias("claim_amount_nok"),
        ((seq - 1) % n + 1).cast("bigint").alias("provider_id"),
        _ts().alias("created_at"),
    )


def sample_per_claim(
    claims_df: DataFrame,
    dim: DataFrame,
    dim_key: str,
    k: Column,
    k_max: int,
    seed: int,
    salt: str,
) -> DataFrame:
    """For every claim, ``k`` (<= ``k_max`` <= 4) distinct active dimension ids
    with their 1-based pick order.

    Partial Fisher-Yates over the places 0..n-1 of the active ids in order: step
    j draws r_j = j + floor(u_j * (n - j)), takes A_j[r_j] and swaps it into
    place. Entries of A_j are expressions over the drawn places, so each pick is
    a CASE -- k draws from one digest per claim, no sort, no lambda. The places
    picked meet the ids by a join on the place, so the dimension may be of any
    size; the ids are numbered over the dimension's own rows only.
    """
    from claimlens.operators.numbering import number_rows

    active = number_rows(dim.filter(F.col("active")).select(dim_key), dim_key, name="_place")
    n_active = dim.select(F.count_if(F.col("active"))).scalar()
    n = F.col("_n")
    base = claims_df.select(
        "claim_id", k.alias("_k"), n_active.cast("long").alias("_n"), digest(seed, F.col("claim_id"), salt).alias("_d")
    )
    base = base.select("*", *[
        F.when(n > j, F.lit(j) + F.floor(from_digest(F.col("_d"), j) * (n - j)).cast("long")).alias(f"_r{j}")
        for j in range(k_max)
    ])

    def entry(j: int, x: Column) -> Column:
        # A_j[x] for x >= j; A_0 is every place itself
        if j == 0:
            return x
        return F.when(x == F.col(f"_r{j - 1}"), entry(j - 1, F.lit(j - 1).cast("long"))).otherwise(entry(j - 1, x))

    picks = [F.when(n > j, entry(j, F.col(f"_r{j}"))) for j in range(k_max)]
    chosen = F.slice(F.array(*picks), 1, F.least(F.col("_k"), n).cast("int"))
    drawn = base.select("claim_id", F.posexplode(chosen).alias("pos", "_picked"))
    return drawn.join(active, F.col("_picked") + 1 == F.col("_place")).select(
        "claim_id", dim_key, (F.col("pos") + 1).alias("pick_order")
    )


def claim_medical_codes(claims_df: DataFrame, codes: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """(claim_id % 3) + 1 codes per claim; the first pick is the Primary code."""
    k = (F.col("claim_id") % 3 + 1).cast("int")
    picks = sample_per_claim(claims_df, codes, "medical_code_id", k, 3, seed, "cmc")
    return picks.select(
        "claim_id", "medical_code_id",
        F.when(F.col("pick_order") == 1, "Primary").otherwise("Secondary").alias("code_role"),
        _ts().alias("created_at"),
    )


def claim_injuries(claims_df: DataFrame, injuries: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """(claim_id % 2) + 1 injury types per claim; the first pick is primary."""
    k = (F.col("claim_id") % 2 + 1).cast("int")
    picks = sample_per_claim(claims_df, injuries, "injury_type_id", k, 2, seed, "ci")
    return picks.select(
        "claim_id", "injury_type_id", (F.col("pick_order") == 1).alias("is_primary"), _ts().alias("created_at"),
    )


def generate_claims_model(
    spark: SparkSession,
    n: int = N_CLAIMS,
    seed: int = DEFAULT_SEED,
    as_of: dt.date = DEFAULT_AS_OF,
    draws: str = "chained",
    ids: DataFrame | None = None,
    num_partitions: int | None = None,
) -> ClaimsModel:
    """The six tables. Claim ids are ``1..n`` (``spark.range``) or the ``seq``
    column of ``ids``."""
    prov = providers(spark, seed)
    codes = medical_codes(spark, seed)
    inj = injury_types(spark)
    if ids is None:
        ids = spark.range(1, n + 1, numPartitions=num_partitions).withColumnRenamed("id", "seq")
    n_prov = prov.select(F.count(F.lit(1))).scalar()
    cl = claims(ids, n_prov, seed, as_of, draws)
    return ClaimsModel(
        providers=prov,
        claims=cl,
        medical_codes=codes,
        claim_medical_codes=claim_medical_codes(cl, codes, seed),
        injury_types=inj,
        claim_injuries=claim_injuries(cl, inj, seed),
    )


def generated_from_table(spark: SparkSession, ids: DataFrame, seed: int = DEFAULT_SEED,
                         as_of: dt.date = DEFAULT_AS_OF, draws: str = "chained") -> ClaimsModel:
    """Generate one synthetic claim (with its bridges) per row of ``ids``.

    ``ids`` holds a ``seq`` column of distinct ids >= 1, e.g. a table key
    shifted by one, so the generated volume follows that table.
    """
    return generate_claims_model(spark, seed=seed, as_of=as_of, draws=draws, ids=ids)


def orders_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys + 1 of the driver's ``orders`` table as generator ids."""
    from claimlens.sources.tpch import read_source

    return read_source(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("seq"))
