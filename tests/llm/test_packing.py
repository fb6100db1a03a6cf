import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from claimlens.llm import packing as P
from claimlens.llm.queries import RANKS, op7_best_fit_packing

SF = "/root/testdata/sf0.01"
RANKS_PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_tokenizers_library(plain, text):
    assert P.encoder(RANKS_PATH).encode_to_numpy(text, disallowed_special=()).tolist() == ids_of(plain, text)[:-1]


def check_packing(rows, texts, plain, longest):
    """Every document's ids come back from its pieces; every sequence is gapless and fits."""
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(texts)
    for d, own in by.items():
        ids, at = np.array(ids_of(plain, texts[d]), "<u4"), 0
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        for r in own:
            assert r.start == at and zlib.crc32(ids[at:at + r.length].tobytes()) == r.ids_crc32
            assert r.length == longest or r.piece == 0
            at += r.length
        assert at == len(ids) and (len(own) == 1 or len(own) == -(-at // longest))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= longest
    total = sum(n for parts in sequences.values() for _, n in parts)
    return len(sequences), -(-total // longest)


def test_query_round_trip_and_near_the_bound(spark, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    used, least = check_packing(op7_best_fit_packing(spark, SF).collect(), texts, plain, P.SEQUENCE)
    assert used <= least * 1.005


def test_odd_rows(spark, plain):
    texts = {1: None, 2: "", 3: "word " * 5_000, 4: "a" * 30_000, 5: "<|endoftext|> é 日本\n\t  x", 6: "tie", 7: "tie", 8: "tie"}
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in texts.items()], "doc_id long, text string, piece int, length string")
    check_packing(P.pack(df, RANKS_PATH, 64, bucket_rows=2).collect(), texts, plain, 64)
    twice = P.pack(df.unionAll(df), RANKS_PATH, 64, bucket_rows=3).collect()
    places = {(r.sequence_id, r.offset) for r in twice}
    assert len(places) == len(twice) == 2 * P.pack(df, RANKS_PATH, 64).count()
    assert P.pack(df.limit(0), RANKS_PATH).count() == 0
    assert {r.doc_id for r in P.pack(df.selectExpr("cast(null as long) doc_id", "text"), RANKS_PATH).collect()} == {None}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=21, max_size=21))
def test_plan_uses_exactly_the_histogram(counts):
    h = np.array([0, *counts[1:]])
    used = np.zeros(21, np.int64)
    plan = P.plan(h, 20)
    for config, n in plan.items():
        assert n > 0 and sum(s * m for s, m in config) <= 20
        for s, m in config:
            used[s] += m * n
    assert (used == h).all()
    places, seen = P.Places(plan, 20), set()
    for s in np.flatnonzero(h):
        sequence, offset = places.of(np.full(h[s], s), np.arange(h[s]))
        seen |= {(q, int(o) + i) for q, o in zip(sequence.tolist(), offset) for i in range(s)}
    assert len(seen) == int((h * np.arange(21)).sum())


def test_pricing_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(40):
        sizes = np.unique(rng.integers(1, 12, 4))
        prices = rng.random(len(sizes))
        chosen = P.best_configuration(sizes, prices, 12)
        worth = dict(zip(sizes.tolist(), prices))
        best = max(sum(n * p for n, p in zip(c, prices)) for c in product(range(13), repeat=len(sizes)) if (np.array(c) * sizes).sum() <= 12)
        assert abs(sum(worth[s] * m for s, m in chosen) - best) < 1e-9


def test_beats_best_fit_on_a_large_histogram():
    h = np.random.default_rng(6).integers(0, 400, 257)
    h[0] = h[256] = 0
    assert sum(P.plan(h, 256).values()) <= sum(P.best_fit(h, 256).values())


@pytest.mark.parametrize("run", [" ", "\n", "\t 　"])
def test_white_space_of_over_a_million_characters(spark, plain, run):
    long = run * (1_200_000 // len(run))
    texts = {1: f"before{long}after", 2: long, 3: f"a{long[:100_000]}'s{long[:99_999]}7", 4: "a text beside it"}
    encoder = P.encoder(RANKS_PATH)
    assert all(P.encode(encoder, t).tolist() == ids_of(plain, t)[:-1] for t in texts.values())
    if run == " ":
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        check_packing(P.pack(df, RANKS_PATH).collect(), texts, plain, P.SEQUENCE)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_near_the_bound(seed):
    """At most one sequence for each length more than the lower bound says, also where no configuration fills up."""
    rng = np.random.default_rng(seed)
    h = np.zeros(1025, np.int64)
    lengths = rng.choice(np.arange(40 if seed % 2 else 200, 700), int(rng.integers(3, 60 if seed % 3 else 12)), replace=False)
    h[lengths] = rng.integers(1, 3000, len(lengths))
    values, bound = P.solve(h, 1024)
    used = P.plan(h, 1024)
    packed = np.zeros(1025, np.int64)
    for config, n in used.items():
        assert sum(s * m for s, m in config) <= 1024
        for s, m in config:
            packed[s] += n * m
    assert (packed == h).all()
    assert sum(values.values()) <= bound * (1 + 1e-6) and len(values) <= len(lengths)
    assert sum(used.values()) <= np.ceil(bound - 1e-6) + len(lengths)


def test_configurations_that_leave_room_are_taken():
    h = np.zeros(1025, np.int64)
    h[[300, 350, 400, 520]] = 500
    values, bound = P.solve(h, 1024)
    assert sum(P.plan(h, 1024).values()) <= np.ceil(bound - 1e-6) + 4
    # Less by hundreds than best fit alone.
    h = np.zeros(1025, np.int64)
    h[[309, 322, 381, 383, 409, 460]] = [1500, 2100, 900, 2800, 700, 1200]
    assert sum(P.plan(h, 1024).values()) + 200 <= sum(P.best_fit(h, 1024).values())


def test_many_lengths_are_planned_in_seconds():
    import time

    rng = np.random.default_rng(3)
    h = np.bincount(np.minimum(rng.lognormal(5.5, 1, 100_000).astype(int) + 1, 1024), minlength=1025)
    began = time.process_time()
    used = sum(P.plan(h, 1024).values())
    assert time.process_time() - began < 15
    assert used <= np.ceil(P.size_bound(h, 1024)) + 20
