import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimlens.llm import decontamination as D
from claimlens.llm.fm_index import FMIndex, WaveletMatrix, suffix_order


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(m[0], m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]


def brute(docs, items, window):
    phrases = []
    for i, t in items:
        w = [x for x, _ in words_of(t)]
        size = min(window, len(w))
        phrases += [(str(i), w[k:k + size]) for k in range(len(w) - size + 1) if w]
    out = []
    for d, t in docs:
        w = words_of(t)
        only, hit, who = [x for x, _ in w], set(), set()
        for i, p in phrases:
            for k in range(len(only) - len(p) + 1):
                if only[k:k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    who.add(i)
        out.append((d, len(w), len(hit), sorted(who), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40), st.lists(st.integers(0, 40), max_size=5))
def test_index_finds_every_occurrence(symbols, ends):
    text = np.array(symbols, np.int64)
    for e in ends:
        if e < len(text):
            text[e] = 0
    text = np.concatenate((text, [0]))
    order = suffix_order(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    index = FMIndex(text)
    phrases = [(1,), (2, 1), (1, 1, 1), (3, 2, 1, 1), (9,)]
    rows = np.zeros((len(phrases), 4), np.int64)
    for r, p in zip(rows, phrases):
        r[4 - len(p):] = p
    low, high = index.search(rows, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text) - len(p) + 1) if tuple(text[i:i + len(p)]) == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@given(st.lists(st.integers(0, 6), min_size=1, max_size=30))
def test_wavelet_ranks(values):
    tree, v = WaveletMatrix(np.array(values)), np.array(values)
    for i in range(len(values)):
        symbol, rank = tree.access_rank(np.array([i]))
        assert symbol[0] == v[i] and rank[0] == (v[:i] == v[i]).sum()
    for s in range(max(values) + 1):
        got = tree.rank(np.full(len(v) + 1, s), np.arange(len(v) + 1))
        assert got.tolist() == [(v[:i] == s).sum() for i in range(len(v) + 1)]


DOCS = [(1, "A b, C d e f"), (1, "other words than these"), (2, None), (3, ""), (4, "..."), (5, "é ß b c D e"), (5, "é ß b c D e"),
        (6, "x " * 30_000 + "b c d e y"), (None, "b c d e"), (7, "tie a a a a a a"), (8, "p q"), (9, "c d"), (10, "v p q w " * 9)]
ITEMS = [(10, "a b c d e f g"), (9, "B C D E"), (8, "p q"), (7, None), (6, "--"), (5, "p q"), (None, "a a a a a"), (11, "unseen words here now")]


@pytest.mark.parametrize("block,shard", [(1 << 20, 1 << 20), (12, 1 << 20), (1 << 20, 20)])
def test_equals_brute_force(spark, block, shard):
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in DOCS], "doc_id long, text string, n_words int, spans string")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = D.find_contamination(docs, items, window=4, block_bytes=block, shard_bytes=shard)
    rows = sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()], key=str)
    assert rows == brute(DOCS, [(i, t) for i, t in ITEMS if i is not None], 4)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_repeated_items_count_once_whatever_the_blocks(spark, block):
    t, u = "one two three four five six seven", "eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"x {t} y {u}"), (2, u), (3, "z")], "doc_id long, text string")
    items = spark.createDataFrame([("a", t), ("a", t), ("b", t), ("a", u), ("c", u), ("c", u)], "item_id string, text string")
    got = {r.doc_id: (list(r["items"]), r.n_hit) for r in D.find_contamination(docs, items, window=4, block_bytes=block).collect()}
    assert got == {1: (["a", "b", "c"], 12), 2: (["a", "c"], 5), 3: ([], 0)}
    assert len(D.benchmark_blocks(items, "item_id", "text", block)) == (1 if block > 60 else 4)


def test_phrases_of_a_large_block_are_cheap():
    """One whole block: seconds and some hundred MB."""
    import random
    import resource
    import time

    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50_000)]
    items = [(str(k), " ".join(rng.choices(vocabulary, k=300))) for k in range(D.BLOCK_BYTES // 2100)]
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    phrases = D.Phrases.of(items, 13)
    assert len(phrases.rows) == sum(288 for _ in items) and len(phrases.item_of) == len(phrases.rows)
    assert time.time() - began < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 << 10


def test_spans_are_code_points(spark):
    docs = spark.createDataFrame([(5, "é ß, b c D e.")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "B C D E")], "item_id long, text string")
    row = D.find_contamination(docs, items, window=4).first()
    assert [tuple(s) for s in row.spans] == [(5, 12)] and [tuple(s) for s in row.words] == [(2, 6)]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.find_contamination(docs.limit(0), items).count() == 0
    assert all(not r.contaminated for r in D.find_contamination(docs, items.limit(0)).collect())
