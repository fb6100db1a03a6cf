import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlens.llm import lm
from claimlens.llm.elias_fano import EliasFano, Trie, lay, mapped
from claimlens.llm.queries import op3_language_model

SF = "/root/testdata/sf0.01"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=60), st.integers(1, 1 << 61))
def test_sequence_equals_sorted_list(values, scale):
    v = np.sort(np.array([x * (scale // 301 + 1) for x in values], np.uint64))
    e = EliasFano.of(mapped(lay(EliasFano.parts(v, int(v.max(initial=0)) + 1))))
    assert e.access(np.arange(len(v))).tolist() == v.tolist()
    x = np.unique(np.concatenate((v, v + np.uint64(1), v // np.uint64(2))))
    x = x[x <= v.max(initial=0)] if len(v) else x[:0]
    assert e.successor(x).tolist() == np.searchsorted(v, x).tolist()
    assert [i >= 0 for i in e.find(x).tolist()] == [a in set(v.tolist()) for a in x.tolist()]


def test_trie_maps_from_a_file(tmp_path):
    paths = sorted({(int(a), int(b), int(c)) for a, b, c in np.random.default_rng(1).integers(0, 9, (200, 3))})
    ones, twos = sorted({p[:1] for p in paths}), sorted({p[:2] for p in paths})
    ids = [np.array([x[-1] for x in level], np.uint64) for level in (ones, twos, paths)]
    parents = [np.zeros(0), np.array([ones.index(x[:1]) for x in twos]), np.array([twos.index(x[:2]) for x in paths])]
    values = [(np.arange(len(x), dtype=np.uint16),) * 2 for x in ids]
    (tmp_path / "trie").write_bytes(Trie.build(ids, parents, values))
    trie = Trie(np.memmap(tmp_path / "trie", np.uint8, "r"))
    ask = [(a, b, c) for a in range(10) for b in range(10) for c in range(10)]
    got = trie.find([np.array(x, np.uint64) for x in zip(*ask)])
    for k, level in enumerate((ones, twos, paths)):
        assert got[k].tolist() == [level.index(x[:k + 1]) if x[:k + 1] in level else -1 for x in ask]
    begin, end = trie.children(0, np.arange(len(ones)))
    assert [b - a for a, b in zip(begin, end)] == [sum(x[:1] == o for x in twos) for o in ones]
    assert trie.values[2][0].tolist() == list(range(len(paths)))


def words_of(text):
    data = (text or "").encode()
    return bytes(b + 32 if 65 <= b <= 90 else b for b in data).split()


def brute(rows, train):
    """Scores from plain counts, unquantised."""
    c, count = Counter(), 0
    for i, t in rows:
        if train(i):
            w = ["<s>", *words_of(t), "</s>"]
            count += 1
            c.update(zip(w[1:]))
            c.update(zip(w[1:], w))
            c.update((w[k], w[k - 1], w[k - 2]) for k in range(2, len(w)))
    n = sum(x for k, x in c.items() if len(k) == 1)
    v = sum(len(k) == 1 for k in c)
    prior = max(n, 1) * lm.PRIOR
    out = []
    for i, t in rows:
        w = ["<s>", *words_of(t), "</s>"]
        base = sum(math.log10((c[(x,)] + 0.1) / (n + 0.1 * (v + 1))) for x in w[1:])
        score = 0.0
        for k in range(1, len(w)):
            one = (c[(w[k],)] - lm.DISCOUNT) / n if c[(w[k],)] else lm.DISCOUNT * max(v, 1) / max(n, 1)
            up = c[(w[k], w[k - 1])] + prior * one
            low = (c[(w[k - 1],)] if k > 1 else count) + prior
            if k > 1:
                up += lm.LONGER * c[(w[k], w[k - 1], w[k - 2])]
                low += lm.LONGER * c[(w[k - 1], w[k - 2])]
            score += math.log10(up) - math.log10(low)
        out.append((i, len(w) - 1, sum(c[(x,)] > 0 for x in w[1:]), n, base, score))
    return out


def check(got, want):
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], round(r[4], 3))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:4] == b[:4]
        assert math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(a[5] - b[5]) <= (a[1] + 1) * 1.01 / lm._STEP


def tuples(rows):
    return [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows]


@pytest.mark.parametrize("shard_bytes,frequent", [(1 << 20, 0.25), (400, 0.25), (150, 0.02), (400, 9.0)])
def test_equals_counting(spark, monkeypatch, shard_bytes, frequent):
    monkeypatch.setattr(lm, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "SLICE", 300)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["the", "of", "a", "b", "c", "é", "rare%d" % i], rng.integers(0, 30), p=[.4, .2, .1, .1, .1, .05, .05]))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t"), (503, "the of " * 900), (504, "THE Of"), (504, "THE Of"), (None, "the unseen words")]
    df = spark.createDataFrame([(i, t, 1.0, True) for i, t in rows], "doc_id long, text string, score double, train boolean")
    got = lm.score(df.repartition(3), F.coalesce(F.col("doc_id") % 10 != 3, F.lit(False))).collect()
    check(tuples(got), brute(rows, lambda i: i is not None and i % 10 != 3))


def test_without_training_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    check(tuples(lm.score(df, F.lit(False)).collect()), brute([(1, "a b"), (2, None)], lambda i: False))
    assert lm.score(df.limit(0), F.lit(True)).count() == 0


def test_probabilities_sum_to_one():
    texts = [["a", "b", "c", "</s>"], ["a", "b", "</s>"], ["c", "c", "a", "</s>"], ["b", "</s>"]]
    c = Counter()
    for w in texts:
        c.update(zip(w)), c.update(zip(w[1:], w)), c.update(zip(w[2:], w[1:], w))
    n, words = sum(map(len, texts)), ["a", "b", "c", "</s>"]
    plan = lm.Plan(1, tokens=n, documents=4)
    for u, v in [("a", "b"), ("c", "c"), ("b", "a"), ("zzz", "c")]:
        up = plan.upper(np.array([c[(w,)] for w in words]), np.array([c[(w, v)] for w in words]), np.array([c[(w, v, u)] for w in words]))
        unseen = plan.prior * lm.DISCOUNT * len(words) / n
        low = plan.lower(np.array([c[(v,)]]), np.array([c[(v, u)]]))[0]
        assert math.isclose(((10**up).sum() + unseen) / 10**low, 1)


def test_query_equals_counting_and_beats_the_base(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op3_language_model(spark, SF).collect()
    check(tuples(got), brute(rows, lambda i: zlib.crc32(str(i).encode()) % 10 != 0))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)
