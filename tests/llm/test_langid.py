import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import langid as L
from claimlens.llm.queries import op6_language_id

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("segment", [1, 2, 3, 32])
def test_marginals_equal_enumeration(monkeypatch, segment):
    monkeypatch.setattr(L, "SEGMENT", segment)
    rng = np.random.default_rng(segment)
    sizes, k = np.array([0, 1, 5, 0, 6, 2]), 3
    emit, trans, start = rng.normal(size=(14, k)) * 3, rng.normal(size=(k, k)), rng.normal(size=k)
    gamma, both, norms = L.forward_backward(emit, sizes, trans, start, pairs=True)
    want, pairs, at = np.zeros_like(gamma), np.zeros((k, k)), 0
    for d, n in enumerate(sizes):
        paths = [p for p in product(range(k), repeat=n)] if n else []
        w = np.array([np.exp(start[p[0]] + sum(emit[at + i, c] for i, c in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        for p, x in zip(paths, w / w.sum() if n else w):
            for i, c in enumerate(p):
                want[at + i, c] += x
            for a, b in zip(p, p[1:]):
                pairs[a, b] += x
        if n:
            assert np.isclose(norms[d], np.log(w.sum()))
        at += n
    assert np.allclose(gamma, want) and np.allclose(both, pairs)


def test_features_stay_within_words():
    words = [b"a", "é".encode(), b"word", b"and"]
    grams, ends = L.word_features(words)
    starts = [0, *ends[:-1].tolist()]
    alone = [sorted(L.word_features([w])[0].tolist()) for w in words]
    assert [sorted(grams[s:e].tolist()) for s, e in zip(starts, ends)] == alone


def test_letters():
    ids, sizes, words = L.lettered_words([b"12 ab, 3c!", b"", "日本 – é".encode(), b"42 -- 7"])
    assert sizes.tolist() == [2, 0, 2, 0] and [w.decode() for w in words] == ["ab", "3c", "日本", "é"]
    assert ids.tolist() == [0, 1, 2, 3]


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return L.train(docs, F.lit(True))


def test_odd_rows(spark, tagger):
    rows = [(1, None), (2, ""), (3, "12 -- 34"), (4, "the"), (5, "the of and " * 20_000), (4, "the"), (None, "the of and with")]
    df = spark.createDataFrame([(i, t, "xx", 5) for i, t in rows], "doc_id long, text string, lang_pred string, n_words int")
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.predict(df, tagger).collect()]
    assert len(got) == len(rows)
    assert [x for x in got if x[0] in (1, 2, 3)] == [(i, "und", 0.0) for i in (1, 2, 3)]
    assert {x[1] for x in got if x[0] in (5, None)} == {"en"} and all(0 <= s <= 1 for *_, s in got)
    assert L.predict(df.limit(0), tagger).count() == 0


def test_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.predict(df, L.train(df, F.lit(True))).collect()} == {"und"}


def test_code_switched_words(spark, tagger):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) between 400 and 2000").select("lang", "text").collect()
    by = {}
    for r in docs:
        by.setdefault(r.lang, []).append(r.text.encode().translate(L.ALNUM_WORDS).split())
    right = total = 0
    for i in range(30):
        langs = ["en", "de", "fr"] if i % 2 else ["es", "en", "de"]
        parts = [by[c][-1 - i][:30] for c in langs]
        truth = [c for c, p in zip(langs, parts) for w in p if any(map(str.isalpha, w.decode()))]
        runs = tagger.runs(b" ".join(w for p in parts for w in p))
        got = [c for s, e, c in runs for _ in range(e - s)]
        right += sum(a == b for a, b in zip(truth, got))
        total += len(truth)
    assert right / total > 0.95


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op6_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_training_takes_the_smallest_text_of_a_repeated_id(spark):
    """Whatever the order of the rows; and no more than the sample of a language that has most rows."""
    docs = spark.createDataFrame(
        [(i, f"{w} {w}er {w}en text {k}", lang) for i in range(60) for k, (w, lang) in enumerate([("alpha", "a"), ("beta", "b"), ("gamma", "a")])],
        "doc_id long, text string, lang string")
    seen = []
    for df in (docs.repartition(1), docs.orderBy(F.desc("text")).repartition(7)):
        taken = {}
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(L, "fit", lambda texts, labels, *rest: taken.update(texts=texts, labels=labels))
            L.train(df, F.lit(True), sample=10)
        seen.append((taken["texts"], taken["labels"]))
    assert seen[0] == seen[1] and seen[0][1] == ["a"] * 10 + ["b"] * 10


def test_keep_sets_the_missing_language(spark, tagger):
    docs = spark.createDataFrame([(1, "x 1", None), (2, "12", None), (3, "x y", "kept"), (4, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in L.keep(docs, tagger).collect()}
    said = {r.doc_id: r.lang_pred for r in L.predict(docs, tagger).collect()}
    assert got == {1: said[1], 3: "kept"} and said[1] in tagger.languages
