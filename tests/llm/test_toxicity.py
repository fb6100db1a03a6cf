import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import toxicity as T
from claimlens.llm.queries import op8_toxicity

SF = "/root/testdata/sf0.1"
BAD = ["blorkhead", "skrunting", "vexfume", "dolthorn"]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    syllables = ["an", "ter", "ing", "ou", "st", "re", "ly", "wh", "ble", "he"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(rng.integers(20, 200))]
        if bad := i % 4 == 0:
            for _ in range(5):
                words.insert(int(rng.integers(len(words))), BAD[int(rng.integers(4))])
        out.append((i, " ".join(words).capitalize(), int(bad)))
    return out


@pytest.fixture(scope="module")
def fitted():
    rows = texts(1200, 1)
    return T.fit([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], bool), np.arange(1200) // 4 % 3)


def test_finds_unseen_toxic_documents(fitted):
    rows = texts(400, 2)
    got = fitted.scores([t.encode() for _, t, _ in rows]) >= 0.5
    assert (got == np.array([y for *_, y in rows], bool)).mean() > 0.97


def test_windows_cover_every_byte():
    sizes = np.array([0, 1, 31, 32, 33, 56, 57, 1000, 0])
    segments, owner = T.cut_windows(sizes)
    begin = np.cumsum(sizes) - sizes
    for d, n in enumerate(sizes):
        covered = set()
        for (o, k), w in zip(segments, owner):
            if w == d:
                assert 0 < k <= T.WINDOW
                covered |= set(range(o - begin[d], o - begin[d] + k))
        assert covered == set(range(n))


def test_odd_rows(spark, fitted):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x"), (5, "é日本 " * 30_000), (4, "x"), (None, "blorkhead skrunting vexfume dolthorn " * 3)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    got = [(r.doc_id, r.score) for r in T.score(df, fitted).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    assert [s for i, s in got if i in (1, 2, 3)] == [fitted.prior] * 3
    assert [s for i, s in got if i is None][0] > 0.5
    assert T.score(df.limit(0), fitted).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    model = T.train(docs, labels, F.lit(True))
    assert model.prior == 1.0 and {r.score for r in T.score(docs, model).collect()} == {1.0}
    assert T.train(docs, labels.limit(0), F.lit(True)).prior == 0.0


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op8_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    # In this small table only the English labels follow the words; the others are too few to learn.
    english = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").select("doc_id").collect()}
    scored = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels and r.doc_id in english]
    bad, fine = (np.array([s for s, y in scored if y == c]) for c in (1, 0))
    assert (bad[:, None] > fine[None, :]).mean() > 0.95
    assert ((bad >= 0.5).sum() + (fine < 0.5).sum()) / len(scored) > 0.97


def test_a_small_language_has_its_words():
    rng = np.random.default_rng(3)
    few, many = ([[f"{a}{b}" for b in "klmnprst"] for a in x] for x in (("zuvo",), ("bra", "dri", "glo")))
    rows = [(many[i % 3] if i % 40 else few[0], i // 40 % 2) for i in range(6000)]  # one in forty: its words are in under 2% of a class
    bad, fine = ([b" ".join(rng.choice(words, 5).astype("S") if y else [b"plain"]) + b" rest" for words, y in rows if y == c]
                 for c in (1, 0))
    words = set(b" ".join(T._telling(bad, fine)).split())
    assert words >= {w.encode() for w in few[0]}
    own = T._own(T._telling(bad, fine))
    assert words <= set(own.split())


def test_held_out_recall_of_every_language(spark):
    language = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    hits = {}
    for r in op8_toxicity(spark, SF).filter("held_out").collect():
        if r.doc_id in toxic:
            hits.setdefault(language[r.doc_id], []).append(r.predicted)
    assert set(hits) == {"en", "de", "fr", "es"} and all(sum(h) >= 0.4 * len(h) for h in hits.values()), hits


def test_learning_takes_the_smallest_text_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(i, f"text {k} of {i}") for i in range(40) for k in range(3)] + [(99, "x" * 200_001)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, 1)], "doc_id long, toxic int")
    seen = []
    for df in (docs.repartition(1), docs.orderBy(F.desc("text")).repartition(7)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(T, "fit", lambda texts, *rest: seen.append(texts))
            T.train(df, labels, F.lit(True))
    assert seen[0] == seen[1] and len(seen[0]) == 40
