import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from claimlens.llm import secrets_scan

from .brute import classes, contaminated, fingerprint, redacted

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, component_id int, __x string"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's documents over sf0.01, in order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(P.written(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    assert all(d.columns == stages[0].columns for d in stages[1:-1])


def test_language_stage_keeps_clean_documents(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert all(not any(c.isalpha() for c in before[i].text or "") for i in set(before) - set(after)) or len(before) - len(after) < 10
    assert all(before[i] == r for i, r in after.items())


def test_dedup_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    ids = sorted(before)
    least = classes([fingerprint(before[i].text) for i in ids], ids)
    assert set(after) == set(least) and all(before[i] == r for i, r in after.items())


def test_decontamination_stage(spark, stages):
    before, after = rows(stages[2]), rows(stages[3])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, r in before.items() if contaminated(r.text, items)}
    assert bad and set(after) == set(before) - bad


def test_secret_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    changed = 0
    for i, r in before.items():
        want = redacted(r.text)
        assert after[i].text == want and after[i].n_chars == (r.n_chars if want == r.text else len(want))
        changed += want != r.text
        assert not [k for _, k, _ in secrets_scan.scan_buffer(after[i].text.encode()) if k < 3]
    assert changed


def test_packing_stage(stages):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs, sizes = rows(stages[4]), {}
    for r in stages[5].collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in docs.items()}


def test_run_equals_stages(spark, stages):
    pick = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pick(P.run(spark, SF)) == pick(stages[-1])


def test_odd_rows_pass_every_stage(spark):
    copy = "The of and with for this that an thing. " * 9
    data = [(1, copy), (2, copy), (2, copy), (3, copy + "more"), (3, "another text with the words of it"), (4, None), (5, ""), (6, "123 -- !"),
            (7, "The password = hunter2222 of the thing that"), (None, "the words that have no id in the table"), (8, "the " * 30_000)]
    df = spark.createDataFrame([(i, t, None, None, None if t is None else len(t), 1, "y") for i, t in data], COLUMNS)
    docs = df
    train = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = train.withColumn("component_id", P.F.lit(0)).withColumn("__x", P.F.lit("z")).withColumn("doc_id", P.F.col("doc_id") + 1000)
    docs = docs.unionByName(extra)
    for _, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, SF), "odd")
        assert docs.columns == df.columns
    got = {}
    for r in docs.filter("doc_id IS NULL OR doc_id < 1000").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert set(got) == {1, 3, 7, 8, None} and got[7] == ["The [SECRET] of the thing that"]
    assert len(got[1]) == 1 and got[3] == ["another text with the words of it"]
    assert P.STAGES[-1][1](spark, docs, SF).count() > 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_language_stage_keeps_every_lettered_document(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}


def test_language_stage_keeps_texts_of_several_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 400")
    texts = {r.lang: r.text for r in docs.filter("lang IN ('en', 'de', 'fr')").orderBy("doc_id").collect()}
    mixed = " ".join(" ".join(texts[c].split()[:n]) for c, n in (("en", 24), ("de", 18), ("fr", 18)))
    row = docs.limit(1).withColumn("doc_id", P.F.lit(-1).cast("long")).withColumn("text", P.F.lit(mixed)).withColumn("lang", P.F.lit(None).cast("string"))
    stage = dict(P.STAGES)["language_id"]
    assert stage(spark, docs.unionByName(row), SF).filter("doc_id = -1").count() == 1


def test_dedup_stage_with_one_id_in_two_classes(spark):
    one, other = "the first text of its own class with some words. " * 6, "quite another passage about nothing at all here. " * 6
    data = [(1, one), (2, one), (1, other), (3, other), (1, other), (4, None), (5, None), (6, "")]
    df = spark.createDataFrame([(i, t, None, None, None, 1, "y") for i, t in data], COLUMNS)
    stage = dict(P.STAGES)["simhash_near_dedup"]
    got = sorted(((r.doc_id, r.text) for r in stage(spark, df, SF).collect()), key=str)
    assert got == sorted([(1, one), (1, other), (4, None)], key=str)


def test_language_stage_fills_the_language(spark, stages):
    """A document without a language leaves the stage with the one that the tagger gives it."""
    from pyspark.sql import functions as F

    docs = stages[0].withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    before, after = rows(stages[0]), rows(P.language_id(spark, docs, SF))
    blank = [r for i, r in after.items() if i % 5 == 0]
    assert all(r.lang is not None for r in after.values())
    assert sum(r.lang == before[r.doc_id].lang for r in blank) > 0.95 * len(blank) > 100
