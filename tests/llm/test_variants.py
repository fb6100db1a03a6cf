import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import variants
from claimlens.llm.queries import QUERIES


def brute_counts(rows):
    total = Counter()
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(counts, ratio=5):
    """Near words share a word with one letter left out (or are it); the edit distance decides."""
    holes, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            holes[k].add(w)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if b != a and b not in near[a] and abs(len(a) - len(b)) < 2 and edits(a, b) == 1}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def found(df):
    rows = df.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


def random_counts(seed, n=500, letters="abcé×ÿz", sizes=(1, 7)):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))): rng.choice([1, 2, 5, 5, 26, 130, 700]) for _ in range(n)}


@pytest.mark.parametrize("shard_words", [16_384, 40, 1])
def test_equals_all_pairs(spark, shard_words):
    """Shards of one word also deal out words with equal counts (anagrams)."""
    counts = random_counts(shard_words, 120 if shard_words == 1 else 500)
    got = found(variants.variants(table(spark, counts), shard_words))
    assert got == brute(counts)
    assert any(v[0] != v[1] for v in got.values() if v[0])  # chains of more than one step


def test_directory_fits(spark):
    counts = random_counts(5)
    top, parts = variants.directory(table(spark, counts), 25)
    rows = variants.vectors([w.encode("latin-1") for w in counts])
    row, leaf = top.search(rows, 0, 0)
    assert sorted(row.tolist()) == list(range(len(counts)))
    many = np.bincount(leaf, minlength=len(parts))
    assert (many <= 25 * parts).all() and (many > 0).all() and len(parts) > 5


def test_one_edit_and_tables():
    rng = random.Random(3)
    words = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(60)} | {b"a" * 50, b"a" * 51, b"a" * 50 + b"b", b"b" + b"a" * 50})
    held = variants._Words(words)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    want = [edits(words[i], words[j]) == 1 for i, j in zip(a, b)]
    assert held.near(a, b).tolist() == want == [variants.one_edit(words[i], words[j]) for i, j in zip(a, b)]


def test_words_of_texts(spark):
    rng = random.Random(4)
    vocabulary = [w for w in random_counts(6, 300, "aBcÉé×e", (4, 8))]
    rows = [(rng.choice([None, 1, 2, 10**12]), rng.choice([None, "", "x1y", "12"]) if rng.random() < 0.1 else " ".join(rng.choices(vocabulary, k=200)))
            for _ in range(60)] + [(7, "longword" * 30)] * 5 + [(8, "longword" * 30 + "s")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts = brute_counts(rows)
    assert {r["word"]: r["n"] for r in variants.count_words(docs).collect()} == counts
    got = found(variants.variants(variants.count_words(docs)))
    assert got == brute(counts)
    assert got["longword" * 30][0] == "longword" * 30 + "s"


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(variants.count_words(docs)).count() == 0
    docs = spark.createDataFrame([(1, "abcdef abcdeg")] * 6, "doc_id long, text string")
    for c in ("word", "n", "shard", "part", "own", "form", "root", "id", "t"):
        docs = docs.withColumn(c, F.lit("x"))
    assert found(variants.variants(variants.count_words(docs))) == brute(brute_counts([(1, "abcdef abcdeg")] * 6))


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(QUERIES["op12_spelling_variants"](spark, sf)) == brute(brute_counts(rows))
