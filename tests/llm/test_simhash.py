import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from claimlens.llm import simhash as S
from claimlens.llm.queries import op2_simhash_near_dedup

SF = "/root/testdata/sf0.01"


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, ids):
    """Component ids by union-find over all pairs of distinct fingerprints."""
    distinct = sorted(set(prints))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    arr = np.array(distinct, np.uint64)
    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= 2):
            root[find(distinct[i + 1 + j])] = find(f)
    least = {}
    for f, i in zip(prints, ids):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for f in prints]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=9), max_size=8))
def test_majority_equals_definition(lists):
    flat = np.array([h for x in lists for h in x], np.uint64)
    got = S.majority_bits(flat, np.cumsum([len(x) for x in lists]).astype(np.int64))
    assert got.tolist() == [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x) > len(x)) for x in lists]


def test_majority_of_long_text(monkeypatch):
    monkeypatch.setattr(S, "_FIELD", 4)
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (3, 0, 4, 5, 17, 1)]
    got = S.majority_bits(np.concatenate(lists), np.cumsum([len(x) for x in lists]))
    assert got.tolist() == [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in x) > len(x)) for x in lists]


def test_pivots_discard_no_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    members = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(1 << 40), base ^ np.uint64(5), base ^ np.uint64(7)]))
    i, j = S.group_links(members)
    want = [(a, b) for a in range(len(members)) for b in range(a + 1, len(members)) if bin(int(members[a] ^ members[b])).count("1") <= 2]
    assert sorted(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("group", [256, 5])
def test_classes_equal_union_find(spark, group):
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**64, 60, dtype=np.uint64).tolist()
    chain = int(prints[0])
    for b in range(0, 60, 2):  # a chain whose ends are far apart
        chain ^= 3 << b
        prints.append(chain)
    center = int(prints[1])
    prints += [center ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (300, 3))]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(S._signed(p),) for p in prints], "fp long")
    roots = {r.node: r.root for r in S.components(S.links(df, group=group)).collect()}
    got = [roots.get(S._signed(p), S._signed(p)) for p in prints]
    ids = [S._signed(p) for p in prints]
    assert got == classes(prints, ids)


def test_last_round_is_bounded():
    assert all(bin(m).count("1") == 56 for _, m in S.masks()[-1]) and len(S.masks()[-1]) == 216


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (1, "One two"), (2, "one  TWO"), (2, "one  TWO"), (7, "é " * 40_000), (8, "é " * 40_001),
            (None, "one two"), (None, "alone here now"), (4, "a b c d e f g h")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()]
    prints = [fingerprint(t) for _, t in rows]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, prints, classes(prints, [i for i, _ in rows]))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    want = sorted((i, f"{f:016x}", c) for i, f, c in zip(ids, prints, classes(prints, ids)))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in op2_simhash_near_dedup(spark, SF).collect())
    assert got == want and len({c for _, _, c in got}) < len(got)
