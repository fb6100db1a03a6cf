import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import divergence
from claimlens.llm.transducer import Fleet, build

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def brute(rows, top=200, min_docs=3):
    """{(lang, source, part, item): (value, rank)} by plain counting."""
    docs = []
    for text, lang, source in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = "".join(c if ord(c) >= 128 or c in LETTERS else " " for c in low)
        docs.append((lang or "", source or "", [w for w in terms.split(" ") if w]))
    out = {}
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(w for d in own for w in set(d[2]))
        kept = sorted((w for w, n in seen.items() if n >= min_docs), key=str.encode)
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if seen[w] >= min_docs)
        whole = sum(counts.values(), Counter())

        def p(c, w):
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))

        for a in counts:
            pairs = {b: sum((p(counts[a], w) - p(counts[b], w)) ** 2 // p(counts[b], w) for w in kept) for b in counts if b != a}
            terms = {w: (p(counts[a], w) - p(whole, w)) ** 2 // p(whole, w) for w in kept
                     if counts[a][w] and p(counts[a], w) > p(whole, w)}
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out[lang, a, part, item] = (value, rank)
    return out


def found(df):
    rows = df.collect()
    got = {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in rows}
    assert len(got) == len(rows)
    return got


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def random_rows(seed, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abéß") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    # A hot source, and weights that leave ties and rare terms.
    return [(" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 30))).title(),
             rng.choice(["x", "y"]), rng.choice(["s0"] * 5 + ["s1", "s2", "s3", "ü"])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_counting(spark, seed):
    rows = random_rows(seed)
    assert found(divergence.audit(frame(spark, rows))) == brute(rows)


def test_same_result_however_the_vocabulary_is_cut(spark):
    rows = random_rows(3, 200)
    docs = frame(spark, rows).repartition(5)
    want = brute(rows, top=4)
    assert found(divergence.audit(docs, top=4, part=7, fleet_bytes=2000, step=3)) == want
    assert found(divergence.audit(docs, top=4)) == want


def test_many_sources_are_handed_on_by_the_row(spark, monkeypatch):
    rows = random_rows(4, 150)
    monkeypatch.setattr(divergence, "HELD_PAIRS", 1)
    language = divergence._Language("x", ["a", "b"], 3)
    assert language.pairs is None
    out = list(language.block(np.array([[1, 0], [0, 2]]), np.array([3, 4, 5]), np.array([0, 1])))
    assert [b.column("other").to_pylist() for b in out] == [["b"], ["a"]]
    monkeypatch.undo()
    assert found(divergence.audit(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "x", "a"), ("uno dos", "x", "b"), ("12 !", "x", "b"), ("Z z z", None, "c"), ("z", None, "d"),
            ("z", None, "d"), ("é" * 50_000, None, "d"), ("é" * 50_000 + " y", None, "d"), ("é" * 50_000, None, "c"),
            ("\x7f@[`{", None, "e"), ("lone lone lone", "w", "only"), ("lone", "w", "only"), ("lone", "w", "only")]
    got = found(divergence.audit(frame(spark, rows)))
    assert got == brute(rows)
    assert got["x", "a", "pair", "b"] == (0, 1)  # no kept term
    assert ("", "", "pair", "c") in got and not any(k[0] == "w" and k[2] == "pair" for k in got)


def test_empty_table_and_clashing_columns(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    rows = random_rows(5, 60)
    docs = frame(spark, rows)
    for c in ("term", "ordinal", "n", "block", "total", "item", "value", "rank", "part", "slice", "place", "v"):
        docs = docs.withColumn(c, F.lit("x"))
    assert found(divergence.audit(docs)) == brute(rows)


def test_shares_are_exact():
    rng = random.Random(6)
    for _ in range(500):
        total = rng.randint(1, 9 * 10**15)
        count = rng.randint(0, total - 1)
        got = divergence.shares(np.array([count]), np.array([total]))
        assert int(got[0]) == 1 + 10**9 * (count + 1) // total


# --- transducers --------------------------------------------------------------


def least_states(words):
    """States of the minimal automaton: distinct sets of endings."""
    return len({frozenset(w[k:] for w in words if w.startswith(p)) for w in words for k in range(len(w) + 1) for p in [w[:k]]})


def random_words(seed, n=300):
    rng = random.Random(seed)
    return sorted({bytes(rng.choice(b"abc\xc3\xa9\xff") for _ in range(rng.randint(1, 7))) for _ in range(n)})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_transducer_is_minimal_and_ordered(seed):
    words = random_words(seed)
    t = build(words)
    assert len(t.final) == least_states(words)
    assert t.ordinals(words).tolist() == list(range(len(words)))
    assert [t.word(k) for k in range(len(words))] == words
    others = [w for w in random_words(seed + 10) + [b"", b"a" * 40] if w not in set(words)]
    assert (t.ordinals(others) == -1).all()


def test_transducer_of_shared_endings():
    words = sorted(a.encode() + b"ation" for a in LETTERS)
    assert len(build(words).final) == 7
    with pytest.raises(ValueError):
        build([b"b", b"a", b"a"])


@pytest.mark.parametrize("part", [1, 3, 50])
def test_fleet(part):
    """Also words that share their first eight bytes, over several parts."""
    rng = random.Random(7)
    words = {0: random_words(1), 1: sorted({b"prefixed" + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(90)} | {b"z"})}
    fleet = Fleet([(v, at, build(ws[at:at + part])) for v, ws in words.items() for at in range(0, len(ws), part)])
    for v in words:
        asked = words[0] + words[1] + [b"prefixed" + b"c"]
        ends = np.cumsum([len(w) for w in asked])
        got = fleet.ordinals(v, np.frombuffer(b"".join(asked), np.uint8), np.concatenate(([0], ends[:-1])), ends)
        place = {w: k for k, w in enumerate(words[v])}
        assert got.tolist() == [place.get(w, -1) for w in asked]
    assert (fleet.ordinals(9, np.frombuffer(b"a", np.uint8), np.array([0]), np.array([1])) == -1).all()
