"""Spelling variants: words one edit apart, found by a trie over letter-group counts.

A word is the vector of how often it uses each letter group (``GROUPS``, in this order). Words are
arranged in a trie by those counts. One inserted letter raises one count by one, a
deleted one lowers one, a replaced one may do both, so the search for a word goes down the
trie with a budget of one surplus and one deficit: at each level it follows the word's own
count, one more while the surplus is unspent, one less while the deficit is. The words of the
leaves that it reaches are verified. Searches of many words go down level by level together.

Scale. The top of the trie is the directory of shards: a node over ``SHARD_WORDS`` words is split by
the next count, until every shard fits (counted level by level in Spark; the directory holds a few
numbers a shard). Each word is sent to its own shard and, by the same budgeted search in the directory,
to every other shard that may hold a near word; a task builds the trie of one shard and returns a sum
for each word that came. Words equal in all counts can't be split further: such a leaf is dealt out by
a hash, and its visitors go to every part. No task holds more than a shard and its visitors, and pairs
never leave a task.

``variants`` runs on any (word, n) table; ``count_words`` makes one from texts.

Defined results: null texts have no words, a null id counts as empty text; repeated rows count
again; ties of the most frequent near word go to the smallest in code-point order; a word
without near words has n_near 0 and is its own root; an empty table gives no rows; other columns
are ignored; words may be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from claimlens.llm.common import LOWER_AZ, arrow_map, ragged, written
from claimlens.llm.tokens import text_slices

MIN_LETTERS = 6
MIN_COUNT = 5
#: A form is at least this many times as frequent as the word.
FORM_RATIO = 5
SHARD_WORDS = 16_384

#: Letter groups, frequent letters first, as their counts tell most; then four groups of all other letters.
GROUPS = ["e", "t", "a", "n", "i", "o", "r", "s", "h", "l", "d", "u", "c", "m", "fg", "pb", "wv", "yk", "xqjz"]
LEVELS = len(GROUPS) + 4
_GROUP = np.array([next((k for k, g in enumerate(GROUPS) if chr(c) in g), len(GROUPS) + c % 4) for c in range(256)])

#: Searches that go down together, words a task counts at once, and letters of a word that is compared in a table.
TOGETHER, HELD_WORDS, TABLE_LETTERS = 4096, 300_000, 40

_RUNS = re.compile("[a-zÀ-ÿ]{%d,}" % MIN_LETTERS)

# --- words of texts -----------------------------------------------------------------


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = 199,
                min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the lower-cased (A-Z) letter runs of whole texts with ``min_letters`` at least (and
    no fewer than ``MIN_LETTERS``), found ``min_count`` times.

    ``damage``: a run loses the code point h % length where this divides h, the crc32 of
    ``<id>:<run>`` (test errors at known places); None leaves the runs as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        total: Counter = Counter()
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for first, texts in text_slices(batch, 0):
                for i, t in enumerate(texts):
                    own = Counter(_RUNS.findall(t.translate(LOWER_AZ).decode()))
                    if damage:
                        seed = zlib.crc32(f"{ids[first + i]}:".encode())
                        for w in [w for w in own if zlib.crc32(w.encode(), seed) % damage == 0]:
                            at = zlib.crc32(w.encode(), seed) % len(w)
                            total[w[:at] + w[at + 1:]] += own.pop(w)
                    total.update(own)
                if len(total) > HELD_WORDS:
                    yield rows()
                    total.clear()
        yield rows()

    read = docs.select(F.col(text_col).cast("string").alias("t"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    counted = arrow_map(read, run, "word string, n long").filter(F.length("word") >= max(min_letters, MIN_LETTERS))
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- tries of letter-group counts ---------------------------------------------------


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter-group counts of Latin-1 words."""
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    cell = owner * LEVELS + _GROUP[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(cell, minlength=len(words) * LEVELS).reshape(len(words), LEVELS)


class CountTrie:
    """Nodes level by level: ``keys`` (parent * width + count, sorted) and ``leaf`` (a leaf's number, or -1)."""

    def __init__(self, width: int, keys: list[np.ndarray], leaf: list[np.ndarray]):
        self.width, self.keys, self.leaf = width, keys, leaf

    @staticmethod
    def of(rows: np.ndarray) -> tuple[CountTrie, np.ndarray]:
        """The whole trie of distinct sorted rows, whose last level's leaves are the rows' numbers."""
        width, node, keys = int(rows.max(initial=0)) + 2, np.zeros(len(rows), np.int64), []
        for k in range(rows.shape[1]):
            level, node = np.unique(node * width + rows[:, k], return_inverse=True)
            keys.append(level)
        leaf = [np.full(len(x), -1) for x in keys[:-1]] + [np.arange(len(keys[-1]))]
        return CountTrie(width, keys, leaf), node

    def _child(self, level: int, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Number of the child with that count, -1 if there is none."""
        keys = self.keys[level]
        wanted = node * self.width + count
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted) & (count >= 0) & (count < self.width), at, -1)

    def search(self, rows: np.ndarray, surplus: int = 1, deficit: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf within the budgets."""
        row, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        more, less = np.full(len(rows), surplus), np.full(len(rows), deficit)
        got_row, got_leaf = [], []
        for level in range(len(self.keys)):
            if not len(row) or not len(self.keys[level]):
                break
            count = rows[row, level]
            parts = []
            for step, budget in ((0, None), (1, more), (-1, less)):
                at = np.arange(len(row)) if budget is None else np.flatnonzero(budget > 0)
                child = self._child(level, node[at], count[at] + step)
                at, child = at[child >= 0], child[child >= 0]
                parts.append((row[at], child, more[at] - (step > 0), less[at] - (step < 0)))
            row, node, more, less = (np.concatenate(x) for x in zip(*parts))
            leaf = self.leaf[level][node]
            there = leaf >= 0
            got_row.append(row[there])
            got_leaf.append(leaf[there])
            go = ~there
            row, node, more, less = row[go], node[go], more[go], less[go]
        if not got_row:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(got_row), np.concatenate(got_leaf)


# --- verification -------------------------------------------------------------------


def one_edit(a: bytes, b: bytes) -> bool:
    """Exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    head = next((i for i in range(short) if a[i] != b[i]), short)
    return a[head + 1:] == b[head + 1:] if len(a) == len(b) else a[head + (len(a) > short):] == b[head + (len(b) > short):]


class _Words:
    """Words as tables of letters from the left and from the right, for comparisons of many pairs."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.width = min(int(self.sizes.max(initial=0)), TABLE_LETTERS)
        short = [w if len(w) <= self.width else b"" for w in words]
        self.left = np.frombuffer(b"".join(w.ljust(self.width, b"\0") for w in short), np.uint8).reshape(len(words), self.width)
        self.right = np.frombuffer(b"".join(w[::-1].ljust(self.width, b"\0") for w in short), np.uint8).reshape(len(words), self.width)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words numbered ``a`` and ``b`` are one edit apart."""
        out = np.zeros(len(a), bool)
        x, y = self.sizes[a], self.sizes[b]
        table = np.flatnonzero((np.maximum(x, y) <= self.width) & (np.abs(x - y) <= 1) & (a != b))
        if len(table):
            least = np.minimum(x, y)[table]
            same = np.minimum(least, _run(self.left, a[table], b[table])) + np.minimum(least, _run(self.right, a[table], b[table]))
            out[table] = same >= np.maximum(x, y)[table] - 1
        for i in np.flatnonzero((np.maximum(x, y) > self.width) & (np.abs(x - y) <= 1) & (a != b)):
            out[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return out


def _run(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that agree before the first that differs."""
    differ = table[a] != table[b]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])


# --- jobs ---------------------------------------------------------------------------


def directory(words: DataFrame, shard_words: int = SHARD_WORDS) -> tuple[CountTrie, np.ndarray]:
    """The top of the trie, whose leaves are shards of at most ``shard_words`` words, and into how
    many parts each shard is dealt (over one only where all counts are equal)."""
    keys: list[np.ndarray] = []
    leaf: list[np.ndarray] = []
    shards, parts = 0, []
    width = (words.select(F.max(F.length("word"))).first()[0] or 0) + 2
    for level in range(LEVELS):
        top = CountTrie(width, keys, leaf)

        def run(batches: Iterator[pa.RecordBatch], level=level, top=top) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()])
                node, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
                for k in range(level):
                    node = top._child(k, node, rows[live, k])
                    inner = top.leaf[k][node] < 0
                    node, live = node[inner], live[inner]
                cell, n = np.unique(node * width + rows[live, level], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

        counted = arrow_map(words.select("word"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        rows = counted.orderBy("cell").collect()  # the children of over-full nodes
        n = np.array([r["n"] for r in rows], np.int64)
        full = n <= shard_words if level < LEVELS - 1 else np.ones(len(n), bool)
        number = np.full(len(n), -1)
        number[full] = shards + np.arange(full.sum())
        keys.append(np.array([r["cell"] for r in rows], np.int64))
        leaf.append(number)
        shards += int(full.sum())
        parts += (-(-n[full] // shard_words)).tolist()
        if full.all():
            break
    return CountTrie(width, keys, leaf), np.array(parts, np.int64)


def _dealt(words: DataFrame, top: CountTrie, parts: np.ndarray) -> DataFrame:
    """(shard, part, own, word, n): each word in its own place, and as a visitor wherever a near word may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                piece = batch.slice(at, TOGETHER)
                names = [w.encode("latin-1") for w in piece.column(0).to_pylist()]
                rows = vectors(names)
                home = np.zeros(len(names), np.int64)
                row, leaf = top.search(rows, 0, 0)
                home[row] = leaf
                part = np.array([xxh64_intdigest(w) for w in names], np.uint64) % parts[home].astype(np.uint64)
                row, leaf = top.search(rows)
                row, leaf = np.unique(np.stack([row, leaf], 1), axis=0).T
                number = ragged(np.zeros(len(leaf), np.int64), parts[leaf])
                row, leaf = np.repeat(row, parts[leaf]), np.repeat(leaf, parts[leaf])
                own = (leaf == home[row]) & (number == part[row].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf), pa.array(number), pa.array(own), piece.column(0).take(pa.array(row)), piece.column(1).take(pa.array(row))],
                    ["shard", "part", "own", "word", "n"])

    return arrow_map(words.select("word", "n"), run, "shard long, part long, own boolean, word string, n long")


def _searched(table: pa.Table) -> pa.Table:
    """Per word that came: how many words of the shard are near, and the most frequent of them."""
    names = table.column("word").to_pylist()
    held = _Words([w.encode("latin-1") for w in names])
    n, own = np.array(table.column("n")), np.flatnonzero(np.array(table.column("own")))
    rows = vectors(held.words)
    kinds, kind = np.unique(rows[own], axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    trie, node = CountTrie.of(kinds)
    leaf_of = np.zeros(len(kinds), np.int64)
    leaf_of[node] = np.arange(len(kinds))
    order = own[np.argsort(kind, kind="stable")]
    many = np.bincount(kind, minlength=len(kinds))
    first = np.cumsum(many) - many
    # Place by frequency, then by code points: the best near word has the least place.
    place = np.zeros(len(names), np.int64)
    place[sorted(range(len(names)), key=lambda i: (-n[i], held.words[i]))] = np.arange(len(names))
    by_place = np.argsort(place)
    near, best = np.zeros(len(names), np.int64), np.full(len(names), len(names))
    for at in range(0, len(names), TOGETHER):
        row, leaf = trie.search(rows[at:at + TOGETHER])
        leaf, row = leaf_of[leaf], row + at
        for cut in _cuts(many[leaf]):
            a = np.repeat(row[cut], many[leaf[cut]])
            b = order[ragged(first[leaf[cut]], many[leaf[cut]])]
            hit = held.near(a, b)
            near += np.bincount(a[hit], minlength=len(names))
            np.minimum.at(best, a[hit], place[b[hit]])
    some = np.flatnonzero((near > 0) | np.array(table.column("own")))
    found = near[some] > 0
    form = by_place[np.minimum(best[some], len(names) - 1)]
    return pa.table({
        "word": table.column("word").take(pa.array(some)).cast(pa.string()), "n": pa.array(n[some], pa.int64()), "n_near": pa.array(near[some], pa.int64()),
        "less": pa.array(np.where(found, -n[form], 0), pa.int64(), mask=~found),
        "form": pa.array([names[i] if f else None for i, f in zip(form, found)], pa.string())})


def _cuts(sizes: np.ndarray, most: int = 1 << 19) -> Iterator[slice]:
    """Slices of about ``most`` pairs."""
    ends = np.searchsorted(np.cumsum(sizes), np.arange(most, int(sizes.sum()) + most, most))
    edges = np.unique(np.concatenate(([0], np.minimum(ends + 1, len(sizes)))))
    yield from (slice(s, e) for s, e in zip(edges.tolist(), edges[1:].tolist()))


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of a table of distinct words and their counts."""
    top, parts = directory(words, shard_words)
    found = _dealt(words, top, parts).groupBy("shard", "part").applyInArrow(_searched, "word string, n long, n_near long, less long, form string")
    best = F.min(F.when(F.col("less").isNotNull(), F.struct("less", "form")))
    summed = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    often = -F.col("best.less") >= ratio * F.col("n")
    return summed.select("word", "n", "n_near", F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))


def variants(words: DataFrame, shard_words: int = SHARD_WORDS, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): ``form`` is the most frequent near word if it is ``ratio`` times as
    frequent, ``root`` the last of the chain of forms (by doubling: a chain's counts grow by ``ratio`` a step, so
    rounds are few)."""
    forms = written(near_words(written(words, "words"), shard_words, ratio), "forms")
    chain = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chain = written(chain.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "chains")
        if chain.filter("moved").isEmpty():
            break
        chain = chain.select("word", "root")
    return forms.join(chain.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
