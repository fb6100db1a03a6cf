"""Language-model scores from an Elias-Fano n-gram trie.

The model mixes n-gram counts of training texts, where c() counts a sequence, u and v
are the words before w, N training tokens, V distinct ones:

    P(w | u v) = (B c(u v w) + c(v w) + M P1(w)) / (B c(u v) + c(v) + M),   M = N * PRIOR,
    P1(w) = (c(w) - D) / N,   and D V / N for all unseen words together.

It sums to one over the V words and the unseen one. Each text is its words and an
end; a start stands before the first word (there u is absent and has no term).

Both logarithms are a node's: the upper depends on w's path (w, v, u) and the lower on
the context's, (v, u), as the same path that scored v. So a trie node (w, v, u) holds
the quantised log of its upper and of its lower value, and one search of w's path
serves w and the word after it; the deepest node found gives the smoothed values.

As a Spark job:

1. ``plan``: paths that would fill a shard are sought in a sample of documents that grows
   with the number of shards, and then counted exactly in one pass. Their counts, a few
   for each shard, go to all tasks.
2. Each task cuts its texts into slices, gathers the distinct paths of a slice with
   training counts, and sends them to the shard of the path's first node that isn't among
   the frequent ones (so a frequent word's paths are dealt out by the pair, and so on);
   wholly frequent paths are answered at once. Texts aren't shuffled.
3. Each shard's task adds up the slices' counts, builds the shard's trie, maps it, answers
   every path by successor searches and returns sums per document.
4. The sums meet by slice.

Word identity is a 62-bit hash, of a preceding word 36 and 32 bits within its node.

Defined results: null and empty texts are the end alone; repeated rows each give a row and
each count for training; ties don't arise; rows with a null id count as id '' for the
split; with no training row N is 0, base and model are then log10 of one token among one;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import arrow_map, gathered, ragged, written
from claimlens.llm.elias_fano import Trie, lay, mapped
from claimlens.llm.tokens import mixed, text_slices, word_hashes, word_ids

DISCOUNT, PRIOR, LONGER = 0.5, 1e-4, 100.0
#: Bytes of text whose paths a shard takes; documents of the plan's sample a shard; share of a shard that makes a path frequent.
SHARD_BYTES, SAMPLE_DOCS, FREQUENT = 6 << 20, 10, 0.25
#: Bytes of text for whose shards one task keeps sums; bytes of text a slice has (a path goes once a slice).
TASK_BYTES, SLICE = 512 << 20, 4 << 20

START, END, NONE = np.uint64(1), np.uint64(2), np.uint64(3)
_W, _V, _U = (np.uint64((1 << b) - 1) for b in Trie.ID_BITS)
_STEP, _SHIFT = 2048.0, 12.0  # quantised logs: 16 bits, 1/2048 apart, from -12 to 20


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((log10 + _SHIFT) * _STEP), 0, 65_535).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    return code / _STEP - _SHIFT


# --- slices ---------------------------------------------------------------------------


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Hashes of the distinct words (then start, end and none), and for each token of the texts its
    word, the word before and the one before that, as places among the hashes; tokens per text."""
    ids, sizes, words = word_ids(texts)
    h = np.concatenate((word_hashes(words) & _W, [START, END, NONE])).astype(np.uint64)
    # Start, words, end of every text in a row.
    n = len(words)
    ends = np.cumsum(sizes + 2)
    seq = np.full(int((sizes + 2).sum()), n, np.int64)
    seq[ends - 1] = n + 1
    seq[ragged(ends - sizes - 1, sizes)] = ids
    at = ragged(ends - sizes - 1, sizes + 1)
    w, v = seq[at], seq[at - 1]
    return h, w, v, np.where(v == n, n + 2, seq[np.maximum(at - 2, 0)]), sizes + 1


@dataclass
class Paths:
    """The distinct paths of some texts, sorted by word, and where they occur."""

    hashes: tuple[np.ndarray, np.ndarray, np.ndarray]  # w, v, u of each path
    keys: list[np.ndarray]  # hash of (w), (w, v), (w, v, u)
    path: np.ndarray  # path of each token
    owner: np.ndarray  # text of each token
    sizes: np.ndarray  # tokens of each text

    @classmethod
    def of(cls, texts: list[bytes]) -> Paths:
        h, w, v, u, sizes = tokens_of(texts)
        n = len(h) - 3
        owner = np.repeat(np.arange(len(texts)), sizes)
        pairs, pair_of = np.unique(w * (n + 3) + v, return_inverse=True)
        triples, path = np.unique(pair_of * (n + 3) + u, return_inverse=True)
        pair, u = triples // (n + 3), triples % (n + 3)
        w, v = pairs[pair] // (n + 3), pairs[pair] % (n + 3)
        hashes = h[w], h[v] & _V, h[u] & _U
        keys = [hashes[0], mixed(hashes[0], hashes[1])]
        keys.append(mixed(keys[1], hashes[2]))
        return cls(hashes, keys, path, owner, sizes)


@dataclass
class Plan:
    """Number of shards, training totals, and the exact counts of the frequent paths of each length."""

    shards: int
    tokens: int = 0
    documents: int = 0
    keys: tuple[np.ndarray, ...] = (np.zeros(0, np.uint64),) * 3
    counts: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3

    def place(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Index among the frequent paths, -1 where it isn't one."""
        known = self.keys[level]
        if not len(known):
            return np.full(len(keys), -1, np.int64)
        i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[i] == keys, i, -1)

    @property
    def prior(self) -> float:
        return max(self.tokens, 1) * PRIOR

    def upper(self, w: np.ndarray, vw: np.ndarray, uvw: np.ndarray) -> np.ndarray:
        """log10 of the numerator from counts; 0 where w is unseen (its term is added at the end)."""
        value = LONGER * uvw + vw + self.prior * np.maximum(w - DISCOUNT, 0) / max(self.tokens, 1)
        return np.log10(np.where(w > 0, value, 1.0))

    def lower(self, v: np.ndarray, uv: np.ndarray) -> np.ndarray:
        return np.log10(LONGER * uv + v + self.prior)


def frequent(docs: DataFrame, candidates: Plan | None, least: float) -> tuple[Plan, int]:
    """Paths counted over ``docs`` (columns id, t, train): of all, those with at least
    ``least`` occurrences, or of ``candidates`` all with their training counts; and the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, SLICE):
            train = np.array(batch.column(2).to_pylist(), bool)
            for first, texts in text_slices(batch, 1, SLICE):
                h, w, v, u, sizes = tokens_of(texts)
                learn = train[first:first + len(texts)]
                teaches = np.repeat(learn, sizes)
                rows = [(-1, 0, len(w), int(teaches.sum()), int(learn.sum()))]
                # A path is a candidate only if what it begins with is, so ever fewer tokens are looked at.
                some, keys = np.arange(len(w)), h[w]
                for level, before in enumerate((None, v, u)):
                    if level:
                        keys = mixed(keys, h[before[some]] & (_V if level == 1 else _U))
                    if candidates is not None:
                        known = candidates.place(level, keys) >= 0 if level else (candidates.place(0, h) >= 0)[w]
                        some, keys = some[known], keys[known]
                    own, of = np.unique(keys, return_inverse=True)
                    rows += zip([level] * len(own), own.view(np.int64).tolist(), np.bincount(of, minlength=len(own)).tolist(),
                                np.bincount(of[teaches[some]], minlength=len(own)).tolist(), [0] * len(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                    ["level", "key", "n", "taught", "docs"])

    sums = arrow_map(docs, run, "level int, key long, n long, taught long, docs long").groupBy("level", "key").agg(
        F.sum("n").alias("n"), F.sum("taught").alias("taught"), F.sum("docs").alias("docs"))
    if candidates is None:
        total = sums.filter("level = -1").first()
        tokens = total["n"] if total else 0
        rows = sums.filter((F.col("level") >= 0) & (F.col("n") >= F.lit(max(2.0, least * tokens)))).collect()  # a few for each shard
    else:
        rows = sums.collect()
        tokens = 0
    plan = Plan(0)
    for r in rows:
        if r["level"] < 0:
            plan.tokens, plan.documents = r["taught"], r["docs"]
    by = [sorted((r["key"] % (1 << 64), r["taught"]) for r in rows if r["level"] == k) for k in range(3)]
    plan.keys = tuple(np.array([k for k, _ in x], np.uint64) for x in by)
    plan.counts = tuple(np.array([c for _, c in x], np.int64) for x in by)
    return plan, tokens


def make_plan(docs: DataFrame) -> Plan:
    size, many = docs.agg(F.sum(F.octet_length("t")), F.count("*")).first()
    shards = max(1, -(-(size or 0) // SHARD_BYTES))
    every = max(1, many // (shards * SAMPLE_DOCS))
    sample = docs.filter(F.pmod(F.xxhash64("id", F.octet_length("t")), F.lit(every)) == 0)
    candidates, _ = frequent(sample, None, FREQUENT / shards) if shards > 1 else (Plan(0), 0)
    plan, _ = frequent(docs, candidates, 0)
    plan.shards = shards
    return plan


# --- messages to the shards -----------------------------------------------------------

_PATHS, _DOCS, _SUMS, _WORDS = range(4)
_MESSAGES = "sub int, batch long, kind int, payload binary"


def _small(a: np.ndarray) -> np.ndarray:
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 256 else np.uint16 if most < 65_536 else np.uint32)


def _bytes_of(a: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each number, byte place by byte place (those that repeat pack well)."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).ravel()


def _numbers(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(width, -1).T
    return out.view("<u8").ravel()


def _packed(arrays: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(lay(arrays))


def _unpacked(payload) -> list[np.ndarray]:
    return mapped(zstandard.ZstdDecompressor().decompress(payload))


def _sums(texts: int, owner: np.ndarray, lm: np.ndarray, base: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(owner, x, texts) for x in (lm, base, known)]


def _answers(plan: Plan, w: np.ndarray, vw: np.ndarray, uvw: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Quantised model term, base term and whether seen, from counts."""
    lm = restored(quantise(plan.upper(w, vw, uvw))) * (w > 0) - np.where(end, 0, restored(quantise(plan.lower(w, vw))))
    return lm, np.log10(w + 0.1), w > 0


def _sender(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, slice_no = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, SLICE):
            train = np.array(batch.column(2).to_pylist(), bool)
            for first, texts in text_slices(batch, 1, SLICE):
                number, slice_no = (part << 32) + slice_no, slice_no + 1
                p, n = Paths.of(texts), len(texts)
                learn = train[first:first + n]
                taught = np.bincount(p.path[learn[p.owner]], minlength=len(p.keys[0]))
                places = [plan.place(k, keys) for k, keys in enumerate(p.keys)]
                route = p.keys[0].copy()
                deep = places[0] >= 0
                route[deep] = p.keys[1][deep]
                deep &= places[1] >= 0
                route[deep] = p.keys[2][deep]
                deep &= places[2] >= 0
                sub = (mixed(route, route) % np.uint64(plan.shards)).astype(np.int64)
                sub[deep] = plan.shards  # answered here
                # Tokens by shard and path.
                token_order = np.argsort(sub[p.path] * len(sub) + p.path, kind="stable")
                often = np.bincount(p.path, minlength=len(sub))
                order = np.argsort(sub, kind="stable")
                cuts = np.searchsorted(sub[order], np.arange(plan.shards + 2))
                token_cuts = np.concatenate(([0], np.cumsum(often[order])))[cuts]
                owner = _small(p.owner[token_order])
                rows = []
                here, tokens = order[cuts[-2]:cuts[-1]], owner[token_cuts[-2]:token_cuts[-1]]
                w, vw, uvw = (c[x[here]] if len(here) else np.zeros(0) for c, x in zip(plan.counts, places))
                absent = p.hashes[1][here] == START
                terms = _answers(plan, w, vw, np.where(absent, 0, uvw), p.hashes[0][here] == END)
                held = _sums(n, tokens, *(np.repeat(x, often[here]) for x in terms))
                ids = pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(p.sizes)], ["id", "n_tokens"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ids.schema) as out:
                    out.write_batch(ids)
                rows.append((number % plan.shards, number, _DOCS, sink.getvalue().to_pybytes()))
                rows.append((number % plan.shards, number, _SUMS, _packed([np.arange(n), *held])))
                for k in np.flatnonzero(np.diff(cuts[:-1])):
                    own = order[cuts[k]:cuts[k + 1]]
                    rows.append((int(k), number, _PATHS, _packed([
                        _bytes_of(p.hashes[0][own], 8), _bytes_of(p.hashes[1][own], 5), _bytes_of(p.hashes[2][own], 4),
                        _small(taught[own]), _small(often[own]), owner[token_cuts[k]:token_cuts[k + 1]]])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                    ["sub", "batch", "kind", "payload"])

    return run


# --- shards -----------------------------------------------------------------------------


def shard_trie(plan: Plan, w: np.ndarray, v: np.ndarray, u: np.ndarray, count: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """The trie of sorted training paths with their counts: its buffer, the count of each
    first-level node, and how many of those words have no other shard."""
    new_w = np.concatenate(([True], w[1:] != w[:-1])) if len(w) else np.zeros(0, bool)
    new_v = new_w | np.concatenate(([True], v[1:] != v[:-1])) if len(w) else new_w
    node_w, node_v = np.cumsum(new_w) - 1, np.cumsum(new_v) - 1
    words, pairs = w[new_w], v[new_v]
    parent = node_w[new_v]
    c1, c2, c3 = (np.bincount(x, count, n) for x, n in ((node_w, len(words)), (node_v, len(pairs)), (np.arange(len(u)), len(u))))
    # Frequent paths have their exact counts from the plan, as other shards hold parts of them.
    key1, key2 = words, mixed(words[parent], pairs) if len(words) else words
    key3 = mixed(key2[node_v], u) if len(words) else words
    places = [plan.place(k, x) for k, x in enumerate((key1, key2, key3))]
    c1, c2, c3 = (np.where(i >= 0, plan.counts[k][np.maximum(i, 0)] if len(plan.counts[k]) else 0, c)
                  for k, (i, c) in enumerate(zip(places, (c1, c2, c3))))
    ends, starts = words == END, pairs == START
    over = np.where(starts[node_v], 0, c3) if len(u) else c3
    values = [
        (quantise(plan.upper(c1, np.zeros(len(c1)), np.zeros(len(c1)))), quantise(np.where(ends, 0, plan.lower(c1, np.zeros(len(c1)))))),
        (quantise(plan.upper(c1[parent], c2, np.zeros(len(c2)))), quantise(np.where(ends[parent], 0, plan.lower(c1[parent], c2)))),
        (quantise(plan.upper(c1[parent][node_v], c2[node_v], over)), quantise(np.where(ends[parent][node_v], 0, plan.lower(c1[parent][node_v], c2[node_v])))),
    ]
    buffer = Trie.build([words, pairs, u], [np.zeros(0), parent, node_v], values)
    return buffer, c1, int((places[0] < 0).sum())


def ask(trie: Trie, plan: Plan, w: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Model term of each path (sorted by w, v), and its first-level node or -1."""
    n = len(w)
    if not n:
        return np.zeros(0), np.zeros(0, np.int64)
    first = np.concatenate(([True], w[1:] != w[:-1]))
    group = np.cumsum(first) - 1
    one = trie.ids[0].find(w[first])[group]
    pair = first | np.concatenate(([True], v[1:] != v[:-1]))
    of = np.cumsum(pair) - 1
    two = _step(trie, 1, one[pair], v[pair])[of]
    three = _step(trie, 2, two, u)
    upper, lower = np.zeros(n, np.uint16), np.full(n, quantise(np.log10(np.array([plan.prior])))[0])
    for level, nodes in enumerate((one, two, three)):
        some = np.flatnonzero(nodes >= 0)
        upper[some] = trie.values[level][0][nodes[some]]
        lower[some] = trie.values[level][1][nodes[some]]
    return np.where(one >= 0, restored(upper), 0.0) - np.where(w == END, 0.0, restored(lower)), one


def _step(trie: Trie, level: int, parent: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.full(len(parent), -1, np.int64)
    at = np.flatnonzero(parent >= 0)
    key = (parent[at].astype(np.uint64) << np.uint64(Trie.ID_BITS[level])) + ids[at]
    out[at] = trie.ids[level].find(key)
    return out


def _answer_shard(plan: Plan, messages: list[tuple[int, pa.Buffer]]) -> tuple[int, list[tuple[int, np.ndarray, list[np.ndarray]]]]:
    """Distinct words the shard adds, and for each message the texts it names and their sums."""
    parts = [_unpacked(p) for _, p in messages]
    w = np.concatenate([_numbers(x[0], 8) for x in parts])
    v = np.concatenate([_numbers(x[1], 5) for x in parts])
    u = np.concatenate([_numbers(x[2], 4) for x in parts])
    count = np.concatenate([x[3].astype(np.int64) for x in parts])
    texts_of = [(x[4].copy(), x[5].copy()) for x in parts]
    sizes = [len(x[3]) for x in parts]
    del parts
    order = np.lexsort((u, v, w))
    w, v, u, count = w[order], v[order], u[order], count[order]
    # Frequent words and pairs are nodes here even if their training paths are elsewhere.
    often = plan.place(0, w)
    taught = (count > 0) | ((often >= 0) & (plan.counts[0][often] > 0 if len(plan.counts[0]) else False))
    tw, tv, tu = w[taught], v[taught], u[taught]
    new = np.concatenate(([True], (tw[1:] != tw[:-1]) | (tv[1:] != tv[:-1]) | (tu[1:] != tu[:-1]))) if len(tw) else np.zeros(0, bool)
    added = np.add.reduceat(count[taught], np.flatnonzero(new)) if len(tw) else np.zeros(0, np.int64)
    buffer, words, fresh = shard_trie(plan, tw[new], tv[new], tu[new], added)
    lm, node = ask(Trie(buffer), plan, w, v, u)
    seen = node >= 0
    known = np.where(seen, words[np.maximum(node, 0)] if len(words) else 0.0, 0.0)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    base = np.log10(known + 0.1)
    out, at = [], 0
    for (batch, _), size, (often, texts) in zip(messages, sizes, texts_of):
        own = back[at:at + size]
        at += size
        often, texts = often.astype(np.int64), texts.astype(np.int64)
        n = int(texts.max()) + 1
        out.append((batch, n, _sums(n, texts, *(np.repeat(y[own], often) for y in (lm, base, seen)))))
    return fresh, out


def _shards(plan: Plan, held: int = 48 << 20):
    """Works through the shards of a partition, which come one after another; keeps sums per
    slice and hands them on at the end, or when they exceed ``held`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
        sums: dict[int, list[np.ndarray]] = {}
        now, waiting, out, size = None, [], [], 0

        def close() -> None:
            nonlocal size
            if waiting:
                fresh, answers = _answer_shard(plan, waiting)
                out.append((now, fresh, _WORDS, b""))  # in the place of the slice's number
                for batch, n, own in answers:
                    kept = sums.get(batch)
                    if kept is None or len(kept[0]) < n:
                        grown = [np.zeros(n) for _ in own]
                        for g, x in zip(grown, kept or []):
                            g[:len(x)] = x
                        size += sum(x.nbytes for x in grown) - sum(x.nbytes for x in kept or [])
                        kept = sums[batch] = grown
                    for g, x in zip(kept, own):
                        g[:n] += x
                waiting.clear()

        def handed() -> None:
            nonlocal size
            for batch, own in sums.items():
                some = np.flatnonzero(own[0] + own[1] + own[2])
                out.append((0, batch, _SUMS, _packed([some, *(x[some] for x in own)])))
            sums.clear()
            size = 0

        def table() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["sub", "batch", "kind", "payload"])

        for b in batches:
            # Payloads stay where Arrow has them until their shard's turn.
            for i, (sub, batch, kind) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]))):
                payload = b.column(3)[i].as_buffer()
                if sub != now:
                    close()
                    now = sub
                    if size > held:
                        handed()
                if kind == _PATHS:
                    waiting.append((batch, payload))
                else:
                    out.append((sub, batch, kind, payload.to_pybytes()))
            if out:
                yield table()
        close()
        handed()
        yield table()

    return run


def _gather(group: pa.Table) -> pa.Table:
    """Adds up the sums of a slice's documents."""
    kinds = group.column("kind").to_pylist()
    payloads = group.column("payload").to_pylist()
    docs = next(pa.ipc.open_stream(p).read_all() for k, p in zip(kinds, payloads) if k == _DOCS)
    totals = np.zeros((3, docs.num_rows))
    for k, p in zip(kinds, payloads):
        if k == _SUMS:
            some, *own = _unpacked(p)
            for total, x in zip(totals, own):
                total[some] += x
    return pa.table([docs.column("id"), docs.column("n_tokens"), pa.array(np.rint(totals[2]).astype(np.int64)), pa.array(totals[1]), pa.array(totals[0])],
                    ["id", "n_tokens", "n_known", "base", "lm"])


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score); ``train`` marks the rows to learn from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), train.alias("train"))
    plan = make_plan(rows)
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, plan.shards * SHARD_BYTES // TASK_BYTES)
    answers = written(
        arrow_map(arrow_map(rows, _sender(plan), _MESSAGES).repartition(parts, "sub").sortWithinPartitions("sub"),
                  _shards(plan), _MESSAGES), "answers")
    # Words are counted where they have their one shard; frequent ones are the plan's.
    distinct = (answers.filter(F.col("kind") == _WORDS).agg(F.sum("batch")).first()[0] or 0) + int((plan.counts[0] > 0).sum())
    kind = docs.schema[id_col].dataType.simpleString()
    sums = answers.filter(F.col("kind") != _WORDS).groupBy("batch").applyInArrow(
        _gather, f"id {kind}, n_tokens long, n_known long, base double, lm double")
    n, v = plan.tokens, int(distinct)
    unseen = float(np.log10(plan.prior * DISCOUNT * max(v, 1) / max(n, 1)))
    first = float(np.log10(plan.documents + plan.prior))
    return sums.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(n + 0.1 * (v + 1)))).alias("base_score"),
        (F.col("lm") + (F.col("n_tokens") - F.col("n_known")) * unseen - first).alias("score"),
    )
