"""Benchmark decontamination with an FM-index per training shard.

Texts are lower-cased (A-Z) and cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+.
A window is 13 consecutive words of a benchmark item, or the whole item if it has
fewer. Every document word inside any occurrence of any window is hit.

The documents are never shuffled: each task gathers whole documents into shards of
bounded size and builds one FM-index per shard. Words that no item has can't be
part of an occurrence; they end runs, and runs shorter than the shortest window
are left out, which changes no result. All windows are searched backwards
together, occurrences are located through sampled suffix positions, and their
word ranges are merged into removal spans.

The benchmark goes to the tasks in blocks of at most ``block_bytes`` of text; its
size is measured first. More than one block means one more pass each, whose hits are written
before the next block is collected; the spans are united by document.

Defined results: a null text or one without words has no words, and is not
contaminated; null or empty items and items without id have no windows; equal items (same text, other
id) all count, and an id that occurs more than once counts once, with the windows of all its texts; repeated documents each give a row; an empty table of documents gives
no rows, an empty benchmark no hits; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from claimlens.llm.common import ALNUM_WORDS, arrow_map, batches_of, code_points_before, ragged, to_bytes, written
from claimlens.llm.fm_index import FMIndex

WINDOW = 13
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 4 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

RESULT = pa.schema([
    ("text_hash", pa.int64()), ("n_words", pa.int64()), ("words", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())),
])
RESULT_SQL = ("text_hash long, n_words long, words array<struct<start:int,end:int>>, "
              "spans array<struct<start:int,end:int>>, items array<string>")


@dataclass
class Phrases:
    """Distinct windows as padded rows of word ids, and the items that have them."""

    words: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    item_from: np.ndarray
    item_of: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], window: int) -> Phrases:
        words: dict[bytes, int] = {}
        number = words.setdefault
        place: dict[str, int] = {}
        parts, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item, text in items:
            own = (text or "").encode().translate(ALNUM_WORDS).split()
            ids = np.fromiter((number(w, len(words) + 1) for w in own), np.int32, len(own))
            if size := min(window, len(ids)):
                rows = np.zeros((len(ids) - size + 1, window), np.int32)
                rows[:, window - size:] = np.lib.stride_tricks.sliding_window_view(ids, size)
                parts.append(rows)
                owners.append(np.full(len(rows), place.setdefault(str(item), len(place))))
        rows, which = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
        # Each phrase with each item once, also where items repeat.
        pairs = np.unique(which.reshape(-1).astype(np.int64) * max(1, len(place)) + np.concatenate(owners))
        phrase, item_of = np.divmod(pairs, max(1, len(place)))
        return cls(words, rows, (rows > 0).sum(axis=1), np.searchsorted(phrase, np.arange(len(rows) + 1)), item_of, np.array(list(place), object))


def shard_hits(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's word ids (0: no item has the word): start, length and phrase of every occurrence."""
    none = np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    keep = sizes >= phrases.lengths.min(initial=1 << 30)
    starts, sizes = starts[keep], sizes[keep]
    if not len(starts):
        return none, none, none
    # The runs one after another, a 0 after each.
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    text[ragged(begin, sizes)] = ids[ragged(starts, sizes)]
    index = FMIndex(text)
    low, high = index.search(phrases.rows, phrases.lengths)
    count = high - low
    at = index.locate(ragged(low, count))
    run = np.searchsorted(begin, at, "right") - 1
    which = np.repeat(np.arange(len(low)), count)
    return at - begin[run] + starts[run], phrases.lengths[which], which


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))
    return list(zip(starts[new].tolist(), ends[last].tolist()))


def _finder(phrases: Phrases, id_col: str, text_col: str, shard_bytes: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = phrases.words.get
        for shard in batches_of(batches, shard_bytes):
            texts = to_bytes(shard.column(text_col).combine_chunks())
            sizes, parts = [], []
            for t in texts:
                own = t.translate(ALNUM_WORDS).split()
                sizes.append(len(own))
                parts.append(np.fromiter((lookup(w, 0) for w in own), np.int32, len(own)))
                parts.append(np.zeros(1, np.int32))  # documents never touch
            ends = np.cumsum(np.array(sizes, np.int64) + 1)
            at, length, which = shard_hits(np.concatenate(parts) if parts else np.zeros(0, np.int32), phrases)
            n = len(texts)
            words, spans, items = [[]] * n, [[]] * n, [[]] * n
            owner = np.searchsorted(ends, at, "right")
            order = np.argsort(owner, kind="stable")
            owner, at, length, which = owner[order], at[order], length[order], which[order]
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for part in np.split(np.arange(len(owner)), cuts) if len(owner) else []:
                d = int(owner[part[0]])
                first = at[part] - (ends[d] - sizes[d] - 1)
                ranges = _merge(first, first + length[part])
                words[d] = [{"start": s, "end": e} for s, e in ranges]
                spans[d] = _spans(texts[d], ranges)
                own = np.unique(which[part])
                owned = phrases.item_of[ragged(phrases.item_from[own], phrases.item_from[own + 1] - phrases.item_from[own])]
                items[d] = sorted(phrases.items[np.unique(owned)].tolist())
            keys = np.array([xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)
            columns = [shard.column(id_col).combine_chunks(), pa.array(keys), pa.array(sizes, pa.int64())]
            columns += [pa.array(v, RESULT.field(k).type) for k, v in (("words", words), ("spans", spans), ("items", items))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *RESULT.names])

    return find


def _spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Code-point ranges from the first word's start to the last word's end."""
    found = [m.span() for m in _WORD.finditer(text.translate(ALNUM_WORDS))]
    edges = code_points_before(text, np.array([(found[s][0], found[e - 1][1]) for s, e in ranges]))
    return [{"start": int(s), "end": int(e)} for s, e in edges]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The items (i, t) in blocks of about ``block_bytes``, by a hash."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("length(t) > 0 AND i IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t") + F.length("i"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return [items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: id, text_hash (as Spark's xxhash64 of a text that isn't null), n_words, hit word ranges, removal spans (code
    points, end exclusive), items with occurring windows (sorted as text), n_hit,
    contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    passes = []
    for block in blocks:
        phrases = Phrases.of([(r.i, r.t) for r in block.collect()], window)
        found = arrow_map(docs.select(id_col, text_col), _finder(phrases, id_col, text_col, shard_bytes), f"`{id_col}` {id_type}, {RESULT_SQL}")
        if len(blocks) > 1:  # written before the next block comes to the driver: one block is held at a time
            found = written(found if not passes else found.filter(F.size("items") > 0), "hits")
        passes.append(found)
        del phrases
    found = passes[0] if len(passes) == 1 else _united(passes, id_col)
    n_hit = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + (w["end"] - w["start"]).cast("long"))
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _united(passes: list[DataFrame], id_col: str) -> DataFrame:
    """Spans of several blocks: the first pass gives the rows, all hits join by id and text."""
    hits = passes[0].filter(F.size("items") > 0)
    for more in passes[1:]:
        hits = hits.unionByName(more.filter(F.size("items") > 0))
    merged = hits.groupBy(F.col(id_col).alias("__id"), F.col("text_hash").alias("__key")).agg(
        *[_merged(F.flatten(F.collect_set(c))).alias(f"__{c}") for c in ("words", "spans")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("__items"),
    )
    on = passes[0][id_col].eqNullSafe(merged["__id"]) & (passes[0]["text_hash"] == merged["__key"])
    return passes[0].join(merged, on, "left").select(
        id_col, "text_hash", "n_words", *[F.coalesce(f"__{c}", F.col(c)).alias(c) for c in ("words", "spans", "items")])


def _merged(ranges):
    """Sorted ranges with touching ones joined."""
    def add(acc, r):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                          F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= r["start"]), joined).otherwise(
            F.concat(acc, F.array(r)))

    kind = "array<struct<start:int,end:int>>"
    return F.aggregate(F.array_sort(ranges), F.array().cast(kind), add)
