"""SimHash near-duplicates through pivot distance tables.

**Fingerprints.** Texts are lower-cased (A-Z), cut into words [^\\x20\\x09-\\x0D]+ and
3-word shingles, repeats included, joined by a space (fewer words: the whole
sequence; none: fingerprint zero). Each shingle is hashed by XXH64 (seed 42); a
fingerprint bit is 1 if more than half the hashes have it. Documents aren't shuffled.

**Links** (Hamming distance at most 2) are sought between distinct fingerprints,
so copies of any number are one row. The 64 bits are cut into four blocks of 16;
linked fingerprints agree in two blocks at least, so each pair meets under one of
six keys of 32 bits. A group with more than ``GROUP`` members is split: the bits left
are cut into four again, and six finer keys replace the key (then once more). After
three rounds a group shares 56 bits, so no group exceeds 256 members then and none
is dropped or capped.

**Within a group** a pivot table holds the distances of each member to ``PIVOTS``
reference fingerprints. |d(x,p) - d(y,p)| <= d(x,y), so a pair whose largest
coordinate difference exceeds the limit is discarded; survivors are verified by
their exact distance. A group returns a spanning forest of its links, not its pairs.

**Classes** are the connected components of all forests, by alternating star
steps on DataFrames; each step is written to the shared folder. Every fingerprint gets the
smallest doc_id of its class.

Defined results: null and empty texts have fingerprint zero and link like any other;
repeated rows each give a row; ties can't change a class; rows with a null id get a
class too, whose id is the smallest non-null doc_id in it (null if there is none);
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from claimlens.llm.common import LOWER_AZ, arrow_map, to_bytes, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
PIVOTS = 16
GROUP = 256

_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    words = text.translate(LOWER_AZ).split()
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-size])).tolist()
    return [xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, (ends[size - 1:] - 1).tolist())]


def majority_bits(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of each document; ``ends`` closes its range of hashes (uint64)."""
    out = np.zeros(len(ends), np.uint64)
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    full = np.flatnonzero(ends > begins)
    if not len(full):
        return out
    # Ranges are summed in chunks that the 16-bit fields can hold.
    chunks = -(-(ends - begins)[full] // _FIELD)
    first = np.cumsum(chunks) - chunks
    starts = np.repeat(begins[full] - first * _FIELD, chunks) + np.arange(int(chunks.sum())) * _FIELD
    half = (ends - begins)[full]
    for lane in range(8):
        spread = _SPREAD[(hashes >> np.uint64(8 * lane)).astype(np.uint8)]
        for part in range(2):
            sums = np.add.reduceat(spread[:, part], starts)
            for b in range(4):
                count = np.add.reduceat(((sums >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64), first)
                out[full] |= np.where(2 * count > half, _BITS[8 * lane + 4 * part + b], np.uint64(0))
    return out


_FIELD = 65_535
#: For each byte its bits 0-3 and 4-7 in 16-bit fields; sums hold up to 65,535 hashes.
_SPREAD = np.array([[sum(((v >> (4 * p + b)) & 1) << (16 * b) for b in range(4)) for p in range(2)] for v in range(256)], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp, text_hash) of each row; fp is the fingerprint's bits as a signed long,
    text_hash is Spark's xxhash64 of a text that isn't null. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = to_bytes(batch.column(1))
            hashes = [np.array(shingle_hashes(t, size), np.uint64) for t in texts]
            own = np.fromiter((xxh64_intdigest(t, 42) for t in texts), np.uint64, len(texts))
            ends = np.cumsum([len(h) for h in hashes]) if hashes else np.zeros(0, np.int64)
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(majority_bits(flat, ends).view(np.int64)), pa.array(own.view(np.int64))],
                ["id", "fp", "text_hash"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), run, f"id {kind}, fp long, text_hash long")


def masks(rounds: int = 3) -> list[list[tuple[int, int]]]:
    """For each round (parent's number, mask): the bits a group shares.

    The bits a parent leaves open are cut into four; a child shares two of them more.
    """
    full, out, parents = (1 << 64) - 1, [], [0]
    for _ in range(rounds):
        made = []
        for k, mask in enumerate(parents):
            free = [b for b in range(64) if not mask >> b & 1]
            size = len(free) // 4
            blocks = [sum(1 << b for b in free[i * size:(i + 1) * size]) for i in range(4)]
            made += [(k, (mask | x | y) & full) for x, y in combinations(blocks, 2)]
        out.append(made)
        parents = [m for _, m in made]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Reference fingerprints, spread by multiples of the golden ratio.
_REFERENCES = np.array([(k * 0x9E3779B97F4A7C15) % (1 << 64) for k in range(1, PIVOTS + 1)], np.uint64)


def pivot_table(members: np.ndarray, references: np.ndarray = _REFERENCES) -> np.ndarray:
    return np.bitwise_count(members[:, None] ^ references[None, :]).astype(np.int8)


def group_links(members: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of a group at distance ``limit`` or less."""
    table = pivot_table(members)
    near = np.ones((len(members), len(members)), bool)
    for p in range(table.shape[1]):  # the largest coordinate difference, one coordinate at a time
        near &= np.abs(table[:, None, p] - table[None, :, p]) <= limit
    i, j = np.nonzero(np.triu(near, 1))
    keep = np.bitwise_count(members[i] ^ members[j]) <= limit
    return i[keep], j[keep]


def spanning_forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _forest(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for group in batch.column(0):
                members = np.sort(np.array(group.as_py(), np.int64))
                i, j = group_links(members.view(np.uint64), limit)
                if len(i):
                    root = spanning_forest(len(members), i, j)
                    tied = np.flatnonzero(root != np.arange(len(members)))
                    a.append(members[tied])
                    b.append(members[root[tied]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], ["a", "b"])

    return run


def links(distinct: DataFrame, limit: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """(a, b): a forest of links that connects what links of at most ``limit`` (2 or fewer)
    bits connect, over a column ``fp`` of distinct fingerprints."""
    if limit > 2:
        raise ValueError("four blocks of which two agree hold for at most two differing bits")
    found, rows = None, distinct.select("fp", F.lit(0).alias("m"))
    levels = masks()
    for level, made in enumerate(levels):
        parents = max(k for k, _ in made) + 1
        children = F.array(*[
            F.array(*[F.struct(F.lit(c).alias("m"), F.lit(_signed(x)).cast("long").alias("bits")) for c, (k, x) in enumerate(made) if k == p])
            for p in range(parents)])
        keyed = rows.select("fp", F.explode(F.element_at(children, F.col("m") + 1)).alias("c")).select(
            "fp", F.col("c.m").alias("m"), F.col("fp").bitwiseAND(F.col("c.bits")).alias("key"))
        sizes = keyed.groupBy("m", "key").agg(F.count("*").alias("n")).filter("n > 1")
        if level < len(levels) - 1:
            sizes = written(sizes, "groups", small=True)
            cold, hot = sizes.filter(F.col("n") <= group), sizes.filter(F.col("n") > group)
        else:  # 8 bits are left, so a group has 256 members at most
            cold, hot = sizes, None
        members = keyed.join(cold.select("m", "key"), ["m", "key"]).groupBy("m", "key").agg(F.collect_list("fp").alias("members"))
        part = arrow_map(members.select("members"), _forest(limit), "a long, b long")
        found = part if found is None else found.unionByName(part)
        if hot is None or hot.isEmpty():
            return found.distinct()
        rows = written(keyed.join(hot.select("m", "key"), ["m", "key"], "left_semi").select("fp", "m"), "split", small=True)
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b); root is the component's smallest node, which has no row.

    Large-star and small-star steps in turn, until the edges stay as they are.
    """
    edges, before = written(edges, "edges", small=True), None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        # Every smaller neighbour and the node itself point to the smallest.
        edges = written(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges", small=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id, text_hash, class_root) of each row; class_root is one of the class's
    fingerprints and names it, also where two classes have the same smallest id."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    tied = components(links(distinct, limit))
    # Only fingerprints with links need more than their own smallest id.
    ends = tied.select(F.col("node").alias("fp"), "root").unionByName(
        tied.select(F.col("root").alias("fp"), "root").distinct())
    placed = ends.join(distinct, "fp")
    least = placed.groupBy("root").agg(F.min("least").alias("class_least"))
    linked = placed.join(least, "root").select("fp", "root", "class_least")
    classes = distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("class_least").isNotNull(), F.col("class_least")).otherwise(F.col("least")).alias("component_id"))
    return fps.join(classes, "fp").select(
        F.col("id").alias(id_col), hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "text_hash",
        hex_digits(F.col("root")).alias("class_root"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
