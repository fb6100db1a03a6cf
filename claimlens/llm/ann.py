"""Nearest neighbours by a block matrix join in int8, exact after recomputation.

Vectors are scaled to int8 (one scale a vector). Queries are dealt into row blocks
and candidates into column blocks by a hash of their id; each pair of blocks meets
in one task (queries are sent to every column block, candidates to every row
block). There an integer product of the tiles gives approximate inner products.
With x = s*a + e, |e_i| <= s/2 for each vector, the error of s_q s_c <a_q, a_c> is at
most  s_q/2 * |x_c|_1 + s_c/2 * |x_q|_1 + d * s_q s_c / 4,  so

    a pair can be among the k nearest only if its upper bound reaches the k-th
    largest lower bound.

Surviving pairs are recomputed in double precision from the original vectors and
kept in a heap of k a query; the heaps of the column blocks are merged by a window
with a limit that Spark applies before the shuffle.

Candidates pass in tiles of ``TILE`` rows, so a task holds one query block, one
tile and the heaps. The integer products fit float32 exactly while 127^2 * d < 2^24
(d <= 1,040); wider vectors use float64 products.

Defined results: vectors null, empty, zero or with a null or non-finite component
take no part, nor do rows without id; vectors of unequal length aren't compared
(queries and candidates meet only within one length); rows equal in id and
vector count once; a candidate with the query's id is its own; ties go to the smaller id; a query without candidates has no rows; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 4096
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 32768

FOUND_SQL = "query_id long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, the scale of each, and the sum of absolute components of each original row."""
    scale = np.abs(rows).max(axis=1) / 127.0
    scale[scale == 0] = np.finfo(np.float64).tiny  # below what a double can divide by 127
    return np.clip(np.rint(rows / scale[:, None]), -127, 127).astype(np.int8), scale, np.abs(rows).sum(axis=1)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in component order."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


class TopK:
    """The k largest (score, smaller id first) of each query, over many tiles."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.a, self.scale, self.norm = quantise(rows)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)  # the k-th score so far

    def add(self, ids: np.ndarray, rows: np.ndarray) -> int:
        """Takes a tile in; returns how many pairs were recomputed."""
        b, scale, norm = quantise(rows)
        width = rows.shape[1]
        kind = np.float32 if 127 * 127 * width < 1 << 24 else np.float64
        near = (self.a.astype(kind) @ b.astype(kind).T).astype(np.float64)
        near *= self.scale[:, None]
        near *= scale[None, :]
        error = self.scale[:, None] * norm[None, :] / 2 + scale[None, :] * self.norm[:, None] / 2
        error += width / 4 * self.scale[:, None] * scale[None, :]
        error *= 1 + 1e-9  # the bound itself is computed in floating point
        near[self.ids[:, None] == ids[None, :]] = -np.inf
        floor = self.floor
        if len(ids) >= self.k:  # the k-th largest lower bound; a smaller tile can't raise the floor
            low = near - error
            floor = np.maximum(floor, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        # A score equal to the floor may still win by its id.
        q, c = np.nonzero((near + error >= floor[:, None]) & (near > -np.inf))
        for at in range(0, len(q), 1 << 18):
            qs, cs = q[at:at + (1 << 18)], c[at:at + (1 << 18)]
            for i, v, s in zip(qs.tolist(), ids[cs].tolist(), exact_scores(self.rows[qs], rows[cs]).tolist()):
                heap = self.heaps[i]
                if len(heap) < self.k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
        for i in np.unique(q):
            if len(self.heaps[i]) == self.k:
                self.floor[i] = self.heaps[i][0][0]
        return len(q)

    def table(self) -> pa.Table:
        rows = [(int(q), -v, s) for q, heap in zip(self.ids, self.heaps) for s, v in heap]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)] if rows else
                        [pa.array([], t) for t in _FOUND.types], schema=_FOUND)


def _matrix(table: pa.Table) -> np.ndarray:
    data = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float64)
    return data.reshape(table.num_rows, -1)


def _once(table: pa.Table) -> pa.Table:
    """Rows equal in id and vector once; equal ids share a block, so this sees them all."""
    ids, first, count = np.unique(table.column("id").to_numpy(), return_index=True, return_counts=True)
    if len(ids) == table.num_rows:
        return table
    again = np.isin(table.column("id").to_numpy(), ids[count > 1])
    seen: set[tuple[int, bytes]] = set()
    keep = ~again
    for at in np.flatnonzero(again).tolist():
        row = (table.column("id")[at].as_py(), table.column("x")[at].as_py())
        keep[at] = row not in seen
        seen.add(row)
    return table.filter(pa.array(keep))


def _tile_join(k: int):
    def join(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return _FOUND.empty_table()
        queries, candidates = _once(queries), _once(candidates)
        top = TopK(queries.column("id").to_numpy(), _matrix(queries), k)
        for at in range(0, candidates.num_rows, TILE):
            tile = candidates.slice(at, TILE)
            top.add(tile.column("id").to_numpy(), _matrix(tile))
        return top.table()

    return join


def _packed(id_col: str, vector_col: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(vector_col)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.diff(v.offsets.to_numpy())
            ends = np.cumsum(sizes)
            data = [flat[e - n:e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], ["id", "width", "x"])

    return pack


def nearest(df: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
            query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query row."""
    kept = df.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    n, n_queries = kept.agg(F.count("*"), F.count_if(queries)).first()
    across, down = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(n_queries / query_block))
    pack = _packed(id_col, vector_col)

    def packed(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(id_col).cast("long").alias(id_col), vector_col).mapInArrow(
            pack, "id long, width int, x binary")

    def block(of: Column, count: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(of, F.lit(seed)), F.lit(count)).cast("int")

    left = packed(kept.filter(queries)).withColumn("row", block(F.col("id"), down, 1)).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = packed(kept).withColumn("col", block(F.col("id"), across, 2)).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    found = left.groupBy("width", "row", "col").cogroup(right.groupBy("width", "row", "col")).applyInArrow(_tile_join(k), FOUND_SQL)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
