"""Best-fit packing through the configuration linear program.

Texts are tokenised, id 2 closes each document, and documents over the sequence
length L are cut into pieces of L tokens (the first may be shorter). Only the
histogram of piece lengths, at most L numbers whatever the input's size, decides
the packing:

    minimise sum x_p   subject to   sum_p a_pl x_p >= h_l

over all configurations p (multisets of lengths that fit L). Multiplicative
weights solve it: each length has a price, which falls as the length gets covered;
a knapsack dynamic program finds the configuration of the highest price, which is
taken a step, and gives a lower bound of any packing. Rounding takes every configuration as often as its value,
rounded down; what is left is placed by best fit, longest first.

The plan (configurations and counts) is small; every piece finds its place from
its rank among the pieces of its length. Ranks come from counts per (length,
bucket), with buckets of bounded size, so no length is ordered in one task.

Defined results: a null text is an empty one and yields the closing id alone;
repeated rows each give their pieces; ties (equal lengths) are ordered by id, piece
and checksum; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.common import arrow_map, to_bytes, written

SEQUENCE = 1024
END_ID = 2
#: Pieces of one length and bucket are ranked in one task.
BUCKET_ROWS = 100_000
#: With up to FEW lengths: steps, the share of the scarcest length that one covers, and the fall of prices.
FEW, FEW_STEPS, STEP, RATE = 100, 400, 0.1, 0.3
#: With more: steps, the fall of a price as its length gets covered, and its growth with the length.
MANY_STEPS, FALL, GROWTH = 300, 0.5, 1.5

#: Splits a text before the merges, as the vocabulary's own tokenizer does.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(ranks_path: str) -> tiktoken.Encoding:
    """Byte-level BPE with the ranks of the file; special strings are ordinary text."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: The pattern's white space; the library's stack ends at runs of about a million characters of it.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}")


def encode(bpe: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a text; long runs of white space are split by hand where the pattern splits them."""
    parts, at = [], 0
    for run in LONG_SPACE.finditer(text):
        last = run.end() - (run.end() < len(text))  # the last one goes with what follows
        piece = bpe._encode_single_piece(text[run.start():last])  # merged without the pattern
        parts += [bpe.encode_to_numpy(text[at:run.start()], disallowed_special=()), np.array(piece, np.uint32)]
        at = last
    parts.append(bpe.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(parts).astype(np.uint32)


def cuts(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than ``longest``."""
    first = n % longest or longest
    if n <= longest:
        return [(0, n)]
    return [(0, first)] + [(s, longest) for s in range(first, n, longest)]


def pieces(docs: DataFrame, ranks_path: str, longest: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = encoder(ranks_path), np.array([END_ID], np.uint32)
        for batch in batches:
            ids, rows = batch.column(0), []
            for d, text in enumerate(to_bytes(batch.column(1))):
                tokens = np.concatenate((encode(bpe, text.decode()), end))
                rows += [(d, k, s, n, zlib.crc32(tokens[s:s + n].astype("<u4").tobytes()))
                         for k, (s, n) in enumerate(cuts(len(tokens), longest))]
            of, k, s, n, crc = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(of)), pa.array(k, pa.int32()), pa.array(s), pa.array(n), pa.array(crc)],
                ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")),
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


# --- the plan ---------------------------------------------------------------------

Configuration = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_configuration(sizes: np.ndarray, prices: np.ndarray, room: int) -> Configuration:
    """The multiset of sizes within ``room`` with the largest total price, by dynamic programming."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    if int((room // sizes).sum()) < 2 * room:  # few sizes: one after another, each as often as it helps
        for s, price in zip(sizes.tolist(), prices.tolist()):
            for _ in range(room // s):
                value = best[:-s] + price
                better = value > best[s:] + 1e-12
                if not better.any():
                    break
                best[s:][better], last[s:][better] = value[better], s
    else:  # many: all at once for each room
        for c in range(1, room + 1):
            n = int(np.searchsorted(sizes, c, "right"))
            if n:
                value = best[c - sizes[:n]] + prices[:n]
                k = int(value.argmax())
                if value[k] > best[c - 1]:
                    best[c], last[c] = value[k], sizes[k]
                    continue
            best[c], last[c] = best[c - 1], 0
    taken: dict[int, int] = {}
    c = room
    while c > 0:
        if last[c]:
            taken[int(last[c])] = taken.get(int(last[c]), 0) + 1
            c -= int(last[c])
        else:
            c -= 1
    return tuple(sorted(taken.items(), reverse=True))


def size_bound(demand: np.ndarray, room: int) -> float:
    """Sequences that any packing needs, by size alone: lengths over half the room share none with each other, and
    those over room - t none with any of at least t."""
    s = np.arange(room + 1)
    size = demand * s
    best = float(size.sum()) / room
    for t in range(1, room // 2 + 1):
        mid, small = (s > room / 2) & (s <= room - t), (s >= t) & (s <= room / 2)
        beside = room * demand[mid].sum() - size[mid].sum()
        best = max(best, float(demand[s > room / 2].sum()) + max(0.0, float(size[small].sum() - beside) / room))
    return best


def solve(demand: np.ndarray, room: int) -> tuple[dict[Configuration, float], float]:
    """Values of configurations that cover the demand of each length (index), as few as possible, and a lower
    bound: the demand at any prices, over the dearest configuration's price, is one.

    Multiplicative weights: prices begin in proportion to the length; the dearest configuration is taken a small
    step, and prices of its lengths fall by a factor that follows the share of their demand that the step covers.
    With up to ``FEW`` lengths the values of the found configurations are then made exact (``master``), whose
    prices find the last configurations that are missing. With more, a step covers a length at once, lengths that are covered
    leave, and after ``MANY_STEPS`` steps the rest is left uncovered.
    """
    sizes = np.flatnonzero(demand)
    few = len(sizes) <= FEW
    need = demand[sizes].astype(np.float64)
    place = {int(s): i for i, s in enumerate(sizes)}
    prices, covered, found, bound = sizes / room, np.zeros(len(sizes)), {}, size_bound(demand, room)

    def dearest(prices: np.ndarray, open_: np.ndarray) -> tuple[Configuration, np.ndarray, np.ndarray]:
        nonlocal bound
        chosen = best_configuration(sizes[open_], prices[open_], room)
        at = np.array([place[s] for s, _ in chosen])
        many = np.array([m for _, m in chosen], np.float64)
        bound = max(bound, float(need[open_] @ prices[open_]) / float(prices[at] @ many))
        return chosen, at, many

    for _ in range(FEW_STEPS if few else MANY_STEPS):
        open_ = np.ones(len(sizes), bool) if few else covered < 1 - 1e-9
        if not open_.any():
            break
        # More than in proportion where steps are large: short lengths are kept to fill the gaps.
        chosen, at, many = dearest(prices if few else (sizes / room) ** GROWTH * np.exp(-FALL * covered), open_)
        step = STEP * float((need[at] / many).min()) if few else float(((1 - covered[at]) * need[at] / many).min())
        covered[at] += step * many / need[at]
        found[chosen] = found.get(chosen, 0.0) + step
        prices[at] *= np.exp(-RATE * step * many / need[at])
        prices /= prices.max()
    if few:
        for s in sizes.tolist():
            found.setdefault(((s, room // s),), 0.0)
        while True:
            found, prices = master(list(found), sizes, need)
            chosen, at, many = dearest(prices, np.ones(len(sizes), bool))
            if chosen in found or float(prices[at] @ many) <= 1 + 1e-7:
                break
            found[chosen] = 0.0
    return {c: x for c, x in found.items() if x > 0}, bound


def master(configs: list[Configuration], sizes: np.ndarray, need: np.ndarray) -> tuple[dict[Configuration, float], np.ndarray]:
    """The best values of the given configurations, and the prices that prove it: simplex on prices y, which
    raise need * y while no configuration costs more than 1. At most as many values as lengths are positive."""
    place = {int(s): i for i, s in enumerate(sizes)}
    n, m = len(configs), len(sizes)
    table = np.zeros((n + 1, m + n + 1))
    for r, config in enumerate(configs):
        for s, many in config:
            table[r, place[s]] = many
        table[r, m + r] = table[r, -1] = 1
    table[-1, :m] = -need / need.max()
    basis = np.arange(m, m + n)
    for _ in range(50 * (m + n)):
        enter = int(table[-1, :-1].argmin())
        if table[-1, enter] >= -1e-10:
            break
        column = table[:-1, enter]
        ratio = np.full(n, np.inf)
        np.divide(table[:-1, -1], column, out=ratio, where=column > 1e-9)
        leave = int(ratio.argmin())
        basis[leave] = enter
        table[leave] /= table[leave, enter]
        factor = table[:, enter].copy()
        factor[leave] = 0
        table -= np.outer(factor, table[leave])
    prices = np.zeros(m + n)
    prices[basis] = np.maximum(table[:-1, -1], 0)
    return dict(zip(configs, np.maximum(table[-1, m:m + n] * need.max(), 0).tolist())), prices[:m]


def best_fit(demand: np.ndarray, room: int) -> dict[Configuration, int]:
    """Best fit, longest first; sequences filled alike are handled together."""
    waiting: dict[int, dict[tuple[int, ...], int]] = {}  # room left -> contents -> how many
    rooms: list[int] = []
    for size in map(int, np.flatnonzero(demand)[::-1]):
        n = int(demand[size])
        while n:
            k = bisect.bisect_left(rooms, size)
            if k < len(rooms):
                left = rooms[k]
                held, count = waiting[left].popitem()
                if not waiting[left]:
                    del waiting[left], rooms[k]
            else:
                left, held, count = room, (), n
            # One after another they'd go to the sequence just begun while it has room.
            each = min(left // size, n)
            used = min(count, n // each)
            n -= used * each
            if held and count > used:
                _hold(waiting, rooms, left, held, count - used)
            _hold(waiting, rooms, left - each * size, held + (size,) * each, used)
    out: dict[Configuration, int] = {}
    for group in waiting.values():
        for held, count in group.items():
            key = tuple(sorted(((s, held.count(s)) for s in set(held)), reverse=True))
            out[key] = out.get(key, 0) + count
    return out


def _hold(waiting: dict, rooms: list[int], left: int, held: tuple[int, ...], count: int) -> None:
    if left not in waiting:
        waiting[left] = {}
        bisect.insort(rooms, left)
    waiting[left][held] = waiting[left].get(held, 0) + count


def plan(histogram: np.ndarray, room: int = SEQUENCE) -> dict[Configuration, int]:
    """How often to use which configuration; the lengths used equal the histogram (index: length).

    Every configuration of the solution is taken as often as its value, rounded down; best fit places what
    is left, some pieces for each fractional value. Where best fit alone needs fewer sequences, it is the plan.
    """
    rest, out = histogram.astype(np.int64).copy(), {}
    if rest[room]:
        out[((room, 1),)] = int(rest[room])
        rest[room] = 0
    if not rest.any():
        return out
    alone = best_fit(rest, room)
    values, _ = solve(rest, room)
    rounded: dict[Configuration, int] = {}
    for config, x in sorted(values.items(), key=lambda v: (-v[1], v[0])):
        if n := min(int(x + 1e-6), *(int(rest[s]) // m for s, m in config)):
            rounded[config] = n
            for s, m in config:
                rest[s] -= n * m
    for config, n in best_fit(rest, room).items():
        rounded[config] = rounded.get(config, 0) + n
    return out | (rounded if sum(rounded.values()) <= sum(alone.values()) else alone)


class Places:
    """Sequence and offset of the piece of each rank among those of its length."""

    def __init__(self, configurations: dict[Configuration, int], room: int):
        entries: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks, base = np.zeros(room + 1, np.int64), 0
        for config, n in configurations.items():
            offset = 0
            for s, m in config:
                entries.setdefault(s, []).append((int(ranks[s]), m, base, offset))
                ranks[s] += m * n
                offset += s * m
            base += n
        self.total = base
        self.table = {s: np.array(e, np.int64) for s, e in entries.items()}

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for s in np.unique(lengths):
            rows = np.flatnonzero(lengths == s)
            table = self.table[int(s)]
            first, many, base, begin = table[np.searchsorted(table[:, 0], ranks[rows], "right") - 1].T
            k = ranks[rows] - first
            sequence[rows], offset[rows] = base + k // many, begin + k % many * s
        return sequence, offset


# --- the job ----------------------------------------------------------------------


def _placer(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.of(b.column("length").to_numpy(), b.column("rank").to_numpy())
            keep = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, ranks_path: str, longest: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text",
         bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    cut = written(pieces(docs, ranks_path, longest, id_col, text_col), "pieces")
    histogram = np.zeros(longest + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``longest`` rows
        histogram[r["length"]] = r["count"]
    places = Places(plan(histogram, longest), longest)

    buckets = max(1, -(-int(histogram.max()) // bucket_rows))
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = (
        rows.withColumn("k", F.row_number().over(within) - 1).join(starts, ["length", "bucket"])
        .select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("k")).alias("rank"))
    )
    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(
        ranked, _placer(places), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    ).withColumnRenamed("id", id_col)
