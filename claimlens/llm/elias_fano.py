"""Elias-Fano sequences and an n-gram trie of them, on numpy arrays.

A monotone sequence of n values below u keeps the low log2(u/n) bits of each value
packed, and the high bits as a bit vector with a one a value and a zero a step.
All parts lie in one buffer, so a trie can be mapped from a file or a byte column
without being unpacked. All searches take many keys at once.
"""

from __future__ import annotations

import numpy as np

_POP8 = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Position of the k-th one in a byte (8 if there are fewer).
_SELECT8 = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


class Bits:
    """A bit vector with select for ones or zeros through a running count a byte-octet."""

    def __init__(self, data: np.ndarray, counts: np.ndarray):
        self.data, self.counts = data, counts  # bytes (a multiple of 8), ones before each 8 bytes

    @staticmethod
    def build(ones: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        data = np.zeros((size // 64 + 1) * 8, np.uint8)
        np.bitwise_or.at(data, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        per = np.bitwise_count(data.view(np.uint64)).astype(np.int64)
        return data, np.concatenate(([0], np.cumsum(per)))

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) one, or zero."""
        before = self.counts if one else np.arange(len(self.counts), dtype=np.int64) * 64 - self.counts
        word = np.searchsorted(before, k, "right") - 1
        left, at = k - before[word], word * 8
        out = np.full(len(k), -1, np.int64)
        for i in range(8):
            byte = self.data[np.minimum(at + i, len(self.data) - 1)]
            if not one:
                byte = ~byte
            here = _POP8[byte]
            hit = (out < 0) & (left < here)
            out[hit] = (at[hit] + i) * 8 + _SELECT8[byte[hit], left[hit]]
            left = np.where(out < 0, left - here, left)
        return out


class EliasFano:
    """A monotone sequence of values below 2^62."""

    def __init__(self, n: int, low: int, lows: np.ndarray, high: Bits):
        self.n, self.low, self.lows, self.high = n, low, lows, high

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> list[np.ndarray]:
        """Header, low bits, high bits and their counts, ready to be laid in a buffer."""
        n = len(values)
        low = max(0, (universe // max(1, n)).bit_length() - 1)
        v = values.astype(np.uint64)
        lows = np.zeros((n * low + 63) // 64 + 2, np.uint64)
        if low and n:
            part = v & np.uint64((1 << low) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(lows, word, part << shift)
            over = shift + np.uint64(low) > 64
            np.bitwise_or.at(lows, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        tops = (v >> np.uint64(low)).astype(np.int64)
        size = n + (universe >> low) + 2
        data, counts = Bits.build(tops + np.arange(n), size)
        return [np.array([n, low], np.int64), lows, data, counts]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> EliasFano:
        (n, low), lows, data, counts = parts
        return cls(int(n), int(low), lows, Bits(data, counts))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        # Two steps to the left, as a shift by 64 isn't defined.
        upper = (self.lows[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return ((self.lows[word] >> shift) | upper) & np.uint64((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        top = self.high.select(i, True) - i
        return (top.astype(np.uint64) << np.uint64(self.low)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x (n if there is none)."""
        x = x.astype(np.uint64)
        top = (x >> np.uint64(self.low)).astype(np.int64)
        # Values whose high part is ``top`` lie between two zeros of the bit vector.
        begin = np.where(top > 0, self.high.select(np.maximum(top - 1, 0), False) - np.maximum(top - 1, 0), 0)
        end = self.high.select(top, False) - top
        want = x & np.uint64((1 << self.low) - 1)
        while True:
            live = np.flatnonzero(begin < end)
            if not len(live):
                return begin
            mid = (begin[live] + end[live]) >> 1
            less = self._low(mid) < want[live]
            begin[live[less]] = mid[less] + 1
            end[live[~less]] = mid[~less]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of x, or -1."""
        i = self.successor(x)
        found = np.flatnonzero(i < self.n)
        out = np.full(len(x), -1, np.int64)
        same = self.access(i[found]) == x[found].astype(np.uint64)
        out[found[same]] = i[found[same]]
        return out


def lay(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one buffer: how many, then type, length and bytes of each, aligned to 8."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        data = a.tobytes()
        out += [a.dtype.str.encode().ljust(8), np.array([len(a)], np.int64).tobytes(), data, b"\0" * (-len(data) % 8)]
    return b"".join(out)


def mapped(buffer) -> list[np.ndarray]:
    """Views of the arrays in a buffer (bytes, a memory map, an Arrow buffer); nothing is copied."""
    view, at = memoryview(buffer), 8
    out = []
    for _ in range(int(np.frombuffer(view[:8], np.int64)[0])):
        kind = np.dtype(bytes(view[at:at + 8]).decode().strip())
        n = int(np.frombuffer(view[at + 8:at + 16], np.int64)[0])
        out.append(np.frombuffer(view, kind, n, at + 16))
        at += 16 + -(-n * kind.itemsize // 8) * 8
    return out


class Trie:
    """Words w, under each the words before it, under those the words before them.

    Level 1 holds the ids of w; a deeper level holds, for each node of the level above,
    its children's ids. Ids of a level follow node by node, so (node << bits) + id is
    monotone, and a child is found by a successor search among its parent's. The
    pointers to a node's children are monotone too. Each node has two quantised values.
    """

    ID_BITS = (62, 36, 32)

    def __init__(self, buffer):
        arrays = mapped(buffer)
        self.levels = int(arrays[0][0])
        self.ids = [EliasFano.of(arrays[1 + 4 * k:5 + 4 * k]) for k in range(self.levels)]
        at = 1 + 4 * self.levels
        self.pointers = [EliasFano.of(arrays[at + 4 * k:at + 4 + 4 * k]) for k in range(self.levels - 1)]
        self.values = [arrays[at + 4 * (self.levels - 1) + 2 * k:][:2] for k in range(self.levels)]

    @classmethod
    def build(cls, ids: list[np.ndarray], parents: list[np.ndarray], values: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
        """``ids`` and ``parents`` of each level in order; level 1 has no parents."""
        arrays = [np.array([len(ids)], np.int64)]
        for k, own in enumerate(ids):
            bits = cls.ID_BITS[k]
            keys = own if k == 0 else (parents[k].astype(np.uint64) << np.uint64(bits)) + own
            arrays += EliasFano.parts(keys, 1 << bits if k == 0 else (max(1, len(ids[k - 1])) << bits))
        for k in range(len(ids) - 1):
            ends = np.cumsum(np.bincount(parents[k + 1], minlength=len(ids[k])))
            arrays += EliasFano.parts(np.concatenate(([0], ends)), len(ids[k + 1]) + 1)
        for pair in values:
            arrays += list(pair)
        return lay(arrays)

    def find(self, path: list[np.ndarray]) -> list[np.ndarray]:
        """For each level the nodes of the paths (ids of w, of the word before, ...), -1 where none."""
        nodes = [self.ids[0].find(path[0])]
        for k in range(1, self.levels):
            at = np.flatnonzero(nodes[-1] >= 0)
            out = np.full(len(path[0]), -1, np.int64)
            key = (nodes[-1][at].astype(np.uint64) << np.uint64(self.ID_BITS[k])) + path[k][at]
            out[at] = self.ids[k].find(key)
            nodes.append(out)
        return nodes

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the nodes' children in the level below."""
        return self.pointers[level].access(node).astype(np.int64), self.pointers[level].access(node + 1).astype(np.int64)
