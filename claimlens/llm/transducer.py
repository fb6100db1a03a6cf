"""Minimal acyclic transducers: sorted words in, lexicographic ordinals out.

``build`` makes the trie of sorted distinct words (each word adds the bytes behind its
common prefix with the word before), then merges states bottom-up: states of the same
height that agree in finality and in their (byte, target) edges are one. An edge carries
the number of words that come before the ones it leads to, so the sum along a word's path
is the word's place in the sorted list.

A state's edges are found by rank in a 256-bit map of its bytes, so many words walk at once in
vectorised steps. Several transducers laid end to end (``Fleet``) walk together: a word is
dealt to the one whose range of words it falls into.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from claimlens.llm.common import ragged

_U = np.uint64


@dataclass
class Transducer:
    first: bytes  # its first word
    n: int  # words
    root: int
    final: np.ndarray  # bool, by state
    bits: np.ndarray  # uint64, four words a state: the bytes that have an edge
    base: np.ndarray  # int32, four a state: number of the first edge of each word of the map
    target: np.ndarray  # int32, by edge
    out: np.ndarray  # int32, by edge: words before those behind the edge

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.final, self.bits, self.base, self.target, self.out))

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the transducer's words, -1 if it isn't one."""
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        return walk(self, data, starts, ends, np.full(len(words), self.root, np.int64))

    def word(self, ordinal: int) -> bytes:
        """The word at a place: at each state the last edge whose output isn't beyond it."""
        state, spelled = self.root, bytearray()
        while not (self.final[state] and ordinal == 0):
            edges, labels = [], []
            for k in range(4):
                at = int(self.base[4 * state + k])
                for b in range(64):
                    if int(self.bits[4 * state + k]) >> b & 1:
                        edges.append(at)
                        labels.append(64 * k + b)
                        at += 1
            k = int(np.searchsorted(self.out[edges], ordinal, side="right")) - 1
            spelled.append(labels[k])
            ordinal -= int(self.out[edges[k]])
            state = int(self.target[edges[k]])
        return bytes(spelled)

    def arrays(self) -> list[np.ndarray]:
        return [self.final, self.bits, self.base, self.target, self.out]


def walk(t: Transducer, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Summed outputs of the byte ranges that end in a final state, -1 for others; all walk in step."""
    got = np.full(len(starts), -1, np.int64)
    live, at, end = np.arange(len(starts)), starts, ends
    total = np.zeros(len(starts), np.int64)
    while len(live):
        done = at == end
        if done.any():
            there = t.final[state[done]]
            got[live[done][there]] = total[done][there]
            go = ~done
            live, at, end, state, total = live[go], at[go], end[go], state[go], total[go]
        byte = data[at]
        cell = 4 * state + (byte >> 6)
        bit = _U(1) << (byte & 63).astype(_U)
        bits = t.bits[cell]
        go = (bits & bit) != 0
        if not go.all():
            live, at, end, total, cell, bit, bits = live[go], at[go], end[go], total[go], cell[go], bit[go], bits[go]
        edge = t.base[cell] + np.bitwise_count(bits & (bit - _U(1)))
        total = total + t.out[edge]
        state = t.target[edge].astype(np.int64)
        at = at + 1
    return got


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + _U(seed)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _trie(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parent, byte and depth of each node in order of creation (0 is the root), and the words' end nodes."""
    sizes = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(words), np.uint8)
    shared, live, k = np.zeros(len(words), np.int64), np.arange(1, len(words)), 0
    while len(live):
        live = live[(sizes[live] > k) & (sizes[live - 1] > k)]
        live = live[data[begin[live] + k] == data[begin[live - 1] + k]]
        k += 1
        shared[live] = k
    if ((sizes == shared) | (sizes == 0)).any():
        raise ValueError("words must be sorted, distinct and not empty")
    new = sizes - shared
    first = np.cumsum(new) - new + 1
    depth = ragged(shared + 1, new)
    parent = np.arange(int(new.sum()), dtype=np.int64)  # the node before, but for a word's first new node
    path = [0]
    heads = np.zeros(len(words), np.int64)
    for i, (s, f, n) in enumerate(zip(shared.tolist(), first.tolist(), new.tolist())):
        heads[i] = path[s]
        path[s + 1:] = range(f, f + n)
    parent[first - 1] = heads
    byte = data[ragged(begin + shared, new)]
    return np.concatenate(([-1], parent)), np.concatenate((np.zeros(1, np.uint8), byte)), np.concatenate(([0], depth)), first + new - 1


def build(words: list[bytes]) -> Transducer:
    """The minimal transducer of sorted, distinct, non-empty words (at least one)."""
    parent, byte, depth, ends = _trie(words)
    n = len(parent)
    final = np.zeros(n, bool)
    final[ends] = True
    below, height = final.astype(np.int64), np.zeros(n, np.int64)
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
    for d in range(int(depth.max()), 0, -1):
        at = by_depth[cuts[d]:cuts[d + 1]]
        np.add.at(below, parent[at], below[at])
        np.maximum.at(height, parent[at], height[at] + 1)

    # Edges in order of (parent, byte): children are created in that order.
    edge = np.argsort(parent[1:], kind="stable") + 1
    degree = np.bincount(parent[1:], minlength=n)
    start = np.cumsum(degree) - degree

    state = np.zeros(n, np.int64)  # the first node of each node's class
    nodes = np.argsort(height, kind="stable")
    cuts = np.searchsorted(height[nodes], np.arange(height.max() + 2))
    for h in range(int(height.max()) + 1):
        at = nodes[cuts[h]:cuts[h + 1]]
        kids = edge[ragged(start[at], degree[at])]
        owner = np.repeat(np.arange(len(at)), degree[at])
        code = state[kids].astype(_U) * _U(257) + byte[kids]
        sign = []
        for seed in (1, 2):
            total = _mixed(final[at].astype(_U) + degree[at].astype(_U) * _U(2), seed)
            np.add.at(total, owner, _mixed(code, seed + 2))
            sign.append(total)
        order = np.lexsort((at, sign[1], sign[0]))
        new = np.ones(len(at), bool)
        new[1:] = (sign[0][order][1:] != sign[0][order][:-1]) | (sign[1][order][1:] != sign[1][order][:-1])
        state[at[order]] = at[order][np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    # The signatures are hashes: merged nodes must really have the same edges.
    if (degree != degree[state]).any() or (final != final[state]).any():
        raise RuntimeError("states differ that were merged")
    mine, theirs = edge[ragged(start, degree)], edge[ragged(start[state], degree)]
    if (byte[mine] != byte[theirs]).any() or (state[mine] != state[theirs]).any():
        raise RuntimeError("states differ that were merged")

    kept = np.flatnonzero(state == np.arange(n))
    number = np.zeros(n, np.int64)
    number[kept] = np.arange(len(kept))
    kids = edge[ragged(start[kept], degree[kept])]
    owner = np.repeat(np.arange(len(kept)), degree[kept])
    before = np.cumsum(below[kids]) - below[kids]
    head = np.cumsum(degree[kept]) - degree[kept]
    out = before - before[head[owner]] + final[kept][owner] if len(kids) else before
    cell = owner * 4 + (byte[kids] >> 6)
    bits = np.zeros(4 * len(kept), _U)
    np.bitwise_or.at(bits, cell, _U(1) << (byte[kids] & 63).astype(_U))
    in_cell = np.bincount(cell, minlength=4 * len(kept))
    return Transducer(words[0], len(words), int(number[state[0]]), final[kept], bits, (np.cumsum(in_cell) - in_cell).astype(np.int32),
                      number[state[kids]].astype(np.int32), out.astype(np.int32))


def _prefix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes as a number, zeros behind the end: orders as the bytes do, up to ties."""
    key = np.zeros(len(starts), _U)
    for k in range(8):
        at = starts + k
        key = (key << _U(8)) | np.where(at < ends, data[np.minimum(at, len(data) - 1)], 0).astype(_U)
    return key


class Fleet:
    """Transducers of several vocabularies, each in consecutive sorted parts, that walk together.

    ``parts``: (vocabulary number, ordinal of the part's first word, transducer).
    """

    def __init__(self, parts: list[tuple[int, int, Transducer]]):
        parts = sorted(parts, key=lambda p: (p[0], p[1]))
        held = [p[2] for p in parts]
        states = np.cumsum([0] + [len(t.final) for t in held])
        edges = np.cumsum([0] + [len(t.target) for t in held])
        self.all = Transducer(
            b"", sum(t.n for t in held), 0, np.concatenate([t.final for t in held]), np.concatenate([t.bits for t in held]),
            np.concatenate([t.base + np.int32(e) for t, e in zip(held, edges)]),
            np.concatenate([t.target + np.int32(s) for t, s in zip(held, states)]), np.concatenate([t.out for t in held]))
        self.roots = np.array([t.root for t in held], np.int64) + states[:-1]
        self.offsets = np.array([p[1] for p in parts], np.int64)
        firsts = np.frombuffer(b"".join(t.first[:8].ljust(8, b"\0") for t in held), ">u8").astype(_U)
        of = np.array([p[0] for p in parts])
        self.range = {int(v): (lo := int(np.searchsorted(of, v)), firsts[lo:int(np.searchsorted(of, v, "right"))]) for v in np.unique(of)}

    def ordinals(self, vocabulary: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ordinals of the byte ranges in one vocabulary, -1 for those it doesn't hold."""
        got = np.full(len(starts), -1, np.int64)
        if vocabulary not in self.range or not len(starts):
            return got
        low, firsts = self.range[vocabulary]
        if len(firsts) == 1:
            part, least = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        else:
            # Parts whose first word has the same eight bytes may hold the word, and so may the one before.
            key = _prefix(data, starts, ends)
            part = np.searchsorted(firsts, key, "right") - 1
            least = np.maximum(np.searchsorted(firsts, key, "left") - 1, 0)
        todo = np.flatnonzero(part >= least)
        while len(todo):
            at = low + part[todo]
            found = walk(self.all, data, starts[todo], ends[todo], self.roots[at])
            got[todo] = np.where(found >= 0, found + self.offsets[at], -1)
            part[todo] -= 1
            todo = todo[(found < 0) & (part[todo] >= least[todo])]
        return got
