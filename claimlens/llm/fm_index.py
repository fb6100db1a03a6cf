"""FM-index over a sequence of word ids, on numpy arrays.

The sequence holds runs of words (ids from 1); id 0 ends each run. Parts:

* suffix order by prefix doubling; run ends count as distinct symbols in order of
  position, so sorting ends at the longest run;
* the Burrows-Wheeler sequence in a wavelet matrix: a bit vector with running
  counts for each bit of the alphabet, so access and rank take one step a bit;
* backward search: all phrases at once, one word a step from their ends;
* suffix positions sampled at every ``SAMPLE``-th place and at each run's start;
  other rows step back by the LF mapping until they meet a sample, so no step
  crosses a run's end.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order. ``text`` ends with 0."""
    n = len(text)
    ends = text == 0
    key = text.astype(np.int64) + int(ends.sum())
    key[ends] = np.arange(int(ends.sum()))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    step = 1
    while True:
        ordered = key[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank[order] = new
        if new[-1] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[:-step] = rank[step:]
        key = rank * n + second
        order = np.argsort(key, kind="stable")
        step *= 2


class WaveletMatrix:
    """Access and rank over a sequence of small integers."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []  # running count of ones at each level
        self.zeros: list[int] = []
        at = values
        for level in reversed(range(self.bits)):
            bit = (at >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            at = np.concatenate((at[bit == 0], at[bit == 1]))

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low, high = np.zeros(len(places), np.int64), places.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((symbols >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[low].astype(np.int64), ones[high].astype(np.int64)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def access_rank(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before."""
        at, low = places.astype(np.int64), np.zeros(len(places), np.int64)
        symbol = np.zeros(len(places), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[at + 1] > ones[at]
            a, b = ones[low].astype(np.int64), ones[at].astype(np.int64)
            symbol = symbol * 2 + one
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return symbol, at - low


class FMIndex:
    def __init__(self, text: np.ndarray):
        n = len(text)
        order = suffix_order(text)
        bwt = text[order - 1]  # position 0 follows the last run's end
        counts = np.bincount(text, minlength=int(text.max(initial=0)) + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))  # rows whose suffix begins with a smaller symbol
        self.tree = WaveletMatrix(bwt)
        sampled = (order % SAMPLE == 0) | (bwt == 0)
        self.sampled = sampled
        self.before = np.concatenate(([0], np.cumsum(sampled, dtype=np.int32)))
        self.positions = order[sampled]
        self.n = n

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) of the suffixes that begin with each phrase.

        ``phrases`` has a row of ids for each, padded on the left.
        """
        width = phrases.shape[1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, width + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, width - back].astype(np.int64)
            known = symbol < len(self.first) - 1
            start = self.first[np.where(known, symbol, 0)]
            safe = np.where(known, symbol, 0)
            both = self.tree.rank(np.concatenate((safe, safe)), np.concatenate((low[live], high[live])))
            low[live] = np.where(known, start + both[: len(live)], 0)
            high[live] = np.where(known, start + both[len(live):], 0)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row's suffix."""
        out, at, steps = np.zeros(len(rows), np.int64), rows.astype(np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.positions[self.before[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            if len(todo):
                symbol, rank = self.tree.access_rank(at)
                at = self.first[symbol] + rank
            steps += 1
        return out
