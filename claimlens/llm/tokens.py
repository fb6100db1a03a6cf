"""Words of many texts as small integers, for vectorised counting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

from claimlens.llm.common import LOWER_AZ, to_bytes

#: Texts are handled this many bytes at a time, so a large batch doesn't hold all its words at once.
SLICE_BYTES = 8 << 20


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive rows with about ``most`` bytes, one row at least."""
    texts, size, first = [], 0, 0
    for i, t in enumerate(to_bytes(batch.column(column))):
        texts.append(t)
        size += len(t)
        if size >= most:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words [^\\x20\\x09-\\x0D]+ of the lower-cased (A-Z) texts: the number of each in the
    list of distinct words, words per text, and that list."""
    numbers: dict[bytes, int] = {}
    number, parts = numbers.setdefault, []
    for t in texts:
        words = t.translate(LOWER_AZ).split()
        parts.append(np.fromiter((number(w, len(numbers)) for w in words), np.int32, len(words)))
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), sizes, list(numbers)


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the ordered pair of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0xD6E8FEB86659FD93) + (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
