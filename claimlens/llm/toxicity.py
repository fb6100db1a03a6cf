"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are trained, one on toxic and one on ordinary text, over a common
base trained on ordinary text. A text is cut into short overlapping windows, and each
is compressed twice; what the toxic dictionary saves against the ordinary one is the
window's gain. The gains' largest value, mean, and counts over calibrated steps
go to a logistic model whose weights come from cross-fitting: each fold of the
labelled sample is measured by dictionaries trained on the others.

Dictionaries are small, so their training text is the part of the sample that tells
the classes apart: words in at least ``LEAST`` of one class's documents, ``RATIO``
times as frequent there as in the other class, and beyond chance (``Z_SCORE``). No share
of the class is asked for, so a language with few of its documents has its words too, and
each of the words is in the dictionary: those that training left out are put in front.

Learning takes at most ``SAMPLE`` labelled documents of each class (those with the
smallest hash of the id) of up to ``SAMPLE_CHARS`` characters; of an id with several texts it takes the one with the
smallest hash; scoring is one pass over all texts without shuffle, and the
tasks get only the dictionaries and weights (under 300 kB).

Defined results: null, empty and blank texts get the sample's share of toxic documents; so does
every text if the sample lacks one of the classes; a document labelled more than
once is toxic if any label says so; repeated rows each give a row; ties can't arise;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import ALNUM_WORDS, LOWER_AZ, arrow_map, ragged, to_bytes

#: Labelled documents of a class, and characters of one, that learning takes at most.
SAMPLE, SAMPLE_CHARS = 4_000, 200_000
FOLDS = 3
WINDOW, STEP = 48, 24
BASE_BYTES, OWN_BYTES = 110_000, 2_048
LEVEL = 9
#: A telling word: documents of a class that hold it, how much more frequent there, and how far beyond chance.
LEAST, RATIO, Z_SCORE = 3, 5.0, 5.0
GAIN_STEPS = (2, 3, 4, 5, 6, 7, 8, 10)
_CHUNK = 100_000


def _train(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary's bytes; text too short to train on is taken as it is."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Compresses against the content alone: without entropy tables a window's size shows its matches."""
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def _sizes(compressor: zstandard.ZstdCompressor, data: bytes, segments: np.ndarray) -> np.ndarray:
    out = []
    for at in range(0, len(segments), _CHUNK):
        part = zstandard.BufferWithSegments(data, segments[at:at + _CHUNK].astype(np.uint64).tobytes())
        out.append(np.fromiter(map(len, compressor.multi_compress_to_buffer(part)), np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def cut_windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offset, length) of each window of texts of these sizes, laid end to end; and its text."""
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STEP)), 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    within = ragged(np.zeros(len(sizes), np.int64), count) * STEP
    offset = (np.cumsum(sizes) - sizes)[owner] + within
    return np.stack((offset, np.minimum(WINDOW, sizes[owner] - within)), 1), owner


@dataclass
class Model:
    prior: float
    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def features(self, texts: list[bytes]) -> np.ndarray:
        lower = [t.translate(LOWER_AZ) for t in texts]
        n = len(texts)
        segments, owner = cut_windows(np.array([len(t) for t in lower], np.int64))
        data = b"".join(lower)
        gain = _sizes(_compressor(self.ordinary), data, segments) - _sizes(_compressor(self.toxic), data, segments)
        many = np.bincount(owner, minlength=n)
        some = np.maximum(many, 1)
        most = np.zeros(n)
        np.maximum.at(most, owner, gain)
        over = [np.bincount(owner[gain >= k], minlength=n) for k in GAIN_STEPS]
        return np.stack([most, np.bincount(owner, gain, n) / some, np.log(some), *(o / some for o in over), *(np.log1p(o) for o in over)], 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        full = [i for i, t in enumerate(texts) if t.strip()]
        if len(self.weights) and full:
            x = (self.features([texts[i] for i in full]) - self.mean) / self.scale
            out[full] = 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))
        return out


def _words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_WORDS).split()


def _telling(of: list[bytes], other: list[bytes]) -> list[bytes]:
    """Each text of a class reduced to the words that are far more frequent in it."""
    a, b = (Counter(w for t in texts for w in set(_words(t))) for texts in (of, other))
    n, m = len(of), len(other)

    def tells(word: bytes) -> bool:
        p, q, both = a[word] / n, b[word] / m, (a[word] + b[word]) / (n + m)
        gain = sum(k * math.log(k / (of_all * chance)) for of_all, k, chance in (
            (n, a[word], both), (n, n - a[word], 1 - both), (m, b[word], both), (m, m - b[word], 1 - both)) if k)
        # The difference of shares is the keener test if the class is rare, the likelihood ratio if not.
        return p > RATIO * q and (p - q > Z_SCORE * np.sqrt(both * (1 - both) * (1 / n + 1 / m) + 1e-12) or 2 * gain > Z_SCORE ** 2)

    words = {w for w, c in a.items() if c >= LEAST and tells(w)}
    return [b" ".join(kept) for t in of if (kept := [w for w in _words(t) if w in words])]


def _own(samples: list[bytes]) -> bytes:
    """A class's own dictionary: the trained one behind the words that it lacks."""
    if not samples:
        return b""
    trained = _train(samples, OWN_BYTES, 16)[-OWN_BYTES:]
    held = set(trained.split())
    return b" ".join([*sorted({w for t in samples for w in t.split()} - held), trained])


def fit(texts: list[bytes], toxic: np.ndarray, fold: np.ndarray, share: float | None = None) -> Model:
    """Dictionaries from all rows; weights from rows scored by dictionaries that left out their fold.

    ``share``: that of toxic rows where the sample comes from; rows are weighted to match it.
    """
    sampled = float(toxic.mean()) if len(toxic) else 0.0
    model = Model(sampled if share is None else share)
    folds = sorted(set(fold.tolist()))
    if len(folds) < 2 or any(len(set(toxic[fold != f].tolist())) < 2 for f in folds):
        return model
    plain = [t.translate(LOWER_AZ) for t, y in zip(texts, toxic) if not y]
    base = _train([t[at:at + 256] for t in plain for at in range(0, len(t), 256)], BASE_BYTES, 16)

    def dictionaries(rows: np.ndarray) -> tuple[bytes, bytes]:
        bad, fine = ([texts[i] for i in np.flatnonzero(rows & (toxic == c))] for c in (True, False))
        own = _own(_telling(bad, fine)), _own(_telling(fine, bad))
        size = max(OWN_BYTES, *map(len, own))  # padded alike: the base is as far away in both
        return tuple(x.rjust(size) + base for x in own)

    full = np.array([bool(t.strip()) for t in texts])
    x, y = [], []
    for f in folds:
        rows = np.flatnonzero(full & (fold == f))
        if len(rows):
            x.append(Model(0.0, *dictionaries(fold != f)).features([texts[i] for i in rows]))
            y.append(toxic[rows].astype(np.float64))
    x, y = np.concatenate(x), np.concatenate(y)
    model.toxic, model.ordinary = dictionaries(np.ones(len(texts), bool))
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    each = np.where(y > 0, model.prior / sampled, (1 - model.prior) / (1 - sampled))
    w = np.zeros(a.shape[1])
    for _ in range(30):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        curve = (a * (each * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        w += np.linalg.solve(curve, a.T @ (each * (y - p)) - 0.1 * w)
    model.weights = w
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents of each class among the rows that ``learn`` allows."""
    marked = labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
    share = marked.agg(F.avg(F.col("__label").cast("double"))).first()[0]
    picked = [marked.filter(F.col("__label") == c).orderBy(F.xxhash64("__id"), "__id").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * sample rows of two numbers
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Of several texts of an id the one with the smallest hash.
    rows = docs.filter(F.length(t) <= SAMPLE_CHARS).join(chosen, docs[id_col] == chosen["__id"]).groupBy("__id", "__label").agg(
        F.min_by(t, F.xxhash64(t)).alias("t"))
    got = rows.select("__label", "t", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(FOLDS)).alias("fold")).orderBy("__id").collect()
    return fit([(r.t or "").encode() for r in got], np.array([r["__label"] for r in got], bool), np.array([r.fold for r in got], np.int64), share or 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(to_bytes(b.column(1))))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double")
