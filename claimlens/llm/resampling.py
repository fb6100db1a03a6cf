"""Quality selection by importance resampling.

Two generative models over hashed n-grams: words and word pairs of a text fall into
``BUCKETS`` counters, once for target text (documents labelled good) and once for
the raw collection. A document's log importance weight is the sum, over its n-grams,
of log p_target(bucket) - log p_raw(bucket). Adding Gumbel noise to the weights and
taking the k largest samples k documents without replacement in proportion to the
weights; k is the share ``rate`` of the rows.

Raw counts come from every document; target counts from at most ``TARGET`` labelled
documents (smallest hash of the id), which pass 1 recognises by a broadcast of their
ids. Pass 1 adds counters up in each task and sends one row a bucket; pass 2 scores
all texts with the 2 * BUCKETS * 8 bytes of weights. The k-th largest value is found
by counting: four rounds over 16 bits each of the values in steps of 2^-20.

The noise is a hash of (seed, id), so a retried task draws the same.

Defined results: null and empty texts have weight 0; a null id has the noise of an empty
one; repeated rows have equal noise; ties at the k-th value are selected together;
without target documents all weights are 0 and the noise alone decides; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import arrow_map, written
from claimlens.llm.tokens import mixed, text_slices, word_hashes, word_ids

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
TARGET = 8_000


def buckets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word and word pair, and its text."""
    ids, sizes, words = word_ids(texts)
    h = word_hashes(words)[ids] if len(ids) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    pair = owner[1:] == owner[:-1]
    grams = np.concatenate((mixed(h, h ^ np.uint64(1)), mixed(h[:-1], h[1:])[pair]))
    return (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate((owner, owner[1:][pair]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = np.array(batch.column(1).to_pylist(), bool)
        for first, texts in text_slices(batch, 0):
            bucket, owner = buckets_of(texts)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[first + owner]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame, good: Column, id_col: str = "doc_id", text_col: str = "text",
               sample: int = TARGET) -> np.ndarray:
    """log p_target - log p_raw of each bucket, with one added to every count."""
    ids = (
        labels.filter(good & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct()
        .orderBy(F.xxhash64("__id"), "__id").limit(sample)
    )
    marked = docs.join(F.broadcast(ids), docs[id_col] == ids["__id"], "left").select(
        F.col(text_col).alias("t"), F.col("__id").isNotNull().alias("good"))
    sums = arrow_map(marked, _count, "bucket int, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():  # one row a bucket
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def log_weights(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_grams, log_weight) of each row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, texts in text_slices(batch, 1):
                bucket, owner = buckets_of(texts)
                rows = slice(first, first + len(texts))
                many[rows] = np.bincount(owner, minlength=len(texts))
                total[rows] = np.bincount(owner, ratios[bucket], len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many), pa.array(total)], ["id", "n_grams", "log_weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")),
        run, f"id {kind}, n_grams long, log_weight double")


def gumbel(id_col: str, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the seed and the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column, by counting 16 bits at a time."""
    known, rest = 0, df.select((F.col(column).bitwiseXOR(F.lit(-(1 << 63)))).alias("v"))
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("v", shift).bitwiseAND(F.lit(0xFFFF))
        counts = sorted(((r["d"], r["n"]) for r in rest.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for d, n in counts:  # at most 65,536 rows
            if k <= n:
                break
            k -= n
        known = known << 16 | d
        rest = rest.filter(digit == d)
    return (known ^ (1 << 63)) - (1 << 64 if (known ^ (1 << 63)) >> 63 else 0)


def resample(docs: DataFrame, ratios: np.ndarray, rate: float, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_grams, log_weight, noisy, selected) of each row."""
    noisy = F.col("log_weight") + gumbel("id", seed)
    # The value in 2^-20 steps, so that it sorts as a long.
    rows = written(log_weights(docs, ratios, id_col, text_col).withColumn("noisy", noisy)
                   .withColumn("key", F.floor(F.col("noisy") * float(1 << 20)).cast("long")), "weights")
    k = int(rows.count() * rate)
    chosen = F.col("key") >= kth_largest(rows, "key", k) if k else F.lit(False)
    return rows.select(F.col("id").alias(id_col), "n_grams", "log_weight", "noisy", chosen.alias("selected"))
