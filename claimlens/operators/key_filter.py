"""Stored Bloom filters over the keys of a table, one per key-hash bucket.

An arriving batch is checked against history without moving history: the batch's keys meet the
filter of their bucket, and only keys that the filter can't rule out (real clashes and about one in
a hundred others) are looked up exactly. A filter is an array of 64-bit words. A key sets its bits in
one word, so a filter is built from one row a key, by ``bit_or``, and read at one place.

A large filter is stored in slices of ``SLICE_WORDS`` words, rows (bucket, slice, slices, words): the
more keys, the more slices, so that no task holds more than a few of them whatever the buckets, and
keys meet their slice in a join on (bucket, slice).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.session import stored

#: With five bits set a key, about one key in a hundred is suspected wrongly.
BITS_PER_KEY = 10
_BITS_SET = 5

#: Words of a slice (32 KB, some 20,000 keys).
SLICE_WORDS = 4096
_WORD_BITS = SLICE_WORDS.bit_length() - 1

#: Slices that a task makes at most, about (some 650,000 keys): few enough for their words to be listed by hash.
SLICES_PER_TASK = 32

#: Keys that travel to every task at most (some 24 bytes each); more meet history in a shuffled join.
BROADCAST_KEYS = 1_000_000


def key_bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _hashes(keys: Sequence[str]) -> tuple[Column, Column]:
    """Where a key's word is (from the low bits the word, from the high ones the slice), and what its bits are made of."""
    return F.xxhash64(F.lit(1), *keys), F.xxhash64(F.lit(2), *keys).bitwiseAND(F.lit((1 << 6 * _BITS_SET) - 1))


def _bits(h: Column) -> Column:
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(_BITS_SET)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _slice_of(at: Column, slices: Column) -> Column:
    return F.shiftrightunsigned(at, 32).bitwiseAND(slices.cast("long") - 1)


def filter_words(most: int) -> int:
    """Words of a filter for ``most`` keys: a power of two."""
    return 1 << max(0, -(-most * BITS_PER_KEY // 64) - 1).bit_length()


def build_filters(rows: DataFrame, keys: Sequence[str], bucket: str, buckets: int, words: int) -> DataFrame:
    """(bucket, slice, slices, words): the filter of every bucket, with ``words`` 64-bit words in all its slices.
    ``rows`` has no NULL keys."""
    slices = max(1, words // SLICE_WORDS)
    each = words // slices
    at, h = _hashes(keys)
    # A key travels as its filter and one number: what its bits are made of, and its word. They are made where it arrives.
    marks = rows.select(
        (F.col(bucket).cast("long") * slices + _slice_of(at, F.lit(slices))).alias("filter"),
        F.shiftleft(h, _WORD_BITS).bitwiseOR(at.bitwiseAND(F.lit(each - 1))).alias("mark"))
    # A row of every filter, so that none is missing.
    marks = marks.unionByName(rows.sparkSession.range(buckets * slices).select(F.col("id").alias("filter"), F.lit(None).cast("long").alias("mark")))
    # Dealt by filter once, by the number of filters: its words are made and listed where they lie.
    dealt = marks.repartition(-(-buckets * slices // SLICES_PER_TASK), "filter")
    set_bits = dealt.select(
        "filter", F.coalesce(F.col("mark").bitwiseAND(F.lit(SLICE_WORDS - 1)), F.lit(0)).cast("int").alias("word"),
        F.coalesce(_bits(F.shiftrightunsigned("mark", _WORD_BITS)), F.lit(0)).alias("bits"))
    whole = set_bits.groupBy("filter", "word").agg(F.bit_or("bits").alias("bits"))
    listed = whole.groupBy("filter").agg(F.collect_list(F.struct("word", "bits")).alias("some"))
    # Words without a key are put in between.
    blank = F.array_except(F.sequence(F.lit(0), F.lit(each - 1)), F.col("some.word"))
    blank = F.arrays_zip(blank, F.array_repeat(F.lit(0).cast("long"), F.size(blank))).cast("array<struct<word:int,bits:bigint>>")
    listed = listed.select("filter", F.sort_array(F.concat(F.col("some").cast("array<struct<word:int,bits:bigint>>"), blank)).alias("all"))
    return listed.select(
        F.floor(F.col("filter") / slices).cast("int").alias("bucket"), (F.col("filter") % slices).cast("int").alias("slice"),
        F.lit(slices).alias("slices"), F.col("all.bits").alias("words"))


def suspected(rows: DataFrame, keys: Sequence[str], bucket: str, filters: DataFrame) -> DataFrame:
    """The distinct rows whose key some filter of their bucket can't rule out. ``filters`` may hold several
    of a bucket, of different sizes."""
    at, h = _hashes(keys)
    sizes = filters.select(F.col("slices").alias("__slices")).distinct()  # powers of two, so a few at most
    placed = rows.withColumns({"__at": at, "__bits": _bits(h)}).crossJoin(F.broadcast(sizes)).withColumn(
        "__slice", _slice_of(F.col("__at"), F.col("__slices")))
    held = filters.select(F.col("bucket").alias("__of"), F.col("slices").alias("__in"), F.col("slice").cast("long").alias("__part"), "words")
    # The bits are tried in the join, so no row carries a filter with it.
    word = F.element_at("words", (F.col("__at").bitwiseAND(F.size("words").cast("long") - 1) + 1).cast("int"))
    met = placed.join(
        held, (F.col(bucket) == F.col("__of")) & (F.col("__slices") == F.col("__in")) & (F.col("__slice") == F.col("__part"))
        & (word.bitwiseAND(F.col("__bits")) == F.col("__bits")), "left_semi")
    return met.select(*rows.columns).distinct()


def known_keys(suspects: DataFrame, keys: Sequence[str], history: DataFrame) -> DataFrame:
    """The rows of ``history`` that have one of the suspected keys.

    The suspects are written and counted; up to ``BROADCAST_KEYS`` of them travel to the tasks that
    scan history, so history isn't shuffled. More than that meet it in a shuffled join.
    """
    few = stored(suspects.select(*keys).distinct(), "suspects")
    return history.join(F.broadcast(few) if few.count() <= BROADCAST_KEYS else few, list(keys), "left_semi")


def arriving_clashes(batch: DataFrame, history: DataFrame, keys: Sequence[str], filters: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(key, copies) of keys that occur more than once in the batch, and (key) of the batch's keys that
    history has; rows with a NULL key never clash."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counted = batch.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    doubtful = suspected(counted.withColumn("__b", key_bucket(keys, buckets)), keys, "__b", filters)
    return counted.filter("copies > 1"), known_keys(doubtful, keys, history.select(*keys)).distinct()
