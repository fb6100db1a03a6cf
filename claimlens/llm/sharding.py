"""Sharding by extendible hashing, in DataFrame operations only.

A row's key is hashed to 60 bits. A shard is a bucket of rows that agree on
their first ``depth`` bits; the directory starts with one bucket of depth 0 and
splits only buckets over the byte limit, on one more bit, until each fits.

Only sums per hash prefix are needed to decide the splits, so the directory is
found from pre-aggregated cells: the first round sums bytes per 12-bit prefix
(partial aggregation: at most 4,096 rows leave each task), decides every depth
up to 12 from them, and only prefixes still over the limit go to a next round
with further bits. Directory and cells stay DataFrames; the driver sees two
numbers a round. Rows are hashed anew in each round; nothing as large as the input is
written or shuffled.

Defined results: a null key part or text counts as empty; an empty table gives
no rows; an empty text has 0 bytes. Rows whose key parts are all equal have the
same hash and can't be split: a bucket of one hash stays, ``oversized`` if it is
over the limit. Ties don't arise. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import written

HASH_BITS = 60
FIRST_BITS = 12


def key_hash(*parts: Column) -> Column:
    """First 60 bits of md5 over the parts joined by ':'; null counts as empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h: Column, bits: int | Column) -> Column:
    shift = F.lit(HASH_BITS) - bits if isinstance(bits, Column) else F.lit(HASH_BITS - bits)
    return F.call_function("shiftright", h, shift.cast("int"))


def directory_cells(slim: DataFrame, limit: int, first_bits: int = FIRST_BITS) -> list[tuple[int, DataFrame]]:
    """For each round its bits and a table (cell, depth, shard_bytes, oversized).

    ``cell`` is a prefix of that many bits whose bucket is settled in the round,
    ``depth`` the bucket's depth.
    """
    rounds, rows, low, high = [], slim, 0, first_bits
    while True:
        cells = written(
            rows.groupBy(prefix(F.col("h"), high).alias("cell"))
            .agg(F.sum("n_bytes").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi")),
            "cells", small=True,
        )
        # Each cell tells its sum to its bucket of every depth of this round; partial aggregation first.
        at = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
        bucket = F.call_function("shiftright", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int"))
        buckets = at.groupBy("depth", bucket.alias("bucket")).agg(
            F.sum("s").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = buckets.filter((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi")) | (F.col("depth") == HASH_BITS))
        settled = (
            at.select("cell", "depth", bucket.alias("bucket"))
            .join(fits.select("depth", "bucket", "shard_bytes"), ["depth", "bucket"])
            .groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes")).alias("leaf"))
            .select("cell", F.col("leaf.depth").alias("depth"), F.col("leaf.shard_bytes").alias("shard_bytes"),
                    (F.col("leaf.shard_bytes") > limit).alias("oversized"))
        )
        settled = written(settled, "directory", small=True)
        rounds.append((high, settled))
        open_cells = cells.join(settled, "cell", "left_anti")
        left, largest = open_cells.agg(F.count("*"), F.max("s")).first()
        if not left:
            return rounds
        low, high = high, min(HASH_BITS, high + min(FIRST_BITS, 2 + math.ceil(math.log2(max(2, largest / limit)))))
        rows = rows.withColumn("cell", prefix(F.col("h"), low)).join(open_cells.select("cell"), "cell", "left_semi").drop("cell")


def assign_shards(df: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """One row per input row: id, n_bytes, shard (its prefix bits as text), depth,
    shard_bytes, oversized.

    The key is the id and the text, so that repeated ids still split.
    """
    slim = df.select(
        F.col(id_col).alias("id"),
        key_hash(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("h"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
    )
    parts = [
        slim.withColumn("cell", prefix(F.col("h"), bits)).join(settled, "cell")
        for bits, settled in directory_cells(slim, limit)
    ]
    bits = F.lpad(F.bin(prefix(F.col("h"), F.col("depth"))), F.col("depth"), F.lit("0"))
    return reduce(DataFrame.unionByName, parts).select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(F.col("depth") == 0, F.lit("")).otherwise(bits).alias("shard"),
        F.col("depth").cast("int").alias("depth"), "shard_bytes", "oversized",
    )


def directory(assigned: DataFrame) -> DataFrame:
    """The shards of an assignment: (shard, depth, shard_bytes, oversized, n_rows)."""
    return assigned.groupBy("shard", "depth", "shard_bytes", "oversized").agg(F.count("*").alias("n_rows"))


def write_shards(df: DataFrame, assigned: DataFrame, id_col: str, path: str) -> None:
    """Writes the rows of ``df`` (ids unique) as one folder per shard.

    The folder is shard_bits=b<bits>; the letter keeps readers from taking the bits for a number.
    """
    shards = assigned.select(F.col(id_col).alias("__id"), F.concat(F.lit("b"), "shard").alias("shard_bits"))
    placed = df.join(shards, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    placed.repartition("shard_bits").write.partitionBy("shard_bits").parquet(path)
