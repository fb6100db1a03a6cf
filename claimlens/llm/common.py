"""Helpers the operators share: table access, shared folder, text buffers."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimlens.session import shared_dir

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))

#: Lower-cases A-Z and leaves every other byte.
LOWER_AZ = bytes.maketrans(_UPPER, _LOWER)

#: Lower-cases A-Z; every ASCII byte that is no letter or digit becomes a space.
#: ``bytes.split()`` of the result gives the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
ALNUM_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text has this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def written(df: DataFrame, what: str, small: bool = False) -> DataFrame:
    """``df`` written once to the cluster's shared folder and read back.

    ``small`` tables, of which many partitions would be nearly empty files, take no more
    files than the cluster has cores.

    Cuts the lineage: later stages and retries read the files. Local runs
    without ``spark.checkpoint.dir`` get a temporary folder.
    """
    spark = df.sparkSession
    local = spark.sparkContext.master.partition("[")[0] == "local"
    folder = spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark, create_local=local)
    path = os.path.join(folder, f"{what}-{uuid.uuid4().hex}")
    (df.coalesce(spark.sparkContext.defaultParallelism) if small else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a record batch that goes to Python; texts are long, and a worker holds a few copies.
BATCH_BYTES = 4 << 20


def arrow_map(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with bounded memory in the Python workers: the session's Arrow
    batches are kept to ``BATCH_BYTES`` (a longer row is a batch of its own), and a task
    hands freed memory back, as workers outlive their tasks."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return df.mapInArrow(tidy, schema)


def to_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null becomes empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def batches_of(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.Table]:
    """Gathers record batches until they hold about ``max_bytes``."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= max_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def gathered(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """``batches_of`` as record batches."""
    for table in batches_of(batches, max_bytes):
        yield from table.to_batches()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def code_points_before(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Code-point offsets of byte offsets in UTF-8 ``data``."""
    begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(begins)))[offsets]
