"""What the training-data operators share: table access, lineage cuts and vectorised text hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.sinks import shared_folder

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: White space as the word contracts define it: 0x20 and 0x09 to 0x0D.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a compressed table under the cluster's shared checkpoint folder and read it again.

    A lost executor then costs no more than the tasks at hand. The table is deleted when the session's JVM ends.
    """
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3, over an array of uint64."""
    h = h ^ (h >> _S)
    h = h * _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows (ASCII letters lower-cased), and the n + 1 word offsets of the rows.

    A word's hash is a polynomial in its bytes, taken from one running sum over the whole buffer.
    """
    n = len(data)
    word = ~_IS_SPACE[data]
    starts_here = word.copy()
    if n:
        starts_here[1:] &= ~word[:-1]
        at_row = offsets[:-1][offsets[:-1] < n]
        starts_here[at_row] = word[at_row]
    starts = np.flatnonzero(starts_here)
    ends_here = np.zeros(n + 1, dtype=bool)
    ends_here[1:] = word
    ends_here[:n] &= ~word | starts_here
    ends_here[0] = False
    ends = np.flatnonzero(ends_here)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * powers(_BASE, n), out=total[1:])
    inverse = powers(np.uint64(pow(int(_BASE), -1, 2**64)), n)
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def in_blocks(batches, most: int = 8_000_000, column: str = "text"):
    """Arrow batches cut into pieces of about `most` bytes of text, so that memory doesn't follow the batch size."""
    for batch in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        if not len(size):
            continue
        piece = np.cumsum(size.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(size)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def groups(batches, keys: list[str]):
    """Tables of the adjacent rows with equal keys, of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if last is not None and tuple(values[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(values[a])
    if held:
        yield pa.Table.from_batches(held)


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns, with these types: other columns, clashing names among them, stay out."""
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in named.items()))
