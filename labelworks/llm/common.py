"""Shared helpers of the llm operators: scratch tables, Arrow batches, word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path

#: Bytes of text that one vectorised step takes at once; a longer text is cut at a word's end and joined again.
STEP_BYTES = 1 << 20

# The multipliers and shifts of the public splitmix64 finalizer.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@contextmanager
def narrow_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """Arrow batches of at most so many bytes: a task holds some copies of one, in the JVM and in its Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, and a lost executor loses nothing."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    with narrow_batches(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_fold(column: str, modulus: int) -> Column:
    """crc32 of the column's text, modulo ``modulus``; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def held_out(column: str, modulus: int, kept_out: int) -> Column:
    """True for rows of the held-out fold; a null id is never held out and never learned from."""
    return F.coalesce(crc_fold(column, modulus) == kept_out, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """A worker goes on to other stages: it gives back the memory that it doesn't need."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def pieces(batch: pa.RecordBatch, column: str, most: int = 2 * STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text, or one row."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
    give_back()


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


_BASE = 0x9E3779B97F4A7C13
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64; one table for all hashers of a worker."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(max(n, STEP_BYTES + 64), b, np.uint64)
            a[0] = 1
            _powers.append(np.multiply.accumulate(a))
    return _powers[0][:n], _powers[1][:n]


class WordHasher:
    """Hashes all words of many byte strings at once.

    A word is a maximal run of bytes for which ``is_word`` holds. A word's hash is a polynomial of its bytes'
    random values, taken from prefix sums modulo 2**64, so it depends on the word alone.
    """

    def __init__(self, is_word: np.ndarray, lower: bool = True, seed: int = 7):
        self.is_word = is_word
        values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            values[65:91] = values[97:123]
        self.values = values

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, text numbers, starts and ends of all words, in order."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if self.is_word[10]:
            raise ValueError("a line end cannot be part of a word")
        sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        inside = self.is_word[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        starts, ends = edges[0::2], edges[1::2]
        hashes = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            till = max(at + 1, int(np.searchsorted(ends, starts[at] + STEP_BYTES, "right")))
            first, last = int(starts[at]), int(ends[till - 1])
            up, down = powers(last - first)
            sums = np.zeros(last - first + 1, np.uint64)
            terms = self.values[data[first:last]]
            terms *= up
            np.cumsum(terms, out=sums[1:])
            a, b = starts[at:till] - first, ends[at:till] - first
            hashes[at:till] = (sums[b] - sums[a]) * down[a]
            at = till
        owner = np.searchsorted(np.cumsum(sizes), starts, "right").astype(np.int64)
        return mix(hashes), owner, starts, ends


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; shorter by k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0xD1342543DE82EF95) + hashes[i : i + n]
    return mix(out)


def spark_sum_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Sum an array<double> column by position for each key, natively and combined on the map side."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "part")).groupBy(*keys, "pos").agg(F.sum("part").alias("total"))
