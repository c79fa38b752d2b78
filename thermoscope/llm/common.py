"""Shared pieces of the text operators: intermediate tables, ragged arrays, byte hashing.

Intermediate results that feed several jobs are written as Parquet below the
shared checkpoint folder, so a lost executor only repeats its own tasks.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

U64 = np.uint64


class Scratch:
    """Named Parquet tables of one job under the shared checkpoint folder.

    ``drop`` frees a table that no later step reads; what is left goes when the
    application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.base)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may already be closed
            pass

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write and read back; the shuffle files of the write go when it ends, not when garbage is collected."""
        with shuffles_freed(self.spark):
            df.write.options(**options).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._remove(self.path(name))


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Statements that run inside free their shuffle files at their end."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def short_batches(spark: SparkSession, rows: int):
    """Statements that run inside hand Python at most ``rows`` rows at a time: a batch is held by Spark and by the worker."""
    before, now = spark.conf.get(ARROW_ROWS, None), int(spark.conf.get(ARROW_ROWS))
    spark.conf.set(ARROW_ROWS, str(min(now, rows) if now > 0 else rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ARROW_ROWS)
        else:
            spark.conf.set(ARROW_ROWS, before)


def settle(spark: SparkSession) -> None:
    """Let Spark's cleaner free the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return freed memory to the system: a worker stays alive between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # of the GNU C library
    if trim:
        trim(0)


def take_ragged(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenate ``values[s:s+n]`` for every (s, n) without a Python loop."""
    total = int(lens.sum())
    if total == 0:
        return values[:0]
    ends = np.cumsum(lens)
    shift = np.repeat(starts - (ends - lens), lens)
    return values[shift + np.arange(total, dtype=np.int64)]


def slices_by_bytes(offsets: np.ndarray, limit: int):
    """Row ranges of an Arrow string column whose bytes stay near ``limit`` each."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


# --- rolling byte hashes (arithmetic modulo 2**64) -------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class RollingHash:
    """Hashes of byte substrings from prefix sums of powers of an odd base.

    ``seed`` picks the base and the 256 random byte codes; two seeds give two
    independent 64-bit hashes.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.base = int(rng.integers(2**40, 2**60)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self._pow = self._inv = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._pow) < n:
            n = max(n, 2 * len(self._pow))
            for name, b in (("_pow", self.base), ("_inv", self.inverse)):
                full = np.full(n, U64(b), np.uint64)
                full[0] = 1
                setattr(self, name, np.cumprod(full, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums over ``data`` (uint8); one longer than the data."""
        self._powers(len(data) + 1)
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum(self.codes[data] * self._pow[:len(data)], dtype=np.uint64, out=out[1:])
        return out

    def span(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of every ``data[s:e]``; equal bytes give equal values."""
        return mix64((prefix[ends] - prefix[starts]) * self._inv[starts] + (ends - starts).astype(np.uint64))

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hash of every window of ``width`` bytes, in order."""
        n = len(prefix) - 1 - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix64((prefix[width:] - prefix[:n]) * self._inv[:n] + U64(width))
