"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_stored, importable, stored  # noqa: F401  (re-exported)

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = 512) -> None:
    """Let Python workers import this package from where the driver has it (on a
    cluster it is installed or sent with --py-files), and cap the rows of an Arrow
    batch, so that a worker holds few long texts at once."""
    importable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


LONG_WORD = 48  # characters; what a worker works out for a longer word is used and forgotten
_kept: list = []


def per_worker(owner: str, key, make):
    """``make()``, once for each worker, owner and key, for models and caches that tasks share.

    A worker serves many operators one after another: what another owner or key left is
    dropped first and its memory given back, so a worker holds one cache at a time."""
    if not _kept or _kept[0] != (owner, key):
        _kept.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps the pages
            ctypes.CDLL(None).malloc_trim(0)
        _kept.extend([(owner, key), make()])
    return _kept[1]


class Budget:
    """Bytes that a cache of words may take; about 200 for each entry besides its text."""

    def __init__(self, most: int):
        self.most, self.used = most, 0

    def spent(self, words) -> bool:
        """Counts ``words`` in; True if the cache is to be emptied (which starts a new count)."""
        self.used += sum(len(w) for w in words) + 200 * len(words)
        if self.used <= self.most:
            return False
        self.used = 0
        return True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain): spreads all 64 bits."""
    h = (h ^ (h >> U64(30))) * _MIX1
    h = (h ^ (h >> U64(27))) * _MIX2
    return h ^ (h >> U64(31))


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the ``n``-word windows of an array of word hashes."""
    if len(words) < n:
        return np.empty(0, U64)
    m = len(words) - n + 1
    h = np.zeros(m, U64)
    for i in range(n):
        h = h * U64(0x9E3779B97F4A7C15) + words[i:i + m]
    return mix(h)


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (the folds of the contracts)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sample_by_hash(df: DataFrame, key, n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key``: a bounded sample that
    depends on the rows alone (ties are broken by the key)."""
    k = F.col(key) if isinstance(key, str) else key
    return df.orderBy(F.xxhash64(k, F.lit(seed)), k).limit(n)


def pin(df: DataFrame, **columns) -> DataFrame:
    """Add columns that are computed once per row: neither a filter, a projection nor
    a lambda that refers to them evaluates their expressions again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
