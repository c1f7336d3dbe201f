"""Shared helpers: Arrow text buffers, words, window hashes and Spark plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidal.session import ship_package

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one vectorised step handles; temporaries are a small multiple of it.
STEP_BYTES = 1 << 20

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

# Workers live for many tasks: freed batches go back to the system.
pa.set_memory_pool(pa.system_memory_pool())

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_ODD = 0x9E3779B97F4A7C15


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str, buckets: int, rest: int) -> Column:
    """Whether crc32 of the id's text leaves ``rest``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % buckets == rest, F.lit(False))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package at hand on the workers and batches of a few megabytes."""
    small_batches(df.sparkSession)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give the memory that a task has freed back to the system; its worker lives on."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Texts differ much in length: batches go by bytes, where the session does not say otherwise."""
    ship_package(spark)
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")


def steps(batches: Iterator[pa.RecordBatch], text: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column ``text`` holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = _offsets(batch.column(text))
        at = 0
        while at < n:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)


def filled(column: pa.Array) -> pa.Array:
    """Null texts become empty ones."""
    return pc.fill_null(column, "") if column.null_count else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and where each text starts (one more entry for the end)."""
    column = filled(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off, data = _offsets(column), column.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and the row of each."""
    parts = pc.ascii_split_whitespace(filled(column))
    flat = parts.flatten()
    row = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    keep = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(keep), row[keep.to_numpy(zero_copy_only=False)]


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by ``row``, zero for rows without any."""
    return np.bincount(row, weights=values, minlength=n)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> _S33)
    h *= _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    k, p = 1, base
    while k < n:
        m = min(k, n - k)
        out[k:k + m] = out[:m] * np.uint64(p)
        p = p * p % (1 << 64)
        k += m
    return out


class WindowHash:
    """Hashes of any substring of a byte buffer from prefix sums (a polynomial modulo 2^64)."""

    _pow = _powers(1, _ODD)
    _inv = _powers(1, pow(_ODD, -1, 1 << 64))
    _table = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, buf: np.ndarray):
        n, cls = len(buf), type(self)
        if n + 1 > len(cls._pow):
            cls._pow = _powers(n + 1, _ODD)
            cls._inv = _powers(n + 1, pow(_ODD, -1, 1 << 64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(cls._table[buf] * cls._pow[:n], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal substrings [start, end) of equal length, wherever they stand."""
        return (self.sums[end] - self.sums[start]) * type(self)._inv[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scrambled hash of [start, end), the length included."""
        return mixed(self.raw(start, end) + (end - start).astype(np.uint64) * _M2)

    def each(self, width: int) -> np.ndarray:
        """Scrambled hash of every window of ``width`` bytes."""
        n = len(self.sums) - 1
        if n < width:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[width:] - self.sums[:n - width + 1]) * type(self)._inv[:n - width + 1])


def word_keys(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash (XXH3) of each string."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False) for c, f in zip(columns, schema)],
        schema=schema)
