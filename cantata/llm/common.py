"""Helpers that the training-data operators share: checked broadcasts, and byte-level views of Arrow text."""

from __future__ import annotations

import ctypes
import gc
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantata.storage import Scratch, input_bytes, shared_dir  # noqa: F401

#: Text bytes that an Arrow function handles at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20

#: Bytes of an Arrow batch, where the session hasn't its own setting. The default counts rows, and texts may have any length.
ARROW_BATCH_BYTES = 2 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def release() -> None:
    """Gives memory that has been freed back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def gathered(df: DataFrame, column: str) -> np.ndarray:
    """A column of numbers on the driver, without more than one copy of it. Its size has been checked before."""
    chunks_ = df.select(column).toArrow().column(0).chunks
    out = np.empty(sum(len(x) for x in chunks_), np.int64)
    at = 0
    while chunks_:
        x = chunks_.pop(0)
        out[at : at + len(x)] = np.asarray(x)
        at += len(x)
        del x
    release()
    return out


def frugal(run):
    """Wraps a function on batches, to bound memory: batches are limited in bytes, and when a task is done its worker gives the memory that
    it has freed back to the system, so that workers that wait for the next task don't hold what the last one needed."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH_SETTING, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, ARROW_BATCH_BYTES)

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if its counted rows stay under the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


#: Parts that the rows of a frequent key are dealt to.
SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """A join on a key that a good part of left's rows may share: these go to SALTS tasks by a hash of the column `spread`, to each of which right's rows go."""
    left = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def measured_side(df: DataFrame, size, limit: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if its rows, each of `size` (a column) and 100 bytes, stay under the limit; else as it is."""
    total = df.agg(F.sum(F.coalesce(size, F.lit(0)) + 100)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and its n + 1 offsets; a null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def strings(column) -> list[str]:
    """Texts of an Arrow string array; a null counts as empty, and bytes that aren't UTF-8 become U+FFFD."""
    import pyarrow as pa

    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among the values."""
    if not len(sorted_values) or not len(x):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges (i, j) whose texts have at most so many bytes together, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_HASH_STEP = np.uint64(0x9E6C63D0876A9A47)
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Words longer than this are hashed one by one.
_LONG_WORD = 64


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, the first byte lowest; zeros stand beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes. Every eight bytes go through the finalizer, so, unlike sums of powers, it has no families of texts
    with equal values."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * _HASH_STEP + np.uint64(0x2545F4914F6CDD1D))
    if not len(size):
        return out
    wide = eights(data)
    some, at = np.arange(len(size)), starts
    for k in range(0, _LONG_WORD, 8):
        left = np.minimum(size[some] - k, 8)
        out[some] = mix(out[some] * _HASH_STEP + (wide[at] & _LOW_BYTES[left]))
        some = some[size[some] > k + 8]
        if not len(some):
            break
        at = starts[some] + k + 8
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def byte_class(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], bool)


#: `[^\x20\x09-\x0D]` by bytes: in UTF-8 each byte of a longer character is 0x80 or more.
NOT_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` by bytes.
ALNUM_OR_WIDE = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def words(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes, none across documents; first word of each document (n + 1)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    m = members[data]
    start = m.copy()
    start[1:] &= ~m[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    start[first] = m[first]
    end = m.copy()
    end[:-1] &= ~m[1:] | start[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)
