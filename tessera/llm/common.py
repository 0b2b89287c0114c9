"""Shared pieces: table reading, durable checkpoints, batch access and 64-bit hashing kernels.

The kernels work on whole Arrow batches: the UTF-8 bytes of many texts lie in one buffer, and a rolling polynomial
over Z/2^64 with random byte values gives the hash of any byte range from two prefix sums.
"""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one kernel call handles at once; it bounds the memory of a Python worker.
CHUNK_BYTES = 1 << 19
#: Rows and bytes of an Arrow batch; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

_RNG = np.random.RandomState(20240607)
#: A random 64-bit value for each byte.
BYTE_VALUE = (_RNG.randint(0, 1 << 32, 256, dtype=np.uint64) << np.uint64(32)) | _RNG.randint(0, 1 << 32, 256, dtype=np.uint64)
#: ASCII white space: 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z become a-z, other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at BATCH_ROWS rows or BATCH_BYTES bytes, where the session's limits are larger: JVM and Python worker hold a batch each."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(key, None)
        if have is None or not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(key, str(most))


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that all executors share; its lineage ends there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process a
    temporary one is made. A cluster must name a folder that all executors share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Let go of shuffle files and kept tables that nothing refers to any more; Spark removes their files when the driver's objects are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
        if n > 4 * CHUNK_BYTES:  # of one unusually long text: not worth keeping
            _powers.pop(base)
    return have[:n]


def range_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash() gets the hash of any range; values holds a number for each byte."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(BASE_INVERSE, len(sums))[start]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, data


def spread_texts(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts in a row with a blank after each, so that nothing runs from one into the next; and where each text, blank included, ends."""
    n = len(offsets) - 1
    body = data[offsets[0] : offsets[-1]]
    out = np.full(len(body) + n, 32, np.uint8)
    out[np.arange(len(body)) + np.repeat(np.arange(n), np.diff(offsets))] = body
    return out, offsets[1:] - offsets[0] + np.arange(1, n + 1)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many bytes together; a longer text is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words (runs of bytes that aren't ASCII white space; A-Z lower-cased)."""
    space = IS_SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    sums = range_sums(BYTE_VALUE[LOWER[data]])
    return starts, mix(range_hash(sums, starts, ends) + (ends - starts).astype(np.uint64))


_SHINGLE_MULTIPLIERS = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += words[k : k + n] * _SHINGLE_MULTIPLIERS[k % 5]
        h = mix(h)
    return h


def shingle_set(data: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles of one text; with fewer words than ``width`` the whole sequence is one; without words none."""
    _, words = word_hashes(data)
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < width:
        one = np.array([len(words)], np.uint64)
        for k in range(len(words)):
            one = mix(one * np.uint64(0x9FB21C651E98DF25) + words[k : k + 1])
        return one
    return np.unique(shingle_hashes(words, width))
