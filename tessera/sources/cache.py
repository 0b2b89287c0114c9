"""Measurements kept by content: what has been measured once is not measured again.

The cache is a table in hash buckets of the content's key. Writing a content again adds nothing, a failed write leaves
the cache as it was, and a run reads the buckets that its own contents fall into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.buckets import BucketStore

# Fixed value: part of every key, so that a change of the measurements empties the cache.
ENGINE_VERSION = "1.0.0"
TABLE = "measurements"


def with_key(files: DataFrame, version: str = ENGINE_VERSION) -> DataFrame:
    key = F.sha2(F.concat(F.lit(version + "\0"), "language_key", F.lit("\0"), F.coalesce("text", F.lit(""))), 256)
    return files.withColumn("content_key", key)


def misses(files: DataFrame, kept: DataFrame) -> DataFrame:
    return files.join(kept.select("content_key"), "content_key", "left_anti")


def hits(files: DataFrame, kept: DataFrame) -> DataFrame:
    return files.select("path", "content_key").join(kept.dropDuplicates(["content_key"]), "content_key")


def store(spark: SparkSession, folder: str) -> BucketStore:
    return BucketStore(spark, folder, {TABLE: "content_key"})


def append(measured: DataFrame, folder: str) -> int:
    """Adds measurements with a content_key that the cache lacks; the cache's version afterwards."""
    return store(measured.sparkSession, folder).add(TABLE, measured)


def read(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame | None:
    """The cache, one row for each content, or None where there is none yet; of ``wanted`` contents only the buckets that they are in."""
    cache = store(spark, folder)
    if not cache.version():
        return None
    return cache.read(TABLE, None if wanted is None else cache.touched(TABLE, wanted))


def clear(spark: SparkSession, folder: str) -> None:
    store(spark, folder).clear()
