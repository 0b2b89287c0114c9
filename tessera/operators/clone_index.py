"""The index of fingerprints, kept over edits: what a change touches is read and written anew, the rest stays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import clones
from tessera.session import kept
from tessera.sources.buckets import BUCKETS, BucketStore

BY_HASH, BY_PATH = "by_hash", "by_path"
_ROWS = ["path", "pos", "hash"]


class CloneIndex:
    """Fingerprints (path, pos, hash) twice: in buckets of the hash, where seeds meet, and in buckets of the path, which tell what a file had.

    Both tables change in one step. A change reads the path buckets of its files and the hash buckets of their old and new
    fingerprints. Applying a change again gives the same index.
    """

    def __init__(self, spark: SparkSession, folder: str, threshold: int = 100, buckets: int = BUCKETS):
        self.spark, self.threshold = spark, threshold
        self.store = BucketStore(spark, folder, {BY_HASH: "hash", BY_PATH: "path"}, buckets)

    def apply(self, tokens: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
        """Take in changed files, tokens(path, ids), and drop removed(path); the paths whose blocks may have changed.

        These are the files of the change themselves and all that share, or shared before, a fingerprint with one of them. Null
        paths are ignored; a path that is both changed and removed is changed.
        """
        none = self.spark.createDataFrame([], "path string, pos int, hash long")
        parts = [d.select("path") for d in (tokens, removed) if d is not None]
        if not parts:
            return none.select("path")
        paths = kept(reduce(DataFrame.union, parts).where("path IS NOT NULL").distinct())
        new = none if tokens is None else kept(clones.fingerprints(tokens.where("path IS NOT NULL"), self.threshold))
        path_buckets = self.store.touched(BY_PATH, paths)
        stored = self.store.read(BY_PATH, path_buckets)
        stored = none if stored is None else stored
        old = kept(stored.join(paths, "path", "left_semi").select(_ROWS))
        hashes = kept(old.select("hash").union(new.select("hash")).distinct())
        hash_buckets = self.store.touched(BY_HASH, hashes)
        shelf = self.store.read(BY_HASH, hash_buckets)
        shelf = none if shelf is None else shelf
        affected = kept(shelf.join(hashes, "hash", "left_semi").select("path").union(paths).distinct())
        rest = [t.join(paths, "path", "left_anti").select(_ROWS).unionByName(new.select(_ROWS)) for t in (shelf, stored)]
        self.store.replace({BY_HASH: (hash_buckets, rest[0]), BY_PATH: (path_buckets, rest[1])})
        return affected

    def fingerprints(self) -> DataFrame:
        """All of the index."""
        return self.store.read(BY_HASH)

    def seeds_of(self, paths: DataFrame) -> DataFrame:
        """path, pos, partner, partner_pos for some files only; the buckets of other files' fingerprints aren't read."""
        own = self.store.read(BY_PATH, self.store.touched(BY_PATH, paths)).join(paths, "path", "left_semi")
        near = self.store.read(BY_HASH, self.store.touched(BY_HASH, own))
        kept_places = clones.cap_occurrences(near).select("hash", F.col("path").alias("partner"), F.col("pos").alias("partner_pos"))
        return own.join(kept_places, "hash").where("path <> partner OR pos <> partner_pos").select("path", "pos", "partner", "partner_pos")
