"""Sums of files, folders and the corpus that are kept up to date: a change takes the old row out of every sum above it and puts the new one in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scoring import score_columns
from tessera.operators.routing import counts_toward_score
from tessera.session import kept
from tessera.sources.buckets import BUCKETS, BucketStore
from tessera.streaming.incremental import without_removed

FILES, FOLDERS = "files", "folders"
#: The folder that stands for the whole corpus.
CORPUS = ""
_FILE = "path string, generation long, tier int, debt_minutes long, sloc long"


def contributions(files: DataFrame, sign: int = 1) -> DataFrame:
    """What files(path, tier, debt_minutes, sloc) that count add to (or with -1 take from) their folders and the corpus: summed by folder."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = files.where(counts_toward_score(F.col("tier"))).select(F.explode(F.concat(F.array(F.lit(CORPUS)), above)).alias("folder"), "debt_minutes", "sloc")
    return rows.groupBy("folder").agg((F.sum("debt_minutes") * sign).alias("debt_minutes"), (F.sum("sloc") * sign).alias("sloc"), (F.count(F.lit(1)) * sign).alias("files"))


def merged(*sums: DataFrame) -> DataFrame:
    """Sums of sums by folder; folders without a file go."""
    every = reduce(DataFrame.unionByName, sums)
    return every.groupBy("folder").agg(*(F.sum(c).cast("long").alias(c) for c in ("debt_minutes", "sloc", "files"))).where("files > 0")


class KeptRollups:
    """Files in buckets of their path and folders in buckets of their name, changed in one step.

    A change reads the buckets of its files and those of the folders above them. A version that isn't newer than the
    stored one changes nothing, so a batch that comes twice counts once.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark = spark
        self.store = BucketStore(spark, folder, {FILES: "path", FOLDERS: "folder"}, buckets)

    def apply(self, changed: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """changed(path, generation, tier, debt_minutes, sloc); removed(path): files, and folders with all below them, taken out before the changes."""
        none = self.spark.createDataFrame([], _FILE)
        if removed is not None:
            stored = self.store.read(FILES)
            if stored is not None:
                gone = kept(stored.join(without_removed(stored, removed), "path", "left_anti").select(none.columns))
                self._exchange(gone, none)
        if changed is None:
            return
        rest = [c for c in none.columns if c != "path"]
        newest = changed.where("path IS NOT NULL").groupBy("path").agg(F.max_by(F.struct(*rest), "generation").alias("v")).select("path", "v.*")
        newest = kept(newest.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in none.schema)))
        stored = self.store.read(FILES, self.store.touched(FILES, newest))
        if stored is not None:
            seen = stored.select("path", F.col("generation").alias("seen"))
            newest = kept(newest.join(seen, "path", "left").where("seen IS NULL OR generation > seen").drop("seen"))
            old = kept(stored.join(newest.select("path"), "path", "left_semi").select(none.columns))
        else:
            old = none
        self._exchange(old, newest)

    def _exchange(self, old: DataFrame, new: DataFrame) -> None:
        """Old rows out, new rows in, in files and in all folders above them."""
        paths = kept(old.select("path").union(new.select("path")).distinct())
        touched = self.store.touched(FILES, paths)
        if not touched:
            return
        files = self.store.read(FILES, touched)
        files = new if files is None else files.join(paths, "path", "left_anti").select(new.columns).unionByName(new)
        change = kept(merged_delta(contributions(old, -1), contributions(new)))
        above = self.store.touched(FOLDERS, change)
        folders = self.store.read(FOLDERS, above)
        self.store.replace({FILES: (touched, files), FOLDERS: (above, merged(change) if folders is None else merged(folders, change))})

    def files(self) -> DataFrame:
        return self.store.read(FILES)

    def folders(self) -> DataFrame:
        """folder, debt_minutes, sloc, files and scores; the corpus isn't among them."""
        return self._scored(self.store.read(FOLDERS).where(F.col("folder") != CORPUS))

    def corpus(self) -> DataFrame:
        """The same for the whole corpus: one bucket is read."""
        one = self.spark.createDataFrame([(CORPUS,)], "folder string")
        return self._scored(self.store.read(FOLDERS, self.store.touched(FOLDERS, one)).where(F.col("folder") == CORPUS)).drop("folder")

    @staticmethod
    def _scored(sums: DataFrame) -> DataFrame:
        return sums.withColumns(score_columns(F.col("debt_minutes"), F.col("sloc")))


def merged_delta(*sums: DataFrame) -> DataFrame:
    """Sums of changes by folder; such as change nothing stay, as a folder may have lost one file and won another."""
    every = reduce(DataFrame.unionByName, sums)
    return every.groupBy("folder").agg(*(F.sum(c).cast("long").alias(c) for c in ("debt_minutes", "sloc", "files")))
