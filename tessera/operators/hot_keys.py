"""Keys that hold a large share of all rows: found by summaries of bounded size, and joined over many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import bounded_batches, kept

#: Counters of a task's summary: a key with more than one in so many of all rows is always found.
COUNTERS = 1024
#: Counters from which a summary is no smaller than the task's own counts, and keys that are looked up in every task.
MOST_COUNTERS, MOST_LIKELY = 1 << 14, 100_000
#: Rows under one key from which it is joined in pieces, and rows of a piece.
HOT_ROWS, PIECE_ROWS = 10_000, 5_000


class Summary:
    """Counts of the most frequent numbers of a sequence in ``size`` counters.

    When a batch brings more numbers than there are counters, the next smaller count is taken off all of them and those
    at zero go. So a count is too low by one in size + 1 of what was counted at most, and never too high.
    """

    def __init__(self, size: int = COUNTERS):
        self.size, self.keys, self.counts = size, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        fresh, n = np.unique(values, return_counts=True)
        keys, at = np.unique(np.concatenate((self.keys, fresh)), return_inverse=True)
        counts = np.bincount(at, np.concatenate((self.counts, n)), len(keys)).astype(np.int64)
        if len(keys) > self.size:
            counts -= np.partition(counts, len(counts) - self.size - 1)[len(counts) - self.size - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts


def heavy_keys(rows: DataFrame, key: str, least: int = HOT_ROWS, counters: int = COUNTERS) -> DataFrame:
    """The keys (64-bit numbers) of at least ``least`` rows, with their exact number n.

    Each task keeps a summary of bounded size, summaries are added up, and only the keys that these can't rule out are
    counted exactly; there are at most ``counters`` times as many of them as tasks. Where a summary's error, a row in
    ``counters``, is beyond ``least``, summaries get as many counters as it takes. Where these would be too many, or too many
    keys are left, all are counted. Rows are never shuffled, only each task's counts. Null keys are no keys.
    """
    rows = rows.select(F.col(key).alias("key")).where("key IS NOT NULL")
    total = rows.count()
    size = max(counters, 2 * -(-total // max(1, least)))
    counted = lambda some: some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    if size > MOST_COUNTERS:
        return counted(rows)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary(size)
        for batch in batches:
            own.add(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(own.keys), pa.array(own.counts)], names=["key", "n"])

    error = total // (size + 1)
    bounded_batches(rows.sparkSession)
    likely = kept(rows.mapInArrow(summarise, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") + error >= least).select("key"))
    return counted(rows if likely.count() > MOST_LIKELY else rows.join(F.broadcast(likely), "key", "left_semi"))


def join_hot(left: DataFrame, right: DataFrame, key: str, *spread: str, least: int = HOT_ROWS, piece: int = PIECE_ROWS) -> DataFrame:
    """left inner-joined with right on ``key``, a hot key of left's over several tasks.

    The rows of left under a key with at least ``least`` of them are dealt by the hash of the columns ``spread`` into pieces
    of about ``piece``, and right's rows of that key, of which there should be few, go to each of its pieces. Other keys are
    in one piece. The join is the same for all keys, so it is one shuffle of each side.
    """
    hot = kept(heavy_keys(left, key, least).select(F.col("key").alias("__key"), F.expr(f"cast((n + {piece - 1}) div {piece} as int)").alias("__pieces")))
    if hot.isEmpty():
        return left.join(right, key)
    pieces: Column = F.coalesce("__pieces", F.lit(1))
    told = lambda side: side.join(F.broadcast(hot) if few else hot, F.col(key) == F.col("__key"), "left").drop("__key")
    few = hot.count() <= 100_000
    dealt = told(left).withColumn("__piece", F.pmod(F.xxhash64(*spread), pieces).cast("int")).drop("__pieces")
    copied = told(right).withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("__pieces")
    return dealt.join(copied, [key, "__piece"]).drop("__piece")
