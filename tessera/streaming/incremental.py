"""Incremental results: newest versions, upserts and removals, and a stream of document versions kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(versions: DataFrame, key: str = "path", generation: str = "generation") -> DataFrame:
    """The newest version of each key: one aggregate with partial results."""
    rest = [c for c in versions.columns if c != key]
    newest = F.max_by(F.struct(*rest), generation).alias("v")
    return versions.groupBy(key).agg(newest).select(key, "v.*")


def upsert(stored: DataFrame, changes: DataFrame, key: str = "path", generation: str = "generation") -> DataFrame:
    """stored with newer versions from changes; an older or equal generation changes nothing."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    rest = [c for c in stored.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(generation), -F.col("__new"))).alias("v")
    return both.groupBy(key).agg(newest).select(key, "v.*").select(*stored.columns)


def without_removed(stored: DataFrame, removed: DataFrame, key: str = "path") -> DataFrame:
    """stored without the removed paths and all below them: an anti-join of each path's own prefixes."""
    parts = F.split(key, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    gone = stored.select(key, F.explode(prefixes).alias("__p")).join(removed.select(F.col(key).alias("__p")), "__p", "left_semi").select(key).distinct()
    return stored.join(gone, key, "left_anti")


def vanished(known: DataFrame, listed: DataFrame, key: str = "path") -> DataFrame:
    """Known paths that a new listing lacks."""
    return known.join(listed.select(key), key, "left_anti")


def overlay(disk: DataFrame, live: DataFrame, key: str = "path") -> DataFrame:
    """Unsaved texts before those on disk; ``cacheable`` is false for them."""
    edited = live.select(key, F.col("text").alias("__live"))
    joined = disk.join(edited, key, "left")
    return joined.withColumns({"text": F.coalesce("__live", "text"), "cacheable": F.col("__live").isNull()}).drop("__live")


def watch(versions: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, delay_ms: int = 300, once: bool = False) -> StreamingQuery:
    """A stream of versions (path, generation, text, ...); each micro-batch hands apply() the newest of each path.

    The trigger's interval takes the place of a delay after each edit. apply() is given the batch's number, by which
    a batch that is repeated after a failure can be told: it should write by that number or by generation.
    """

    def step(batch: DataFrame, number: int) -> None:
        apply(latest(batch), number)

    writer = versions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{delay_ms} milliseconds")).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window, late ones up to ``late`` included; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def progress(query: StreamingQuery) -> dict[str, int | float | None]:
    """How far a stream is: its last batch, that batch's rows and seconds, and rows a second; None before the first."""
    last = query.lastProgress
    if last is None:
        return {"batch": None, "rows": None, "seconds": None, "rows_per_second": None}
    spent = last["durationMs"].get("triggerExecution", 0) / 1000
    return {"batch": last["batchId"], "rows": last["numInputRows"], "seconds": spent, "rows_per_second": last["numInputRows"] / spent if spent else 0.0}
