"""Trends: series of scores over time, kept short. Series are told apart by ``key`` columns; times are Unix milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import half_up

# What counts as one burst, when samples are rolled up, and how many are kept.
BURST_MS = 60_000
ROLL_UP_AFTER_DAYS = 60
MOST_SAMPLES = 200
DAY_MS = 86_400_000


def clean(samples: DataFrame) -> DataFrame:
    """Samples that have a time, a score and a debt."""
    return samples.where("t IS NOT NULL AND score IS NOT NULL AND debt_minutes IS NOT NULL")


def collapse_bursts(samples: DataFrame, key: str = "key", gap: int = BURST_MS) -> DataFrame:
    """The last sample of each burst: samples less than ``gap`` apart from the one before are one burst."""
    w = Window.partitionBy(key).orderBy("t")
    following = F.lead("t").over(w)
    return samples.withColumn("__next", following).where(F.col("__next").isNull() | (F.col("__next") - F.col("t") >= gap)).drop("__next")


def roll_up(samples: DataFrame, now: int | Column, key: str = "key") -> DataFrame:
    """Samples older than 60 days as one a month (UTC): means weighted by n, time and grade of the last, n summed; the rest as they are."""
    now = F.lit(now) if isinstance(now, int) else now
    cutoff = now - ROLL_UP_AFTER_DAYS * DAY_MS
    n = F.coalesce(F.col("n"), F.lit(1))
    fields = [key, "t", "grade", "score", "debt_minutes", "sloc", "files", "n"]
    mean = lambda c: half_up(F.sum(F.col(c) * n) / F.sum(n)).cast("long").alias(c)
    month = F.date_trunc("month", F.timestamp_millis("t"))
    old = samples.where(F.col("t") < cutoff).groupBy(key, month.alias("month")).agg(F.max("t").alias("t"), F.max_by("grade", "t").alias("grade"), *map(mean, ("score", "debt_minutes", "sloc", "files")), F.sum(n).cast("long").alias("n")).select(*fields)
    recent = samples.where(F.col("t") >= cutoff).select(key, "t", "grade", *(F.col(c).cast("long").alias(c) for c in ("score", "debt_minutes", "sloc", "files", "n")))
    return old.unionByName(recent)


def keep_newest(samples: DataFrame, key: str = "key", most: int = MOST_SAMPLES) -> DataFrame:
    """The newest samples of each series; the limit is taken in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("t")))
    return samples.withColumn("__n", rank).where(F.col("__n") <= most).drop("__n")


def compact(samples: DataFrame, now: int | Column, key: str = "key") -> DataFrame:
    return keep_newest(roll_up(samples, now, key), key)


def clear(samples: DataFrame, key_value, key: str = "key") -> DataFrame:
    """samples without one series."""
    return samples.where(~F.col(key).eqNullSafe(F.lit(key_value)))


def delta(samples: DataFrame, key: str = "key") -> DataFrame:
    """Of series with two samples and more: change of score since the first and since the one before, and the time between first and last."""
    two = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("t", "score")))), 1, 2)
    ends = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by("score", "t").alias("first"), F.min("t").alias("t0"), F.max("t").alias("t1"), two.alias("last"))
    latest = F.element_at("last", 1)["score"]
    return ends.where("n >= 2").select(key, (latest - F.col("first")).alias("since_start"), (latest - F.element_at("last", 2)["score"]).alias("since_last"), (F.col("t1") - F.col("t0")).alias("span"))


def sparkline(samples: DataFrame, width: float, height: float, key: str = "key") -> DataFrame:
    """key and points: "x,y x,y ..." to one decimal, empty for less than two samples."""
    one = lambda x: F.format_string("%.1f", x)
    lists = samples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", F.col("score").cast("double").alias("score")))).alias("s"))
    t0, span = F.element_at("s", 1)["t"], F.greatest(F.lit(1), F.element_at("s", -1)["t"] - F.element_at("s", 1)["t"])
    point = lambda x: F.concat(one((x["t"] - t0) / span * width), F.lit(","), one(F.lit(float(height)) - F.greatest(F.lit(0.0), F.least(F.lit(100.0), x["score"])) / 100 * height))
    return lists.select(key, F.when(F.size("s") < 2, "").otherwise(F.array_join(F.transform("s", point), " ")).alias("points"))


def trend_caption(change: Column, span: Column) -> Column:
    """Improved, dropped or held steady, and over how many days if at least two."""
    days = half_up(span / DAY_MS).cast("long")
    amount = F.abs(change).cast("string")
    points = F.when(F.abs(change) == 1, " point").otherwise(" points")
    said = F.when(change > 0, F.concat(F.lit("improved by "), amount, points)).when(change < 0, F.concat(F.lit("dropped by "), amount, points)).otherwise("held steady")
    return F.concat(said, F.when(days >= 2, F.concat(F.lit(" over "), days.cast("string"), F.lit(" days"))).otherwise(""))
