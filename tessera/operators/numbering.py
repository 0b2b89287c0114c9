"""Row numbers over whole tables without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import kept

#: Row numbers within a partition take so many bits of monotonically_increasing_id().
_BITS = 33


def numbered(df: DataFrame, *order, name: str = "number") -> DataFrame:
    """df with a number from 0 in the order of the columns ``order`` (which should tell all rows apart), as row_number() over everything would give it.

    Rows are dealt by ranges of the order and sorted where they are; a partition's numbers begin after the rows of those
    before, of which only the counts go to the driver.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # kept first: partitions are told by their numbers, which mustn't change between the two uses
    dealt = kept(df.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("__at", _BITS).cast("int")
    before, first = 0, []
    for row in dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        first.append((row["part"], before))
        before += row["n"]
    starts = F.broadcast(df.sparkSession.createDataFrame(first, "__part int, __first long"))  # a row for each partition
    placed = dealt.withColumn("__part", part).join(starts, "__part")
    return placed.withColumn(name, F.col("__first") + F.col("__at").bitwiseAND((1 << _BITS) - 1)).drop("__at", "__part", "__first")


def numbered_within(df: DataFrame, group: str, *order, name: str = "number", size: str = "group_size") -> DataFrame:
    """df with a number from 0 within each ``group``, and the group's size: numbers over everything less the group's first.

    A group of any size lies over as many partitions as its share asks for.
    """
    every = kept(numbered(df, group, *order, name="__number"))
    groups = every.groupBy(group).agg(F.min("__number").alias("__first"), F.count(F.lit(1)).alias(size)).withColumnRenamed(group, "__group")
    joined = every.join(groups, F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn(name, F.col("__number") - F.col("__first")).drop("__number", "__first", "__group")
