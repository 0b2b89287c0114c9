"""Sharding along a Hilbert curve: several metadata dimensions are quantised, rows sorted by curve index, and runs cut."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import durable

SHARDS = 24
BITS = 5


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index of each row of ``points`` (rows x dimensions, each below 2**bits) along a Hilbert curve (Skilling's transform)."""
    x = np.array(points, np.int64, copy=True).T
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def order_key(df: DataFrame, name: str) -> Column:
    """A value that orders like the column, with null lowest: a long for numbers and times, text for the rest."""
    column, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        key = F.floor(column).cast("long")
    elif isinstance(kind, (T.TimestampType, T.DateType)):
        key = F.unix_micros(column.cast("timestamp"))
    else:
        return F.coalesce(F.concat(F.lit("+"), column.cast("string")), F.lit(""))
    return F.coalesce(key, F.lit(-(1 << 62)))


def text_bounds(df: DataFrame, key: str, bits: int) -> list[str]:
    """The different quantiles k / 2**bits of a text column without nulls, in order.

    Rows are counted by value first; values are then sorted in ranges, and a value's rank is its rank in its range plus
    the counts of the ranges before. So no task sees all values, and the driver gets 2**bits - 1 of them at most.
    """
    values = df.groupBy(F.col(key).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = durable(values.repartitionByRange(n, "v").withColumn("part", F.spark_partition_id()))
    counts = sorted((r["part"], r["k"]) for r in ranges.groupBy("part").agg(F.sum("k").alias("k")).collect())
    if not counts:
        return []
    total = sum(k for _, k in counts)
    ends = np.cumsum([k for _, k in counts]).tolist()
    first = df.sparkSession.createDataFrame([(p, e - k) for (p, k), e in zip(counts, ends, strict=True)], "part int, first long")
    rank = F.sum("k").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("first")
    ranked = ranges.join(F.broadcast(first), "part").withColumn("rank", rank)
    step = lambda x: f"(({x}) * {1 << bits}L) div {total}L"
    cut = ranked.where(f"least({step('rank')}, {(1 << bits) - 1}L) > {step('rank - k')}")
    return sorted(r["v"] for r in cut.select("v").collect())


def hilbert_order(df: DataFrame, dimensions: list[str], ties: list[str], bits: int = BITS) -> DataFrame:
    """df with hilbert, __part and __place: rows sorted by curve index and then by ``ties``, in ranges by ``__part``, ``__place`` counting from 0 in each.

    Each dimension is cut at its quantiles: approximate ones of numbers and times (an aggregate with partial results,
    2**bits - 1 numbers a dimension), exact ones of whole texts (text_bounds), so a value that a third of all rows share takes a cell of its own and the rest spread over the others.
    The range shuffle moves df's columns as they are: select narrow ones first. ``ties`` should tell rows apart, so that a hot cell
    spreads over several ranges. The result is kept durably, so that later passes see one and the same cut.
    """
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    keys = {d: f"__key_{i}" for i, d in enumerate(dimensions)}
    keyed = df.withColumns({k: order_key(df, d) for d, k in keys.items()})
    texts = {k for k in keys.values() if isinstance(keyed.schema[k].dataType, T.StringType)}
    numbers = [F.percentile_approx(k, cuts, 2000).alias(k) for k in keys.values() if k not in texts]
    row = keyed.agg(*numbers).first() if numbers else {}
    bounds = [text_bounds(keyed, k, bits) if k in texts else np.unique(np.asarray(row[k] or [], np.int64)) for k in keys.values()]

    @F.pandas_udf("long")
    def curve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            cells = [c.map(lambda x, b=b: bisect_right(b, x)).to_numpy(np.int64) if isinstance(b, list) else np.searchsorted(b, c.to_numpy(np.int64), "right") for b, c in zip(bounds, columns, strict=True)]
            yield pd.Series(hilbert_index(np.stack(cells, 1), bits))

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.withColumn("hilbert", curve(*keys.values())).drop(*keys.values())
    ordered = ordered.repartitionByRange(n, "hilbert", *ties).sortWithinPartitions("hilbert", *ties)
    at = F.monotonically_increasing_id()
    return durable(ordered.withColumns({"__part": F.shiftrightunsigned(at, 33), "__place": at.bitwiseAND((1 << 33) - 1)}))


def hilbert_shards(df: DataFrame, dimensions: list[str], ties: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """df with hilbert, shard and slot: the order of hilbert_order() cut into runs whose counts are at most one apart.

    A row's place in the whole order is its place in its range plus the counts of the ranges before, a list as long as
    the number of partitions; so no task sees all rows. An empty table gives an empty one; rows equal in the curve
    index and all ties stand in any order. df's columns of the three names are replaced, all others are kept.
    """
    ordered = hilbert_order(df, dimensions, ties, bits)
    counts = sorted((r["__part"], r["count"]) for r in ordered.groupBy("__part").count().collect())
    total = sum(c for _, c in counts)
    ends = np.cumsum([c for _, c in counts]).tolist()
    first = df.sparkSession.createDataFrame([(p, e - c) for (p, c), e in zip(counts, ends, strict=True)] or [(0, 0)], "__part long, __first long")
    at = F.col("__first") + F.col("__place")
    shard = F.expr(f"(__at * {shards}L) div {max(total, 1)}L")
    placed = ordered.join(F.broadcast(first), "__part").withColumn("__at", at).withColumn("shard", shard.cast("int"))
    slot = F.col("__at") - F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("slot", slot.cast("long")).drop("__part", "__place", "__first", "__at")


def op9_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    """documents over 24 shards along a Hilbert curve through source, language and size; law: rows. Equal texts of one source are neighbours.

    A null text has no bytes. doc_id may be null or repeated: each row has its own slot. Texts stay where they are;
    only sizes, checksums and keys are shuffled.
    """
    from tessera.llm.common import table

    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), "source", "lang")
    out = hilbert_shards(narrow, ["source", "lang", "size"], ["text_crc32", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
