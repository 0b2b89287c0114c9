"""Heavy keys, and the seed join under a fingerprint that a third of all files have."""

from __future__ import annotations

import random
from collections import Counter
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clones
from tessera.operators.hot_keys import Summary, heavy_keys, join_hot


def test_summary_bounds():
    rng = np.random.RandomState(1)
    values = np.concatenate((rng.zipf(1.3, 20_000) % 5000, np.full(4000, 77))).astype(np.int64)
    rng.shuffle(values)
    own, true = Summary(50), Counter(values.tolist())
    for part in np.array_split(values, 13):
        own.add(part)
    assert len(own.keys) <= 50
    for k, n in zip(own.keys.tolist(), own.counts.tolist(), strict=True):
        assert true[k] - len(values) / 51 <= n <= true[k]
    assert {k for k, n in true.items() if n > len(values) / 51} <= set(own.keys.tolist())


@pytest.mark.parametrize("least", [1, 40, 10**6])
def test_heavy_keys_are_exact(spark, least):
    rng = random.Random(4)
    keys = [7] * 300 + [9] * 40 + [rng.randrange(1000) for _ in range(500)] + [None] * 50
    rng.shuffle(keys)
    got = heavy_keys(spark.createDataFrame([(k,) for k in keys], "h long").repartition(6), "h", least, 8)
    assert {(r["key"], r["n"]) for r in got.collect()} == {(k, n) for k, n in Counter(keys).items() if k is not None and n >= least}


def test_join_is_the_plain_join(spark):
    rng = random.Random(6)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, None]), i) for i in range(200)], "k long, a int")
    right = spark.createDataFrame([(rng.choice([1, 2, 5, None]), i) for i in range(20)], "k long, b int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for least in (1, 30, 10**6):
        got = join_hot(left, right, "k", "a", least=least, piece=7)
        assert rows(got.select("k", "a", "b")) == rows(left.join(right, "k"))


def test_planted_fingerprint_is_spread(spark, monkeypatch):
    """A hash in a third of all files: no task joins more than 4 times what the median does, and pairs stay what they were."""
    rng = random.Random(2)
    rows = [(f"f{i}", 0, 99) for i in range(4000)] + [(f"f{i % 6000}", 1 + i // 6000, rng.randrange(2500)) for i in range(8000)]
    prints = spark.createDataFrame(rows, "path string, pos int, hash long")
    plain = prints.join(clones.cap_occurrences(prints).select("hash", F.col("path").alias("partner"), F.col("pos").alias("partner_pos")), "hash").where("path <> partner OR pos <> partner_pos")
    monkeypatch.setattr(clones, "HOT_ROWS", 500)
    monkeypatch.setattr(clones, "PIECE_ROWS", 100)
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        seeds = clones.seeds(prints)
        made = [r["n"] for r in seeds.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        before = [r["n"] for r in plain.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(made) == 16 and max(made) <= 4 * median(made)
        assert max(before) > 4 * median(before)
        assert seeds.count() == plain.count()
        assert seeds.exceptAll(plain.select(seeds.columns)).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
