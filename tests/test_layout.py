"""Tiers and places of a layout against a plain version, and numbers over partitions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.numbering import numbered, numbered_within
from tessera.operators.ranking import place_blocks, tiers


def plain_tiers(files: list[tuple[str, int, int]]) -> list[list[tuple]]:
    """Lists of files, from the bottom up."""
    folder = lambda f: f[0].rpartition("/")[0]
    found: list[list[tuple]] = []
    for depth in sorted({f[0].count("/") for f in files}):
        own = [f for f in files if f[0].count("/") == depth]
        if len(found) < 6:
            found.append(own)
        else:
            found[-1] = found[-1] + own
    while 0 < len(found) < 3:
        several = [t for t in found if len({folder(f) for f in t}) > 1]
        if several:
            largest = max(several, key=len)
            by = {d: [f for f in largest if folder(f) == d] for d in {folder(f) for f in largest}}
            parts = [by[d] for d in sorted(by, key=lambda d: (-len(by[d]), d))]
        else:
            largest = max(found, key=len)
            if len(largest) < 3:
                break
            ordered, want = sorted(largest, key=lambda f: (-f[1], f[0])), 3 - len(found) + 1
            parts = []
            for i in range(want):
                n = len(largest) // want + (i < len(largest) % want)
                parts.append(ordered[:n])
                ordered = ordered[n:]
        at = next(i for i, t in enumerate(found) if t is largest)
        found[at : at + 1] = parts
    return sorted(found, key=len, reverse=True)


def shapes() -> dict[str, list[str]]:
    rng = random.Random(3)
    tree = [f"{rng.choice('abc')}/{'d/' * rng.randrange(3)}{i}" for i in range(58)]
    return {
        "flat": [f"{i}" for i in range(7)], "one folder": [f"src/{i}" for i in range(11)], "two folders": [f"{'ab'[i > 4]}/{i}" for i in range(10)], "two files": ["a/x", "a/y"], "one": ["x"],
        "two depths": [f"{i}" for i in range(4)] + [f"s/{'pq'[i % 2]}/{i}" for i in range(9)], "two depths, a folder each": [f"{i}" for i in range(4)] + [f"s/{i}" for i in range(4)], "tree": tree,
        "deep": ["/".join("abcdefghijk"[: rng.randrange(1, 11)]) + f"/{i}" for i in range(60)], "equal folders": [f"{d}/{i}" for d in "zyx" for i in range(4)], "none": [],
    }


@pytest.mark.parametrize("name", sorted(shapes()))
def test_layout_equals_plain(spark, name):
    rng = random.Random(7)
    files = [(p, rng.randrange(60), rng.choice([0, rng.randrange(300)])) for p in shapes()[name]]
    got = {r["path"]: r for r in place_blocks(tiers(spark.createDataFrame(files, "path string, sloc long, debt long"))).collect()}
    floors = plain_tiers(files)
    assert len(got) == len(files)
    if not files:
        return
    n = len(floors[0])
    grid = math.ceil(math.sqrt(n))
    base = max(grid, math.ceil(n / grid)) + 1.1
    pitch = min(min(2.2, max(0.85, base * 0.105)), 0.5 * base / len(floors))
    tall = max(0.14, pitch - min(0.26, pitch * 0.26) - 0.14 * pitch)
    wide, most = max(1, *(f[1] for f in files), 1), max(f[2] for f in files)
    for k, floor in enumerate(floors):
        columns = math.ceil(math.sqrt(len(floor)))
        side = max(1.8, base * 0.74**k)
        fit = max(0.3, min(1.35, (side - 1.1) / max(columns, math.ceil(len(floor) / columns))))
        for i, (path, sloc, debt) in enumerate(sorted(floor)):
            r, row = got[path], i // columns
            width = (0.62 + 0.34 * math.sqrt(sloc / wide)) * fit
            share = 0.55 if most <= 0 else 0 if debt <= 0 else math.log1p(debt) / math.log1p(most)
            assert (r["floor"], r["row"], r["column"]) == (k, row, i % columns if row % 2 == 0 else columns - 1 - i % columns)
            assert (r["side"], r["width"], r["height"]) == pytest.approx((side, width, min(0.07 + (tall - 0.07) * share, width * 1.6)))


def test_numbers_over_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v int")
    got = numbered(df, F.desc("v")).collect()
    assert sorted((r["number"], r["v"]) for r in got) == [(i, 499 - i) for i in range(500)]
    got = numbered_within(df, "g", "v").collect()
    for g in ("a", "b", None):
        own = sorted(v for k, v in rows if k == g)
        assert sorted((r["number"], r["v"], r["group_size"]) for r in got if r["g"] == g) == [(i, v, len(own)) for i, v in enumerate(own)]
    assert numbered(df.where("false"), "v").collect() == []


def test_no_task_holds_a_floor(spark):
    files = spark.range(4000).select(F.format_string("d/%d", "id").alias("path"), F.col("id").alias("sloc"), F.lit(1).cast("long").alias("debt"), F.lit(0).alias("floor"))
    placed = numbered_within(files, "floor", "path")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    sizes = [r["n"] for r in numbered(files, "floor", "path").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
