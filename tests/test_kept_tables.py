"""Bucketed tables, the fingerprint index and roll-ups that are kept over changes, each against a rebuild."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import clones
from tessera.operators.clone_index import CloneIndex
from tessera.operators.kept_rollups import KeptRollups
from tessera.operators.rollups import corpus_score, folder_scores
from tessera.sources import cache
from tessera.sources.buckets import BucketStore


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_store_puts_adds_and_removes(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), {"t": "k"}, 8)
    make = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    assert store.read("t") is None and store.version() == 0
    assert store.put("t", make(("a", 1), ("b", 2), ("b", 3), (None, 4))) == 1
    assert store.put("t", make(("b", 5), ("c", 6))) == 2
    assert rows_of(store.read("t")) == sorted([("a", 1), ("b", 5), ("c", 6), (None, 4)], key=repr)
    assert store.add("t", make(("a", 9), ("c", 9))) == 2  # nothing new: nothing is written
    assert store.add("t", make(("a", 9), ("d", 7), ("d", 7))) == 3
    assert store.remove("t", make(("b", 0), ("nowhere", 0))) == 4
    want = sorted([("a", 1), ("c", 6), ("d", 7), (None, 4)], key=repr)
    assert rows_of(store.read("t")) == want
    assert BucketStore(spark, str(tmp_path / "s"), {"t": "k"}, 99).buckets == 8
    assert store.sweep() > 0 and rows_of(store.read("t")) == want
    assert store.put("t", make()) == 4
    with pytest.raises(ValueError, match="columns"):
        store.put("t", make(("a", 1)).withColumnRenamed("v", "w"))


def test_failed_write_leaves_the_old_state(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), {"t": "k", "u": "k"}, 4)
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(20)], "k string, v int")
    store.put("t", rows)
    broken = rows.withColumn("v", F.when(F.col("k") == "k7", F.raise_error(F.lit("lost"))).otherwise(F.col("v") + 1).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.replace({"u": (range(4), rows), "t": (range(4), broken)})
    assert store.version() == 1 and store.read("u") is None and rows_of(store.read("t")) == rows_of(rows)
    other = BucketStore(spark, str(tmp_path / "s"), {"t": "k"}, 4)
    number, manifest = store._latest()
    other.put("t", rows.withColumn("v", F.col("v") * 2))
    with pytest.raises(Exception, match="(?i)exist"):  # the slower of two writers
        store._publish(number + 1, manifest)
    assert rows_of(store.read("t")) == rows_of(rows.withColumn("v", F.col("v") * 2))


def test_reads_prune_buckets(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), {"t": "k"}, 16)
    store.put("t", spark.range(1000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")))
    one = spark.createDataFrame([("17",)], "k string")
    part = store.read("t", store.touched("t", one))
    assert len(part.inputFiles()) == 1 and len(store.read("t").inputFiles()) >= 16
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert part.where("k = '17'").count() == 1


def test_cache_neither_grows_nor_tears(spark, tmp_path):
    folder = str(tmp_path / "c")
    files = cache.with_key(spark.createDataFrame([(f"p{i}", "python", f"text {i % 7}") for i in range(20)], "path string, language_key string, text string"))
    measured = files.select("content_key", F.length("text").alias("n"))
    assert cache.append(measured, folder) == 1
    before = cache.read(spark, folder).inputFiles()
    assert cache.append(measured, folder) == 1 and cache.read(spark, folder).inputFiles() == before
    assert cache.read(spark, folder).count() == 7
    assert cache.misses(files, cache.read(spark, folder, files)).count() == 0
    assert cache.hits(files, cache.read(spark, folder, files)).count() == 20


def texts(seed: int, n: int) -> dict[str, list[int]]:
    rng = random.Random(seed)
    shared = [[rng.randrange(1000) for _ in range(60)] for _ in range(4)]
    return {f"f{i}": [rng.randrange(1000) for _ in range(30)] + (rng.choice(shared) if rng.random() < 0.6 else []) + [rng.randrange(1000) for _ in range(20)] for i in range(n)}


def test_index_after_changes_equals_a_rebuild(spark, tmp_path):
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, ids array<long>")
    index, state = CloneIndex(spark, str(tmp_path / "i"), 40, 8), texts(1, 24)
    assert index.apply().collect() == []
    index.apply(frame(state))
    rng = random.Random(5)
    for step in range(4):
        before = clones.fingerprints(frame(state), 40)
        changed = {p: v for p, v in texts(10 + step, 24).items() if rng.random() < 0.25} | {f"new{step}": state["f3"] if "f3" in state else [1] * 50}
        removed = rng.sample(sorted(state), 3)
        state = {k: v for k, v in state.items() if k not in removed} | changed
        paths = spark.createDataFrame([(p,) for p in {*changed, *removed}], "path string")
        affected = index.apply(frame(changed), spark.createDataFrame([(p,) for p in removed] + [(None,)], "path string"))
        rebuilt = clones.fingerprints(frame(state), 40)
        assert rows_of(index.fingerprints().select("path", "pos", "hash")) == rows_of(rebuilt)
        own = {r["hash"] for r in before.union(rebuilt).join(paths, "path", "left_semi").collect()}
        want = {r["path"] for r in before.union(rebuilt).collect() if r["hash"] in own} | {r["path"] for r in paths.collect()}
        assert {r["path"] for r in affected.collect()} == want
    some = spark.createDataFrame([("f1",), ("new3",)], "path string")
    assert rows_of(index.seeds_of(some)) == rows_of(clones.seeds(rebuilt).join(some, "path", "left_semi").select("path", "pos", "partner", "partner_pos"))
    index.apply(removed=frame(state).select("path"))
    assert index.fingerprints().collect() == []


def test_rollups_after_changes_equal_a_rebuild(spark, tmp_path):
    kept, rng, state = KeptRollups(spark, str(tmp_path / "r"), 8), random.Random(2), {}
    names = [f"{a}/{b}/{c}.py" for a in "xy" for b in "pq" for c in range(3)] + ["top.py"]
    schema = "path string, generation long, tier int, debt_minutes long, sloc long"
    for step in range(1, 6):
        rows = [(p, step, rng.choice([1, 2, 3]), rng.randrange(90), rng.randrange(1, 50)) for p in rng.sample(names, 6)]
        gone = {2: ["x/p"], 4: ["y/q/1.py", "nowhere"]}.get(step, [])
        stale = [(p, 0, 1, 10_000, 1) for p in list(state)[:2]]
        state = {p: v for p, v in state.items() if not any(p == g or p.startswith(g + "/") for g in gone)}
        stale = [r for r in stale if r[0] in state]
        state |= {r[0]: r for r in rows}
        batch = spark.createDataFrame(rows + stale, schema)
        for _ in range(1 + (step == 3)):  # a batch that comes twice counts once
            kept.apply(batch, spark.createDataFrame([(g,) for g in gone], "path string") if gone else None)
            gone = []
        whole = spark.createDataFrame(list(state.values()), schema)
        assert rows_of(kept.files().select(whole.columns)) == rows_of(whole)
        want = folder_scores(whole)
        assert rows_of(kept.folders().select(want.columns)) == rows_of(want)
        total = corpus_score(whole)
        assert rows_of(kept.corpus().select(total.columns)) == rows_of(total)
