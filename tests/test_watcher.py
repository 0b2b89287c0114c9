"""A folder that is created, changed and deleted in under a stream that stops and starts again."""

from __future__ import annotations

import os
import shutil
import time

from pyspark.sql import functions as F

from tessera.sources.watcher import changes_between, watch_folder
from tessera.streaming.incremental import upsert, without_removed


def test_changes_between_listings():
    before = {"a.py": [1, 1, "python"], "d/b.py": [1, 1, "python"], "d/e/c.py": [1, 1, "python"]}
    assert changes_between({}, before) == (["a.py", "d/b.py", "d/e/c.py"], [])
    assert changes_between(before, before) == ([], [])
    assert changes_between(before, {"a.py": [2, 1, "python"], "d/b.py": [1, 1, "python"]}) == (["a.py"], ["d/e", "d/e/c.py"])
    assert changes_between(before, {"n.py": [1, 1, "python"]}) == (["n.py"], ["a.py", "d", "d/b.py", "d/e", "d/e/c.py"])


def test_stream_of_changes(spark, tmp_path):
    root = tmp_path / "project"
    stored = {"df": spark.createDataFrame([], "path string, generation long, text string")}
    seen: dict[int, list[tuple]] = {}  # by number: a batch that was cut off comes again
    batches = lambda: [seen[k] for k in sorted(seen)]

    def put(path: str, text: str) -> None:
        os.makedirs((root / path).parent, exist_ok=True)
        (root / path).write_text(text)

    def apply(batch, number: int) -> None:
        rows = batch.collect()
        if not rows:
            return
        gone = batch.where("kind = 'delete'").select("path")
        now = upsert(without_removed(stored["df"], gone), batch.where("kind = 'upsert'").select("path", "generation", "text"))
        stored["df"] = spark.createDataFrame(now.collect(), stored["df"].schema)  # a few rows, kept for the next batch
        seen[number] = sorted((r["path"], r["kind"], r["text"]) for r in rows)

    def start():
        return watch_folder(spark, str(root), excludes=("skip/**",)).writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()

    def wait(n: int) -> None:
        end = time.time() + 90
        while len(seen) < n and time.time() < end:
            time.sleep(0.1)
        assert len(seen) == n

    put("a.py", "one")
    put("d/b.py", "two")
    put("d/e/c.py", "three")
    put("skip/x.py", "no")
    put("notes.xyz", "no")
    query = start()
    try:
        wait(1)
        assert batches()[0] == [("a.py", "upsert", "one"), ("d/b.py", "upsert", "two"), ("d/e/c.py", "upsert", "three")]
        put("a.py", "one, changed")
        wait(2)
        shutil.rmtree(root / "d/e")
        wait(3)
        assert batches()[1:] == [[("a.py", "upsert", "one, changed")], [("d/e", "delete", None), ("d/e/c.py", "delete", None)]]
    finally:
        query.stop()
    put("f.py", "four")  # while nobody looks
    shutil.rmtree(root / "d")
    query = start()
    try:
        wait(4)
        assert batches()[3] == [("d", "delete", None), ("d/b.py", "delete", None), ("f.py", "upsert", "four")]
    finally:
        query.stop()
    assert sorted((r["path"], r["text"]) for r in stored["df"].collect()) == [("a.py", "one, changed"), ("f.py", "four")]
    assert stored["df"].agg(F.min("generation")).first()[0] > 0
