"""Debounce and burst collapse: keyed state against the same rule over a table."""

from __future__ import annotations

import datetime as dt
import random
import time

from tessera.streaming.quiet import debounce, quiet_rows, quiet_stream

SCHEMA = "path string, ts timestamp, generation long, text string"
START = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)


def edits(seed: int, n: int, docs: int = 4) -> list[tuple]:
    rng = random.Random(seed)
    at, out = 0, []
    for i in range(n):
        at += rng.choice([0, 100, 200, 299, 300, 301, 900])
        out.append((f"d{rng.randrange(docs)}", START + dt.timedelta(milliseconds=at), i, None if rng.random() < 0.1 else f"v{i}"))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def feed(spark, tmp_path, slices: list[list[tuple]], make, name: str):
    """The rows that a streaming query puts out when each slice is a batch."""
    source, target, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
    query = None
    for k, part in enumerate(slices):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k == 0 or k == len(slices) // 2:  # stopped and started again from its checkpoint in between
            if query:
                query.stop()
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            query = make(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).start()
        query.processAllAvailable()
    query.stop()
    return spark.read.schema(SCHEMA).parquet(target)


def test_stream_equals_table(spark, tmp_path):
    rows = edits(3, 160)
    slices, at = [], 0
    while at < len(rows):
        part = rows[at : at + 40]
        random.Random(at).shuffle(part)  # any order within a batch
        slices.append(part)
        at += 40
    for k in range(0, 40, 3):  # and a third of the rows over batches, within the watermark
        slices[0][k], slices[1][k], slices[2][k], slices[3][k] = slices[3][k], slices[2][k], slices[0][k], slices[1][k]
    end = [("clock", START + dt.timedelta(hours=h), 10_000 + h, "tick") for h in (1, 2)]
    got = feed(spark, tmp_path, [*slices, end[:1], end[1:]], lambda s: quiet_stream(s, "path", "ts", 300, "5 minutes", ("generation",)), "quiet")
    want = quiet_rows(spark.createDataFrame(rows, SCHEMA), "path", "ts", 300, "generation")
    assert rows_of(got.where("path <> 'clock'")) == rows_of(want)
    assert 0 < want.count() < len(rows)


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    slices = [[("a", at(0), 1, "x")], [("a", at(500), 2, "y")], [("a", at(501), 3, "z")], [("a", at(1), 4, "late")], [("a", at(2000), 5, "end")], [("a", at(4000), 6, "open")]]
    got = feed(spark, tmp_path, slices, lambda s: quiet_stream(s, "path", "ts", 60_000, "10 seconds"), "late")
    assert [r["text"] for r in got.orderBy("ts").collect()] == ["x", "z", "end"]


def test_debounce_lets_out_the_newest_once(spark, tmp_path):
    source, state = str(tmp_path / "edits"), str(tmp_path / "state")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    seen: list[tuple] = []
    stream = debounce(spark.readStream.schema(SCHEMA).parquet(source), 1500)
    query = stream.writeStream.foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", state).trigger(processingTime="100 milliseconds").start()
    put = lambda *rows: spark.createDataFrame([(p, START, g, t) for p, g, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    try:
        put(("a", 1, "a1"), ("b", 1, "b1"), ("a", 3, "a3"), ("a", 2, "a2"))
        put(("b", 2, "b2"), ("a", 2, "old"))
        end = time.time() + 60
        while len(seen) < 2 and time.time() < end:
            time.sleep(0.2)
        assert sorted((p, t) for p, _, _, t in seen) == [("a", "a3"), ("b", "b2")]
        put(("a", 4, None))
        end = time.time() + 60
        while len(seen) < 3 and time.time() < end:
            time.sleep(0.2)
        assert seen[2][0] == "a" and seen[2][3] is None
    finally:
        query.stop()


def test_no_rows(spark):
    assert quiet_rows(spark.createDataFrame([], SCHEMA), "path", "ts", 300).collect() == []
