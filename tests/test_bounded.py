"""What a Python worker holds doesn't grow with the input: batches are bounded, and so is the work on one."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import clones
from tessera.session import BATCH_BYTES, BATCH_ROWS

TOKENS = "path string, ids array<long>, lines array<int>"


@pytest.fixture
def plain_limits(spark):
    """Spark's own limits of an Arrow batch before, and none of ours after."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    for k in keys:
        spark.conf.unset(k)
    yield
    for k in keys:
        spark.conf.unset(k)


def largest(df):
    """Rows and bytes of the largest Arrow batch that a worker gets of df."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    got = df.coalesce(1).mapInArrow(run, "n long, bytes long").collect()
    return max(r["n"] for r in got), max(r["bytes"] for r in got)


def test_winnow_needs_some_words_a_hash():
    hashes = np.random.default_rng(2).integers(0, 1 << 50, 100_000)
    tracemalloc.start()
    clones.winnow(hashes, 81)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * hashes.nbytes


def test_lists_of_a_batch_are_winnowed_apart():
    rng = np.random.default_rng(3)
    for w in (1, 2, 7, 81):
        sizes = np.array([0, 5, 1, 0, 200, 6, 80, 81, 82, 0])
        hashes = rng.integers(0, 9, sizes.sum())
        lists = np.split(hashes, np.cumsum(sizes)[:-1])
        least = lambda x: {max(range(i, min(i + w, len(x))), key=lambda p: (-x[p], p)) for i in range(max(1, len(x) - w + 1))} if len(x) else set()  # noqa: B023, E731
        pos, of = clones.winnow_lists(hashes, sizes, w)
        assert [(n, p) for n, x in enumerate(lists) for p in sorted(least(x))] == list(zip(of.tolist(), pos.tolist(), strict=True))


def test_fingerprints_of_files_in_one_batch(spark, plain_limits):
    rng = np.random.default_rng(4)
    files = {f"f{i}": rng.integers(0, 1 << 32, n).tolist() for i, n in enumerate((0, 19, 20, 99, 100, 101, 700))} | {"none": None}
    made = clones.fingerprints(spark.createDataFrame([(p, x, None) for p, x in files.items()], TOKENS).coalesce(1))
    want = set()
    for p, x in files.items():
        h = clones.kgram_hashes(np.array(x or [], np.int64), 20)
        want |= {(p, int(i), int(h[i])) for i in clones.winnow(h, 81)}
    assert {tuple(r) for r in made.collect()} == want
    n, size = largest(spark.range(9000).selectExpr("'f' AS path", "array_repeat(id, 1000) AS ids"))
    assert n <= BATCH_ROWS and size < 2 * BATCH_BYTES


def test_places_of_files_are_the_kept_ones(spark):
    """Counts by file say what the kept places by row number say, cut ones too."""
    rng = np.random.default_rng(5)
    prints = spark.createDataFrame([(f"f{int(rng.integers(9))}", i, int(rng.integers(6))) for i in range(300)], "path string, pos int, hash long")
    for most in (1, 7, 40, 64):
        _, places = clones.places_by_path(prints, most)
        want = clones.cap_occurrences(prints, most).groupBy("hash", "path").count()
        assert {tuple(r) for r in places.collect()} == {tuple(r) for r in want.collect()}


def test_files_meet_once_under_a_repeated_fingerprint(spark):
    """Two files of 200 equal places meet in one row, not in 200 times 64."""
    prints = spark.createDataFrame([(p, i, 7) for p in "ab" for i in range(200)], "path string, pos int, hash long")
    met = clones.meetings(*clones.places_by_path(prints))
    assert sorted((r["path"], r["partner"], r["n"], r["m"]) for r in met.collect()) == [("a", "a", 200, 64), ("b", "a", 200, 64)]
    assert clones.clone_pairs(prints).collect() == [] == clones.seeds(prints).where("path < partner").collect()


def test_heavy_keys_of_a_hot_key_shuffle_counts(spark):
    """Where summaries would be large, and where a hot key is looked up, tasks send counts and not rows."""
    from tessera.operators.hot_keys import MOST_COUNTERS, heavy_keys

    rows = spark.range(0, 60_000, 1, 4).selectExpr("CASE WHEN id % 2 = 0 THEN -5 ELSE id END AS h")
    got = heavy_keys(rows, "h", 2)
    assert 2 * 60_000 // 2 > MOST_COUNTERS and [tuple(r) for r in got.collect()] == [(-5, 30_000)]
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_symbols_parse_once(spark):
    """Functions and findings come from one kept table: the plan has no parse in it any more."""
    from conftest import SF

    from tessera.plans import result_queries

    for query in (result_queries.symbols_left_join, result_queries.panel_symbols):
        assert "MapInArrow" not in query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
