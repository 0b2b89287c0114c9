from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import clones, history

TOKENS = "path string, ids array<long>, lines array<int>"


def tokens(spark, **files):
    return spark.createDataFrame([(k.replace("_", "."), list(map(int, v)), [i // 10 for i in range(len(v))]) for k, v in files.items()], TOKENS)


def own(start, n):
    return range(10_000 * start, 10_000 * start + n)


def test_shared_block(spark):
    shared = list(own(9, 150))
    t = tokens(spark, a_js=[*own(1, 40), *shared, *own(2, 30)], b_js=[*own(3, 5), *shared])
    got = {r["path"]: r for r in clones.clone_blocks(t).collect()}
    a = got["a.js"]
    assert (a["tokens"], a["partner_path"], a["start_line"], a["partner_line"]) == (150, "b.js", 4, 0)
    assert clones.clone_pairs(clones.fingerprints(t)).count() == 1


def test_short_and_removed(spark):
    assert clones.clone_blocks(tokens(spark, a=[*own(1, 10), *own(9, 80)], b=own(9, 80))).count() == 0
    same = tokens(spark, a=own(9, 130), b=own(9, 130))
    assert clones.clone_blocks(same).count() == 2
    assert clones.clone_blocks(same.where("path = 'a'")).count() == 0


def test_periodic_text_does_not_match_itself_shifted(spark):
    got = clones.clone_blocks(tokens(spark, a=[i % 4 for i in range(300)])).collect()
    assert all(r["tokens"] <= 300 for r in got)


def test_guarantee(spark):
    """Any shared run of the threshold's length has a common fingerprint."""
    rng = np.random.default_rng(5)
    k, w = clones.window_sizes(30)
    for _ in range(50):
        run = rng.integers(0, 50, 30)
        a, b = (np.concatenate((rng.integers(0, 50, rng.integers(0, 40)), run, rng.integers(0, 50, rng.integers(0, 40)))) for _ in range(2))
        prints = [{int(h[p]) for p in clones.winnow(h, w)} for h in (clones.kgram_hashes(a, k), clones.kgram_hashes(b, k))]
        assert prints[0] & prints[1]


def test_affected(spark):
    t = tokens(spark, a=own(9, 130), b=own(9, 130), c=own(5, 130))
    changed = spark.createDataFrame([("a",)], "path string")
    assert {r[0] for r in clones.affected_paths(clones.fingerprints(t), changed).collect()} == {"a", "b"}


SAMPLE = "key string, t long, grade string, score long, debt_minutes long, sloc long, files long, n long"


def test_bursts(spark):
    rows = [("w", t, "A", i, 1, 1, 1, None) for i, t in enumerate((0, 59_999, 119_999, 300_000))]
    assert [r["t"] for r in history.collapse_bursts(spark.createDataFrame(rows, SAMPLE)).orderBy("t").collect()] == [59_999, 119_999, 300_000]


def test_roll_up_and_cap(spark):
    hour, jan = 3_600_000, 1_735_689_600_000
    rows = [("w", jan + i * hour, "B", 50, 10, 100, 5, None) for i in range(40)]
    rows += [("w", jan + 200 * 86_400_000 + i * hour, "A", 80, 10, 100, 5, None) for i in range(250)]
    got = history.roll_up(spark.createDataFrame(rows, SAMPLE), jan + 205 * 86_400_000)
    old = got.where(F.col("t") < jan + 86_400_000 * 100).collect()
    assert [(r["n"], r["score"], r["grade"]) for r in old] == [(40, 50, "B")]
    assert history.keep_newest(got).count() == 200


def test_delta_and_sparkline(spark):
    df = spark.createDataFrame([("w", 0, "A", 50, 1, 1, 1, None), ("w", 86_400_000, "A", 65, 1, 1, 1, None), ("w", 259_200_000, "A", 80, 1, 1, 1, None), ("x", 0, "A", 1, 1, 1, 1, None)], SAMPLE)
    r = history.delta(df).collect()
    assert [(x["key"], x["since_start"], x["since_last"], x["span"]) for x in r] == [("w", 30, 15, 259_200_000)]
    points = {x["key"]: x["points"] for x in history.sparkline(df, 100, 10).collect()}
    assert points == {"w": "0.0,5.0 33.3,3.5 100.0,2.0", "x": ""}
    assert spark.range(1).select(history.trend_caption(F.lit(30), F.lit(259_200_000))).first()[0] == "improved by 30 points over 3 days"
