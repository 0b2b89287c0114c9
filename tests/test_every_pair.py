"""Pairs of files that share fingerprints: all of them, however many files have one."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from tessera.operators import clones
from tessera.plans import registry

PRINTS = "path string, pos int, hash long"


def pairs_of(rows):
    """Brute force over (path, pos, hash)."""
    out, by_hash = Counter(), {}
    for p, _, h in rows:
        if p is not None and h is not None:
            by_hash.setdefault(h, []).append(p)
    for paths in by_hash.values():
        out.update((a, b) for a in paths for b in paths if a < b)
    return dict(out)


def got_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == ["path", "partner", "shared"] and len({r[:2] for r in rows}) == len(rows)
    return {r[:2]: r[2] for r in rows}


def test_fingerprint_of_more_files_than_are_kept(spark):
    """100 files under one fingerprint are 4,950 pairs; the first 64 places led to 2,016 of them."""
    alike = [(f"f{i:03}", 0, 7) for i in range(100)]
    assert got_of(clones.clone_pairs(spark.createDataFrame(alike, PRINTS), None)) == pairs_of(alike)
    apart = alike + [(f"f{i:03}", 1, 1000 + i) for i in range(100)]  # no two have the same fingerprints
    got = got_of(clones.clone_pairs(spark.createDataFrame(apart, PRINTS), None))
    assert got == pairs_of(apart) and len(got) == 4950
    often = [(p, i, 7) for p in "ab" for i in range(200)]
    assert got_of(clones.clone_pairs(spark.createDataFrame(often, PRINTS), None)) == {("a", "b"): 40_000}


@pytest.mark.parametrize("pieces", [False, True])
def test_pairs_are_those_of_brute_force(spark, monkeypatch, pieces):
    """Copies, near copies, repeats within a file and nulls; with hot fingerprints in pieces and classes in blocks, too."""
    if pieces:
        for name, value in (("MEET_ROWS", 20), ("MEET_PIECE", 7), ("COPIES", 3)):
            monkeypatch.setattr(clones, name, value)
    rng = np.random.default_rng(8)
    bags = [rng.integers(0, 40, rng.integers(0, 7)).tolist() for _ in range(60)]
    bags += [bags[0]] * 30 + [[1, 1, 2]] * 20 + [[1, 2, 2]] + [[1, 1, 2, 99]] * 2 + [[500 + i, 1] for i in range(50)]
    names = rng.permutation(len(bags))
    rows = [(f"f{n}", i, int(h)) for n, bag in zip(names, bags, strict=True) for i, h in enumerate(rng.permutation(bag))]
    rows += [(None, 0, 1), ("f1", 90, None), ("null", 0, None)]
    assert got_of(clones.clone_pairs(spark.createDataFrame(rows, PRINTS).repartition(5), None)) == pairs_of(rows)


def test_query_and_sql_give_all_pairs(spark, tmp_path):
    """100 documents of one text, of which the first 64 were partners."""
    duckdb = pytest.importorskip("duckdb")
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text + f" own{i}" * (i % 3), "en", "web") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = got_of(registry.QUERIES["clone_pairs"](spark, str(tmp_path)))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[:2]: r[2] for r in db.execute(registry.ORACLE_SQL["clone_pairs"]).fetchall()}
    assert len(got) == 4950 and got == want
