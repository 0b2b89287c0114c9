"""Every query of the core runs on the smallest tables; a sample of them is compared with its SQL here, all are by the driver."""

from __future__ import annotations

import os

import pytest
from conftest import SF

import __spark_entry__ as entry
from tessera.plans import registry

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
SAMPLE = ["grade_by_language", "line_stats", "token_counts", "file_scores", "folder_rollup", "winnow_fingerprints", "clone_pairs", "history_monthly_rollup", "history_burst_collapse", "structural_findings", "notebook_cells", "language_keys", "cache_misses", "latest_generation", "upserts"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = db.execute(registry.ORACLE_SQL[name]).fetchdf()[list(got.columns)]
    rows = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in df.astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
