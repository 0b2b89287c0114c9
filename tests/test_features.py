"""Settings that change, workspaces, warm scans, notebooks in a scan, lanes."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from tessera import cli
from tessera.operators import clones, history, languages, rules, structure
from tessera.session import cancel_background, lane
from tessera.sources import cache, config, files


def test_config_watch(tmp_path):
    path = tmp_path / config.FILE_NAME
    path.write_text("[thresholds]\nnesting = 4\n")
    watch = config.ConfigWatch(str(tmp_path))
    assert (watch.config.thresholds, watch.poll()) == ({"nesting": 4}, False)
    path.write_text("[thresholds]\nnesting = 4\n[gate]\nminGrade = 'B'\n")
    assert (watch.poll(), watch.config.gate.min_grade) == (False, "B")  # no limit has changed
    path.write_text("[thresholds]\nnesting = 5\n")
    os.utime(path, (time.time(), time.time() + 5))
    assert (watch.poll(), watch.config.thresholds, watch.poll()) == (True, {"nesting": 5}, False)
    path.unlink()
    assert (watch.poll(), watch.config.thresholds) == (True, {})


def test_settings_and_bounds():
    assert config.parse_config("[gate]\nmaxDebtRatio = 101\n").gate.max_debt_ratio is None
    assert config.parse_config("[gate]\nmaxDebtRatio = 100\n").gate.max_debt_ratio == 100
    live = config.LiveSettings(live_delay_ms=1, max_symbols=0, limits={"nesting": 2, "duplication_tokens": 3})
    limits, source = live.thresholds(config.parse_config("[thresholds]\nnesting = 6\nparameters = 5\n"))
    assert (live.live_delay_ms, live.max_symbols, limits.nesting, limits.parameters, limits.duplication_tokens) == (50, 1, 2, 5, 20)
    assert (source["nesting"], source["parameters"], source["cyclomatic"]) == ("explicit", "project", "default")


def test_workspace(tmp_path):
    for name, text in {"one/a.py": "x = 1", "one/deps/b.py": "x", "one/.gitignore": "c.py", "one/c.py": "x", "two/c.py": "x", "two/site-packages/d.py": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    roots = [str(tmp_path / "two"), str(tmp_path / "one")]
    assert [p for _, p, _ in files.list_roots(roots)] == ["one/a.py", "two/c.py"]
    assert [p for _, p, _ in files.list_roots(roots[:1])] == ["c.py"]


def notebook(*cells):
    return json.dumps({"cells": [{"cell_type": "code", "source": c} for c in cells]})


def raw_files(spark, *rows):
    return spark.createDataFrame([(p, k, t, None) for p, k, t in rows], "path string, language_key string, text string, skip_reason string")


def test_notebook_functions_have_their_cell(spark):
    raw = raw_files(spark, ("n.ipynb", "notebook:python", notebook("x = 1\n", "def load():\n    pass")), ("a.py", "python", "def load():\n    pass\n"), ("bad.ipynb", "notebook:python", "{"))
    got = {r["path"]: ([f["name"] for f in r["functions"]], r["tier"]) for r in cli.analyze_files(raw, rules.Thresholds()).collect()}
    assert got == {"n.ipynb": (["load (cell 2)"], 1), "a.py": (["load"], 1), "bad.ipynb": ([], 3)}


def test_parsed_files_give_their_own_tokens_to_clones(spark):
    lines = [f"local v{i} = f(a{i}, {i}) + g(b{i})" for i in range(30)]
    noted = [x for i, line in enumerate(lines) for x in (line, f"-- a note, number {i}")]  # comments that the plain tokenizer takes for code
    raw = raw_files(spark, ("a.lua", "lua", "\n".join(lines)), ("b.lua", "lua", "\n".join(noted)))
    got = {r["path"]: [(b["partner_path"], b["start_line"]) for b in r["blocks"]] for r in cli.analyze_files(raw, rules.Thresholds()).collect()}
    assert got == {"a.lua": [("b.lua", 0)], "b.lua": [("a.lua", 0)]}
    plain = clones.clone_blocks(clones.token_arrays(raw))
    assert plain.count() == 0


def test_warm_scan(spark, tmp_path):
    folder = str(tmp_path / "cache")
    rows = [("a.py", "python", "def f(a):\n    return a\n"), ("copy.py", "python", "def f(a):\n    return a\n"), ("x.pas", "tier2:pascal", "begin\n  x;\nend.\n"), ("broken.py", "python", "def ("), ("m.min.js", "javascript", "x")]
    result = lambda raw, f: sorted((r["path"], r["tier"], r["sloc"], len(r["functions"]), r["grade"], r["has_syntax_errors"], r["skip_reason"]) for r in cli.analyze_files(raw, rules.Thresholds(), f).collect())
    cold = result(raw_files(spark, *rows), None)
    assert result(raw_files(spark, *rows), folder) == cold
    known = cache.read(spark, folder).count()
    assert known == 3  # one for each content that isn't skipped
    assert result(raw_files(spark, *rows), folder) == cold
    assert cache.read(spark, folder).count() == known
    more = [*rows, ("new.py", "python", "y = 2\n")]
    assert result(raw_files(spark, *more), folder) == result(raw_files(spark, *more), None)
    assert cache.read(spark, folder).count() == known + 1


def test_lanes(spark):
    with lane(spark, "live"):
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "live"
        assert spark.range(10).count() == 10
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    cancel_background(spark)
    assert spark.range(10).count() == 10


def test_series_are_cleared(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, t long")
    assert [r["t"] for r in history.clear(df, "a").orderBy("t").collect()] == [2, 3]
    assert [r["t"] for r in history.clear(df, None).orderBy("t").collect()] == [1, 2]


def test_every_extension_has_a_language(spark):
    known = languages.known_extensions(spark).withColumn("found", languages.detect_language(F.concat(F.lit("a/b"), F.upper("extension"))))
    assert known.where("found IS NULL OR found <> language_key").count() == 0
    assert known.count() == len(languages.extension_map()) + 1


def test_cells_of_functions(spark):
    functions = spark.createDataFrame([("n", 0, "f"), ("n", 3, "g"), ("other", 0, "h")], "path string, start_line int, name string")
    cells = spark.createDataFrame([("n", 0, 1), ("n", 3, 4)], "path string, line int, cell int")
    assert {r["name"] for r in structure.name_by_cell(functions, cells).collect()} == {"f (cell 1)", "g (cell 4)", "h"}
