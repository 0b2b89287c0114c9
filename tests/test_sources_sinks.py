from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.sources import cache, config, files, notebooks
from tessera.streaming import incremental

GOOD = "def ok(a):\n    return a\n"


def project(tmp_path, **more):
    for name, text in {"a.py": GOOD, "lib/_hidden.py": GOOD, "node_modules/x.js": "x", "skip/b.py": GOOD, "gen.log": "x", ".gitignore": "skip/\n", "old.pas": "begin\n  x;\nend.\n", **more}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path)


def test_listing(tmp_path, spark):
    root = project(tmp_path, **{"big.py": "x = 1\n" * 300_000, "bin.py": "a\0b", "empty.py": ""})
    listed = files.list_files(root)
    assert [p for _, p, _ in listed] == ["a.py", "big.py", "bin.py", "empty.py", "lib/_hidden.py", "old.pas"]
    got = {r["path"]: (r["text"], r["skip_reason"]) for r in files.read_files(spark, listed).collect()}
    assert got["a.py"] == (GOOD, None)
    assert got["empty.py"] == ("", None)
    assert (got["big.py"][1], got["bin.py"][1]) == ("too large", "binary")
    assert files.read_store(spark, root).where("path LIKE '%a.py'").count() == 1


def test_config():
    c = config.parse_config('exclude = ["x/**"]\n[thresholds]\nlineLength = 100 # wide\nnesting = 0\nfoo = 1\n[gate]\nminGrade = "c"\nmaxDebtRatio = "x"\nfailOn = ["CQ001", "nope"]\noops\n')
    assert c.thresholds == {"line_length": 100}
    assert c.exclude == ("x/**",)
    assert (c.gate.min_grade, c.gate.max_debt_ratio, c.gate.fail_on) == ("C", None, ("CQ001",))
    assert len(c.problems) == 5
    p = config.parse_package(json.dumps({"tessera": {"thresholds": {"lineLength": 90}, "gate": {"minGrade": "B"}}}))
    assert (p.thresholds, p.gate.min_grade) == ({"line_length": 90}, "B")
    assert config.parse_package("{}") is None


def test_notebook(spark):
    book = json.dumps({"cells": [{"cell_type": "markdown", "source": "# hi"}, {"cell_type": "code", "source": ["!pip x\n", "def load():\n", "    pass"]}, {"cell_type": "code", "source": "x = 1"}]})
    df = spark.createDataFrame([("n", book), ("bad", "{nope")], "path string, text string")
    assert [(r["line"], r["cell"], r["code"]) for r in notebooks.code_lines(df).orderBy("line").collect()] == [(0, 2, "# !pip x"), (1, 2, "def load():"), (2, 2, "    pass"), (3, 3, "x = 1")]
    assert {r["path"]: r["valid"] for r in notebooks.as_python(df).collect()} == {"n": True, "bad": False}


def test_cache(spark, tmp_path):
    folder = str(tmp_path / "cache")
    df = cache.with_key(spark.createDataFrame([("a", "c", "x"), ("b", "c", "y")], "path string, language_key string, text string"))
    assert cache.read(spark, folder) is None
    cache.append(df.where("path = 'a'").select("content_key", F.lit(1).alias("lines")), folder)
    kept = cache.read(spark, folder)
    assert [r["path"] for r in cache.misses(df, kept).collect()] == ["b"]
    assert [r["path"] for r in cache.hits(df, kept).collect()] == ["a"]
    cache.clear(spark, folder)
    assert cache.read(spark, folder) is None


def test_incremental(spark, tmp_path):
    schema = "path string, generation int, text string"
    stored = spark.createDataFrame([("a", 1, "old"), ("b/c", 1, "x"), ("b2", 1, "y")], schema)
    news = spark.createDataFrame([("a", 2, "new"), ("a", 0, "late"), ("b2", 1, "same"), ("d", 1, "z")], schema)
    got = {r["path"]: r["text"] for r in incremental.upsert(stored, news).collect()}
    assert got == {"a": "new", "b/c": "x", "b2": "y", "d": "z"}
    assert {r["path"] for r in incremental.without_removed(stored, spark.createDataFrame([("b",)], "path string")).collect()} == {"a", "b2"}
    live = spark.createDataFrame([("a", "typed")], "path string, text string")
    assert {r["path"]: (r["text"], r["cacheable"]) for r in incremental.overlay(stored, live).collect()}["a"] == ("typed", False)


def test_stream(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "path string, generation int, text string").coalesce(1).write.json(source)
    stream = spark.readStream.schema("path string, generation int, text string").json(source)
    q = incremental.watch(stream, lambda batch, n: seen.extend((r["path"], r["text"]) for r in batch.collect()), str(tmp_path / "ck"), once=True)
    assert q.awaitTermination(60)
    assert sorted(seen) == [("a", "z"), ("b", "q")]
    assert (incremental.progress(q)["batch"], incremental.progress(q)["rows"]) == (0, 4)


def test_scan(spark, tmp_path, capsys):
    heavy = "def heavy(a, b, c, d, e, f, g, h):\n" + "".join(f"    if a > {i} and b:\n        c()\n" for i in range(12))
    root = project(tmp_path, **{"heavy.py": heavy, "bad.ipynb": "{"})
    assert cli.scan(spark, root, ("table", "json", "sarif", "html")) == 0
    said = capsys.readouterr().out
    assert "heavy.py" in said
    assert "grade" in said
    report = json.loads((tmp_path / "tessera-report.json").read_text())
    assert [f["path"] for f in report["files"]] == ["a.py", "bad.ipynb", "heavy.py", "lib/_hidden.py", "old.pas"]
    assert {f["path"]: f["tier"] for f in report["files"]}["old.pas"] == 2
    sarif = json.loads((tmp_path / "tessera-report.sarif").read_text())["runs"][0]
    assert sarif["results"]
    assert all(sarif["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"] for r in sarif["results"])
    assert "class='A'" in (tmp_path / "tessera-report.html").read_text()
    assert "<svg" in (tmp_path / "tessera-report.html").read_text()
    assert cli.scan(spark, root, min_grade="A", quiet=True) in (0, 1)


def test_command_line(tmp_path, capsys):
    assert cli.main(["init", str(tmp_path)]) == 0
    assert os.path.exists(tmp_path / config.FILE_NAME)
    assert cli.main(["init", str(tmp_path)]) == 2
    assert config.load_config(str(tmp_path)).problems == []
    assert cli.main(["scan", str(tmp_path), "--format", "nope"]) == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["--nope"])
    assert e.value.code == 2
