from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import generic, ranking, rollups, routing, rules, structure

FILE = "path string, language_key string, text string"
HEAVY = "def heavy(a, b, c, d, e, f, g, h):\n    for i in a:\n        for j in b:\n            while c:\n" + "".join(f"                if x > {i} and y:\n                    z()\n" for i in range(12))
MIXED = "def mixed(x, y, z):\n    match x:\n        case 1:\n            return 1 if y else 2\n        case _:\n            pass\n    try:\n        do_it()\n    except ValueError:\n        if y and z or x:\n            return 3\n    return 0\n"
TWO = "def classify(a, b):\n    if a > 0 and b > 0:\n        return 1\n    elif a < 0:\n        return 2\n    else:\n        return 3\n\n\ndef loop(n, m):\n    for i in range(n):\n        while i < m:\n            if i:\n                pass\n"
CLASS = "class A:\n    def one(self):\n        def inner():\n            return [x for x in y if x]\n        return inner\n    f = lambda self: 1\n# TODO: more\n# tessera-disable-next-line CQ004\n"


def numbers(code: str) -> list[tuple]:
    return [(f["name"], f["kind"], f["cyclomatic"], f["cognitive"], f["max_nesting"], f["params"]) for f in structure.PythonFile(code).functions]


def test_golden_metrics():
    assert numbers(TWO) == [("classify", "function", 4, 4, 1, 2), ("loop", "function", 4, 6, 3, 2)]
    assert numbers(MIXED) == [("mixed", "function", 7, 8, 2, 3)]
    assert numbers(HEAVY)[0][2] == 28


def test_classes_and_nesting():
    p = structure.PythonFile(CLASS)
    assert [(f["name"], f["kind"]) for f in p.functions] == [("one", "method"), ("inner", "function"), ("f", "lambda")]
    assert [(c["name"], c["methods"]) for c in p.classes] == [("A", 1)]
    assert numbers(CLASS)[1][2:4] == (3, 2)  # a comprehension's for and if
    assert [t["text"] for t in p.todos] == ["TODO more"]
    assert p.suppressions == [{"scope": "nextLine", "line": 7, "rules": ["CQ004"]}]


def test_findings_of_functions(spark):
    files = spark.createDataFrame([("h.py", "python", HEAVY), ("bad.py", "python", "def f(:\n  x"), ("ok.py", "python", "x = 1\n")], FILE)
    done = rollups.score_files(rules.evaluate(structure.analyze(routing.route(files))))
    by = {r["path"]: r for r in done.collect()}
    found = {f["rule_id"]: f for f in by["h.py"]["findings"]}
    assert (found["CQ001"]["severity"], found["CQ001"]["debt_minutes"]) == ("critical", 28)
    assert (found["CQ004"]["value"], found["CQ004"]["debt_minutes"]) == (8, 20)
    assert {"CQ002", "CQ005"} <= set(found)
    assert by["bad.py"]["tier"] == 2
    assert [f["rule_id"] for f in by["bad.py"]["findings"]] == ["CQ012"]
    assert by["ok.py"]["findings"] == []
    mart = {r["path"]: r for r in rollups.file_mart(done).collect()}
    assert mart["h.py"]["max_cc"] == 28
    assert mart["ok.py"]["rules"] == []
    functions = done.select("path", F.explode_outer("functions").alias("f")).where("f IS NOT NULL").select("path", "f.name", "f.start_line", "f.sloc")
    s = rollups.symbols(functions, rollups.explode_findings(done)).collect()
    assert [(r["name"], r["debt_minutes"]) for r in s] == [("heavy", sum(f["debt_minutes"] for f in by["h.py"]["findings"]))]


def test_long_lines(spark):
    files = spark.createDataFrame([("a", "tier2:d", "\n".join("x" * 200 for _ in range(50)))], FILE)
    found = rules.evaluate(generic.measure_generic(files).withColumn("tier", F.lit(2))).first()["findings"]
    assert len(found) == 21
    assert sum(f["debt_minutes"] for f in found) == 50


@pytest.mark.parametrize(("suppressions", "left"), [([("line", 3, ["CQ001"])], 2), ([("line", 3, [])], 1), ([("file", 0, [])], 0), ([("file", 0, ["CQ001"])], 1), ([("nextLine", 3, [])], 3)])
def test_suppressions(spark, suppressions, left):
    rows = spark.createDataFrame([("a", [(3, "CQ001"), (3, "CQ002"), (9, "CQ001")], suppressions)], "path string, findings array<struct<line:int,rule_id:string>>, suppressions array<struct<scope:string,line:int,rules:array<string>>>")
    assert len(rules.apply_suppressions(rows).first()["findings"]) == left
    flat = rows.select("path", F.inline("findings"))
    silent = rows.select("path", F.inline("suppressions"))
    assert rules.suppress_rows(flat, silent).count() == left


def test_gate(spark):
    score = spark.createDataFrame([("D", 0.3)], "grade string, debt_ratio double")
    fired = spark.createDataFrame([(["CQ001"],)], "rules array<string>")
    r = rollups.gate(score, fired, "C", 20, ("CQ001", "CQ002")).first()
    assert not r["passed"]
    assert len(r["reasons"]) == 3
    assert rollups.gate(score, fired, "D", 30, ("CQ002",)).first()["passed"]
    with pytest.raises(ValueError, match="grade"):
        rollups.gate(score, fired, "Z")


def test_thresholds():
    t, source = rules.merge_thresholds({"nesting": 4}, {"nesting": 5, "line_length": 100})
    assert (t.nesting, t.line_length, t.cyclomatic) == (4, 100, 10)
    assert (source["nesting"], source["line_length"], source["cyclomatic"]) == ("explicit", "project", "default")


def test_layout(spark):
    boxes = ranking.squarify([6.0, 3.0, 1.0], 0, 0, 10, 10)
    assert sum(w * h for _, _, w, h in boxes) == pytest.approx(100)
