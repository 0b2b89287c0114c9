from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring, text
from tessera.operators import generic, languages, rewrites, routing

FILE = "path string, language_key string, text string"


@pytest.mark.parametrize(("debt", "sloc", "grade", "score"), [(150, 100, "A", 90), (300, 100, "B", 80), (600, 100, "C", 60), (1500, 100, "D", 0), (0, 0, "A", 100), (1501, 100, "E", 0)])
def test_scores(spark, debt, sloc, grade, score):
    r = spark.createDataFrame([(debt, sloc)], "d long, s long").select(*(c.alias(k) for k, c in scoring.score_columns(F.col("d"), F.col("s")).items())).first()
    assert (r["grade"], r["score"]) == (grade, score)


@pytest.mark.parametrize(("ratio", "grade"), [(0.05, "A"), (0.0501, "B"), (0.1, "B"), (0.1001, "C"), (0.2, "C"), (0.2001, "D"), (0.5, "D"), (0.5001, "E")])
def test_grade_bounds(spark, ratio, grade):
    assert spark.range(1).select(scoring.grade_of(F.lit(ratio))).first()[0] == grade


@pytest.mark.parametrize(("minutes", "said"), [(45, "45 min"), (200, "3 h 20 min"), (1020, "2 d 1 h"), (60, "1 h"), (480, "1 d"), (0, "0 min")])
def test_format_debt(spark, minutes, said):
    assert spark.range(1).select(scoring.format_debt(F.lit(minutes))).first()[0] == said


def test_numbers_and_hashes(spark):
    r = spark.range(1).select(text.fnv1a(F.lit("foobar")), text.round2(F.lit(1.005)), text.half_up(F.lit(2.5)), text.utf16_length(F.lit("a\U0001f600")), text.indent_width(F.lit("\t  x"))).first()
    assert list(r) == [3214735720, 1.0, 3, 3, 6]


def test_generic_measurements(spark):
    code = "program x;\n\n// note TODO: later\nbegin\n  if a then\n    if b then\n      c;\n\tend;\nend. "
    r = generic.measure_generic(spark.createDataFrame([("a.pas", "tier2:pascal", code), ("b.pas", "tier2:pascal", None)], FILE)).orderBy("path").collect()
    assert (r[0]["lines"], r[0]["sloc"], r[0]["comment_lines"]) == (9, 7, 1)
    assert [(t["line"], t["col"], t["text"]) for t in r[0]["todos"]] == [(2, 8, "TODO later")]
    assert (r[0]["indent_nesting"]["depth"], r[0]["indent_nesting"]["line"]) == (2, 6)
    assert (r[1]["lines"], r[1]["sloc"], r[1]["todos"]) == (1, 0, [])


def test_directives(spark):
    lines = ["// tessera-disable CQ001, cq002 because", "// tessera-disable-next-line", "// Tessera-Disable-File CQ010", "// tessera-disable-line CQ003", "// nothing"]
    r = generic.measure_generic(spark.createDataFrame([("a", "tier2:d", "\n".join(lines))], FILE)).first()["suppressions"]
    assert [(s["scope"], s["line"], s["rules"]) for s in r] == [("line", 0, ["CQ001", "CQ002"]), ("nextLine", 1, []), ("file", 2, ["CQ010"]), ("line", 3, ["CQ003"])]


def test_routing(spark):
    rows = [("a.min.js", "javascript", "x"), ("b.c", "c", "/* auto-generated */"), ("c.c", "c", "var a=1;" * 1000), ("d.py", "python", "x=1"), ("e.c", "c", "int x;"), ("f.ml", "ocaml", "let x = 1")]
    got = {r["path"]: (r["tier"], r["skip_reason"]) for r in routing.route(spark.createDataFrame(rows, FILE)).collect()}
    assert got == {"a.min.js": (3, "generated"), "b.c": (3, "generated"), "c.c": (3, "minified"), "d.py": (1, None), "e.c": (1, None), "f.ml": (2, None)}


def test_languages(spark):
    paths = {"x/Makefile": "tier2:makefile", "a.PY": "python", "a.ipynb": "notebook:python", "a.json": None, "noext": None, "a.zig": "zig", "a.h": "c", "b.foo": "tier2:foo"}
    got = {r["path"]: r["k"] for r in spark.createDataFrame([(p,) for p in paths], "path string").select("path", languages.detect_language(F.col("path"), (".FOO",)).alias("k")).collect()}
    assert got == paths
    assert languages.comment_text("ocaml", "x") == "(* x *)"


def test_filter_language(spark):
    mart = spark.createDataFrame([("src/a.py", "D", 1, ["CQ001"]), ("lib/B.pas", "A", 2, [])], "path string, grade string, tier int, rules array<string>")
    count = lambda q: mart.where(routing.matches(q)).count()
    assert [count(q) for q in ("", "grade:d", "grade:>=b", "grade:>=a", "rule:cq001", "partial:yes", "partial:no", "LIB/b", "grade:z", "src grade:d")] == [2, 1, 1, 2, 1, 1, 1, 1, 0, 1]


def test_globs_and_ignores(spark):
    assert text.glob_regex("**/*.{js,ts}") == r"^(?:.*[^/]*\.(js|ts))$"
    paths = ["a/b.log", "build/x.c", "src/build/x.c", "docs/a.md", "keep.log"]
    r = routing.ignore_regexes("*.log\n/build/\n!keep.log\n")
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [x[0] for x in df.where(~routing.excluded(F.col("path"), ("docs",), ignored=r)).collect()] == ["src/build/x.c"]


def test_rewrites(spark):
    lines = {
        '    foo(aaaaaaa, "x, y", bbbbbbbbb)': 16, "a, b, c, d, e, f, g, h, i, j": None, 'foo("aaaaaaaaaaaaaaaa, bbbbbbbbbbbbbbbbb)': None, "foo(aaaaaaaaaa, bbbbbbbbbb, `open": None, "foo(aaaaaaaaaa, bbbbbbbbbb # x, y)": 15, "foo(aaaaaaaaaa, 'it\\'s, so', bbbbbbbbbb)": 15,
        "foo(a / b, [cccc, dddd], eeeeeee, f)": 24, "// foo(aaaaaaaaaa, bbbbbbbbbbbb)": None, "foo(a, bbbbbbbbbbbbbbbbbbbbbbbb)": None, "": None, None: None, "(" + "x" * 20 + ",," + "y" * 20 + ")": 22, "a" * 30 + "\\": None, "(é😀aaaaaaaaaa, bbbbbbbbb)": 14,
    }
    got = spark.createDataFrame([(x,) for x in lines], "l string").select("l", rewrites.split_point(F.col("l")).alias("at"))
    assert {r["l"]: r["at"] for r in got.collect()} == lines
    line = 'x = foo(aaaaaaaaa, bbbbbbbbb)  # todo: fix'
    r = spark.createDataFrame([(line,)], "l string").select(rewrites.remove_marker(F.col("l")), rewrites.split_long_line(F.col("l")), rewrites.suppression_comment(F.lit("  x"), F.lit("CQ010"), "lua")).first()
    assert list(r) == ["x = foo(aaaaaaaaa, bbbbbbbbb)  # fix", "x = foo(aaaaaaaaa,\n  bbbbbbbbb)  # todo: fix", "  -- tessera-disable-next-line CQ010"]
