"""What is computed once a row: plans of filtered lists, scores without findings, and the time that the top files take."""

from __future__ import annotations

import os
import time

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessera.functions.text import settled, trimmed, utf16_length
from tessera.operators import generic, rollups, rules
from tessera.plans import registry
from tessera.plans.analysis_queries import LIMITS, measured, scored


def test_filters_do_not_repeat_expressions(spark):
    df = spark.range(5).select(F.col("id"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("made"))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(df.where("made <> 'a1' AND made <> 'a2'")).count("concat(") > 1
    got = settled(df, "made").where("made <> 'a1' AND made <> 'a2'")
    assert plan(got).count("concat(") == 1
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(0, "a0"), (3, "a3"), (4, "a4")]
    odd = spark.createDataFrame([(1, None)], "`a.b` int, c string")
    assert settled(odd, "c").collect() == odd.collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_top_files_split_each_text_once(spark):
    filtered = scored(spark, SF).where("debt_minutes > 0")
    assert filtered._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    began = time.time()
    assert len(registry.QUERIES["hotspots"](spark, SF).collect()) == 5
    assert time.time() - began < 30


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_scores_of_texts_without_findings(spark):
    own = ["path", "debt_minutes", "debt_ratio", "score", "grade"]
    want = rollups.score_files(rules.evaluate(measured(spark, SF), LIMITS)).select(own)
    got = rollups.score_measured(measured(spark, SF), LIMITS).select(own)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_debt_is_that_of_all_findings(spark):
    function = "name:string,start_line:int,start_col:int,cyclomatic:int,cognitive:int,sloc:int,params:int,max_nesting:int,mi:double"
    schema = f"path string, tier int, lines int, sloc int, line_lengths array<int>, todos array<struct<line:int,col:int,text:string>>, indent_nesting struct<depth:int,line:int>, functions array<struct<{function}>>, classes array<struct<name:string,start_line:int,start_col:int,methods:int>>, has_syntax_errors boolean, blocks array<struct<start_line:int,end_line:int,tokens:int,partner_path:string,partner_line:int>>"
    heavy = [("f", 1, 0, 28, 40, 83, 12, 6, 8.0), ("g", 9, 0, 3, 3, 4, 1, 1, 5.0), ("h", 9, 0, 3, 3, 40, 1, 1, 15.0), ("i", 2, 0, 11, 16, 51, 8, 4, 20.0)]
    rows = [
        ("a", 1, 2301, 900, [10, 200] * 40, [(1, 2, "TODO")], (9, 3), heavy, [("C", 1, 0, 50), ("D", 2, 0, 35)], True, [(1, 60, 300, "b", 2), (70, 72, 100, "c", 0)]),
        ("b", 2, 1000, 10, [120, 121], [], (7, 2), None, None, None, None),
        ("c", 3, 5000, 10, [999], [], (7, 2), heavy, [], False, [(1, 60, 300, "b", 2)]),
        ("d", 2, 0, 0, [], None, None, [], [], None, []),
    ]
    df = spark.createDataFrame(rows, schema)
    want = {r["path"]: r["debt_minutes"] for r in rollups.score_files(rules.evaluate(df, rules.Thresholds(), "blocks")).collect()}
    got = {r["path"]: r["debt_minutes"] for r in rollups.score_measured(df, rules.Thresholds(), "blocks").collect()}
    assert got == want and want["a"] > 500 and want["c"] == 0


def test_trimming_and_lengths(spark):
    spaces = " \t\x0b\f\r ﻿     　"
    rows = [(f"{spaces}a b{spaces}", "a b"), (spaces, ""), ("", ""), ("x", "x"), (None, None), ("​z", "​z")]
    assert [r[0] for r in spark.createDataFrame(rows, "s string, t string").select(trimmed(F.col("s")) == F.col("t")).collect()] == [True, True, True, True, None, True]
    texts = ["abc", "", "é", "a\U0001f600b", "\U0001f600\U0001f600", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(utf16_length(F.col("s"))).collect()]
    assert got == [None if t is None else len(t.encode("utf-16-le")) // 2 for t in texts]


def test_tokens_of_joined_lines(spark):
    text = "a = 'x' # c\n\n// no\n  b(\"it's\", 1.5)\n'open\nclose'\n"
    files = spark.createDataFrame([("f", "tier2:prose", text), ("g", "tier2:prose", None)], "path string, language_key string, text string")
    bags = {r["path"]: (r["words"], r["sloc"]) for r in generic.token_bags(files).collect()}
    lists = {r["path"]: ([w["token"] for w in r["words"]], len({w["line"] for w in r["words"]})) for r in generic.token_lists(files).collect()}
    assert bags == lists and bags["g"] == ([], 0) and "1.5" in bags["f"][0]
