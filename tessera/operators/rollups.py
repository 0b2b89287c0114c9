"""Scores of files, folders and the whole corpus, and the tables that reports show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import GRADE_ORDER, format_debt, score_columns
from tessera.functions.text import half_up, settled
from tessera.operators.languages import display_name
from tessera.operators.routing import counts_toward_score
from tessera.operators.rules import CATEGORIES, SEVERITIES, Thresholds, category_of, total_debt


def score_files(analysis: DataFrame) -> DataFrame:
    """analysis(findings, sloc) with debt_minutes, debt_ratio, score and grade. Findings are computed once a row, whatever filters follow."""
    analysis = settled(analysis, "findings")
    debt = F.aggregate("findings", F.lit(0).cast("long"), lambda a, f: a + f["debt_minutes"])
    return analysis.withColumn("debt_minutes", debt).withColumns(score_columns(F.col("debt_minutes"), F.col("sloc")))


def score_measured(analysis: DataFrame, t: Thresholds = Thresholds(), blocks: str | None = None) -> DataFrame:  # noqa: B008
    """The same scores from measurements alone, for lists and sums that show no findings: none are made. Without suppressions."""
    df = settled(analysis.withColumn("debt_minutes", total_debt(analysis, t, blocks)), "debt_minutes", "sloc")
    return df.withColumns(score_columns(F.col("debt_minutes"), F.col("sloc")))


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumns(score_columns(F.col("debt_minutes"), F.col("sloc")))


def corpus_score(files: DataFrame, include_partial: bool = True) -> DataFrame:
    """One row: summed debt and lines of the files that count, and the score of the sums."""
    sums = files.where(counts_toward_score(F.col("tier"), include_partial)).agg(F.coalesce(F.sum("debt_minutes"), F.lit(0)).alias("debt_minutes"), F.coalesce(F.sum("sloc"), F.lit(0)).alias("sloc"))
    return _scored(sums)


def folder_scores(files: DataFrame) -> DataFrame:
    """folder, debt_minutes, sloc and scores, for every folder on the way to a counted file."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = files.where(counts_toward_score(F.col("tier")) & (F.size(parts) > 1)).select(F.explode(above).alias("folder"), "debt_minutes", "sloc")
    return _scored(rows.groupBy("folder").agg(F.sum("debt_minutes").alias("debt_minutes"), F.sum("sloc").alias("sloc")))


def debt_by_category(findings: DataFrame) -> DataFrame:
    """One row with the summed debt of each category; findings(rule_id, debt_minutes)."""
    sums = [F.coalesce(F.sum(F.when(category_of(F.col("rule_id")) == c, F.col("debt_minutes"))), F.lit(0)).alias(c) for c in dict.fromkeys(CATEGORIES.values())]
    return findings.agg(*sums)


def hotspots(files: DataFrame, n: int = 5) -> DataFrame:
    """The n files with the most debt."""
    return files.where("debt_minutes > 0").orderBy(F.desc("debt_minutes"), "path").limit(n)


def explode_findings(files: DataFrame, *keep: str) -> DataFrame:
    # explode_outer: from explode, Catalyst infers filters on findings, and pushes the whole of its expression down with them
    return files.select("path", *keep, F.explode_outer("findings").alias("f")).where("f IS NOT NULL").select("path", *keep, "f.*")


def symbols(functions: DataFrame, findings: DataFrame) -> DataFrame:
    """functions(path, name, start_line, sloc, ...) with the debt of the findings on them, and their scores."""
    own = findings.where("symbol IS NOT NULL").groupBy("path", F.col("line").alias("start_line"), F.col("symbol").alias("name")).agg(F.sum("debt_minutes").alias("debt_minutes"), F.count(F.lit(1)).alias("n_findings"))
    joined = functions.join(own, ["path", "start_line", "name"], "left").fillna(0, ["debt_minutes", "n_findings"])
    return _scored(joined)


def file_mart(files: DataFrame) -> DataFrame:
    """path, lang, tier, grade, score, sloc, debt, max_cc, max_cog, dup_lines, a count for each severity, rules and the top finding's message."""
    functions = F.col("functions") if "functions" in files.columns else F.expr("cast(null as array<struct<cyclomatic:int,cognitive:int>>)")
    most = lambda k: F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform(functions, lambda f: f[k])), F.lit(0)))
    dup = F.filter("findings", lambda f: f["rule_id"] == "CQ007")
    top = F.element_at(F.array_sort(F.filter("findings", lambda f: f["debt_minutes"] > 0), lambda a, b: F.when(a["debt_minutes"] > b["debt_minutes"], -1).when(a["debt_minutes"] < b["debt_minutes"], 1).when(a["line"] < b["line"], -1).when(a["line"] > b["line"], 1).when(a["rule_id"] < b["rule_id"], -1).otherwise(1)), 1)
    of_severity = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s))
    has = F.exists("findings", lambda f: f["debt_minutes"] > 0)
    return files.select(
        "path", display_name(F.col("language_key")).alias("lang"), "tier", "grade", "score", "sloc", F.col("debt_minutes").alias("debt"),
        most("cyclomatic").alias("max_cc"), most("cognitive").alias("max_cog"),
        F.aggregate(dup, F.lit(0), lambda a, f: a + f["end_line"] - f["line"] + 1).alias("dup_lines"),
        *(of_severity(s).alias(f"n_{s}") for s in SEVERITIES),
        F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["rule_id"]))).alias("rules"), F.when(has, top["message"]).alias("top"),
    )


def corpus_summary(files: DataFrame, mart: DataFrame, include_partial: bool = True) -> DataFrame:
    """One row: score, grade, debt, files by tier, and duplicated lines in per cent of lines of code."""
    counted = counts_toward_score(F.col("tier"), include_partial)
    tiers = mart.agg(
        F.count(F.lit(1)).alias("files"), *(F.count_if(F.col("tier") == k).alias(n) for k, n in ((1, "tier1"), (2, "tier2"), (3, "skipped"))),
        F.coalesce(F.sum(F.when(counted, F.col("dup_lines"))), F.lit(0)).alias("dup"), F.coalesce(F.sum(F.when(counted, F.col("sloc"))), F.lit(0)).alias("of"),
    )
    both = corpus_score(files, include_partial).crossJoin(tiers)  # one row each
    pct = F.when(F.col("of") > 0, half_up(F.col("dup") / F.col("of") * 1000) / 10).otherwise(0.0)
    return both.withColumns({"debt_text": format_debt(F.col("debt_minutes")), "duplicated_pct": pct}).drop("dup", "of")


def fired_rules(findings: DataFrame) -> DataFrame:
    """One row: the rules that fired anywhere, in order."""
    return findings.agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))


def gate(score: DataFrame, fired: DataFrame, min_grade: str | None = None, max_debt_ratio: float | None = None, fail_on: tuple[str, ...] = ()) -> DataFrame:
    """One row: passed, and all reasons against. max_debt_ratio is in per cent of the ratio rounded to four places."""
    if min_grade is not None and min_grade not in GRADE_ORDER:
        raise ValueError(f"no such grade: {min_grade}")
    reasons: list[Column] = []
    both = score.crossJoin(fired)  # one row each
    if min_grade:
        reasons.append(F.when(F.instr(F.lit(GRADE_ORDER), F.col("grade")) > GRADE_ORDER.index(min_grade) + 1, F.concat(F.lit("grade "), "grade", F.lit(f" is below {min_grade}"))))
    if max_debt_ratio is not None:
        reasons.append(F.when(F.col("debt_ratio") * 100 > max_debt_ratio, F.concat(F.lit("debt ratio "), F.format_number(F.col("debt_ratio") * 100, 1), F.lit(f"% exceeds {max_debt_ratio:g}%"))))
    reasons += [F.when(F.array_contains("rules", r), F.lit(f"rule {r} fired")) for r in fail_on]
    found = F.array_compact(F.array(*reasons)) if reasons else F.expr("cast(array() as array<string>)")
    return both.select(found.alias("reasons")).withColumn("passed", F.size("reasons") == 0)


def detail(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of files with what their rule says; the rule table has one row for each rule."""
    return explode_findings(files).join(F.broadcast(rules.select("rule_id", "name", "summary", "category")), "rule_id").withColumn("debt_text", format_debt(F.col("debt_minutes")))
