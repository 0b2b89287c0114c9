"""Rules: measurements beyond a limit become findings with a severity and a cost in minutes."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: long lines that are reported one by one; the rest of a file's is one finding.
MOST_LINES = 20
# The order of severities, and the category of each rule's debt.
SEVERITIES = ("critical", "major", "minor", "info")
CATEGORIES = {
    "CQ001": "complexity", "CQ002": "complexity", "CQ005": "complexity", "CQ008": "complexity",
    "CQ003": "size", "CQ004": "size", "CQ006": "size", "CQ009": "size", "CQ007": "duplication",
    "CQ010": "style", "CQ011": "style", "CQ012": "style",
}
#: id, name, tiers in which it applies, what it says.
RULES = (
    ("CQ001", "Cyclomatic complexity", [1], "More independent paths than a test suite can cover with ease."),
    ("CQ002", "Cognitive complexity", [1], "Nested or tangled flow that a reader must hold in mind."),
    ("CQ003", "Function length", [1], "A function with more lines of code than one job needs."),
    ("CQ004", "Parameters", [1], "A function with so many parameters that calls go wrong."),
    ("CQ005", "Nesting", [1, 2], "Control flow nested deeper than it can be followed."),
    ("CQ006", "File length", [1, 2], "A file long enough to hold several responsibilities."),
    ("CQ007", "Duplication", [1, 2], "A block that stands elsewhere, too."),
    ("CQ008", "Maintainability", [1], "Size, complexity and vocabulary that together resist change."),
    ("CQ009", "Class size", [1], "A class with more methods than one responsibility needs."),
    ("CQ010", "Line length", [1, 2], "A line that must be scrolled to be read."),
    ("CQ011", "Open marker", [1, 2], "A marker of work left to do."),
    ("CQ012", "Syntax errors", [1], "Code that doesn't parse; other measurements may be incomplete."),
)


@dataclass(frozen=True)
class Thresholds:
    # The default limits.
    cyclomatic: int = 10
    cognitive: int = 15
    function_length: int = 50
    parameters: int = 7
    nesting: int = 3
    file_length: int = 1000
    duplication_tokens: int = 100
    maintainability_warning: int = 20
    maintainability_critical: int = 10
    class_methods: int = 35
    line_length: int = 120


def merge_thresholds(explicit: dict | None = None, project: dict | None = None) -> tuple[Thresholds, dict[str, str]]:
    """Limits by precedence explicit > project > default, and where each one comes from."""
    explicit, project, names = explicit or {}, project or {}, [f.name for f in fields(Thresholds)]
    values = {n: explicit.get(n, project.get(n)) for n in names}
    source = {n: "explicit" if n in explicit else "project" if n in project else "default" for n in names}
    return Thresholds(**{n: v for n, v in values.items() if v is not None}), source


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, CATEGORIES[r[0]]) for r in RULES], "rule_id string, name string, tiers array<int>, summary string, category string")


def category_of(rule: Column) -> Column:
    out = F.lit("style")
    for category in ("complexity", "size", "duplication"):
        out = F.when(rule.isin(*(r for r, c in CATEGORIES.items() if c == category)), category).otherwise(out)
    return out


def _severity(value: Column, limit: float) -> Column:
    return F.when(value >= 2 * limit, "critical").otherwise("major")


FINDING = "rule_id string, severity string, message string, line int, col int, end_line int, end_col int, value double, threshold double, debt_minutes long, symbol string"


def _finding(rule: str, severity: Column, message: Column, line: Column, debt: Column, value: Column | None = None, threshold: float | None = None, symbol: Column | None = None, col: Column | None = None, end_col: Column | None = None) -> Column:
    null = F.lit(None)
    col = F.lit(0) if col is None else col
    parts = {
        "rule_id": F.lit(rule), "severity": severity, "message": message, "line": line.cast("int"), "col": col.cast("int"), "end_line": line.cast("int"),
        "end_col": (col + 1 if end_col is None else end_col).cast("int"), "value": (null if value is None else value).cast("double"),
        "threshold": F.lit(threshold).cast("double"), "debt_minutes": debt.cast("long"), "symbol": (null if symbol is None else symbol).cast("string"),
    }
    return F.struct(*(c.alias(k) for k, c in parts.items()))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _over(f: Column, t: Thresholds) -> list[tuple]:
    """Rule, value, limit, minutes for what is over it, and name, of the five limits of a function."""
    return [
        ("CQ001", f["cyclomatic"], t.cyclomatic, lambda x: 10 + x, "cyclomatic complexity"),
        ("CQ002", f["cognitive"], t.cognitive, lambda x: 10 + x, "cognitive complexity"),
        ("CQ003", f["sloc"], t.function_length, lambda x: 20 + F.ceil(x / 5), "lines of code"),
        ("CQ004", f["params"], t.parameters, lambda x: 15 + 5 * x, "parameters"),
        ("CQ005", f["max_nesting"], t.nesting, lambda x: 10 * x, "levels of nesting"),
    ]


def _maintenance_debt(f: Column, t: Thresholds) -> Column:
    """Minutes for a function that is hard to maintain; null where it isn't, or is short."""
    return F.when((f["mi"] < t.maintainability_warning) & (f["sloc"] >= 5), F.when(f["mi"] < t.maintainability_critical, 30).otherwise(15))


def _class_debt(c: Column, t: Thresholds) -> Column:
    return 30 + 2 * (c["methods"] - t.class_methods)


def _nesting_debt(n: Column, t: Thresholds) -> Column:
    """Minutes for indentation in a file that no parser has seen; null within the limit."""
    return F.when((F.col("tier") == 2) & (n["depth"] > t.nesting), 10 * (n["depth"] - t.nesting))


def _length_debt(lines: Column, t: Thresholds) -> Column:
    return F.when(lines > t.file_length, 60 + F.ceil((lines - t.file_length) / 100) * 10)


def _block_debt(b: Column) -> Column:
    return 10 + F.floor((b["end_line"] - b["start_line"] + 1) / 5 + 0.5)


def total_debt(analysis: DataFrame, t: Thresholds = Thresholds(), blocks: str | None = None) -> Column:  # noqa: B008
    """The minutes of all findings that evaluate() would make of a row, without making them."""
    columns = set(analysis.columns)
    zero = F.lit(0).cast("long")
    total = lambda items, one: F.coalesce(F.aggregate(items, zero, lambda a, x: a + F.coalesce(one(x).cast("long"), zero)), zero)
    parts = [F.coalesce(_length_debt(F.col("lines"), t).cast("long"), zero), F.size(F.filter("line_lengths", lambda n: n > t.line_length)).cast("long")]
    if "functions" in columns:
        of_function = lambda f: reduce(Column.__add__, (F.when(v > limit, debt(v - limit).cast("long")).otherwise(zero) for _, v, limit, debt, _ in _over(f, t))) + F.coalesce(_maintenance_debt(f, t).cast("long"), zero)
        parts.append(total("functions", of_function))
    if "classes" in columns:
        parts.append(total("classes", lambda c: F.when(c["methods"] > t.class_methods, _class_debt(c, t))))
    if "indent_nesting" in columns:
        parts.append(F.coalesce(_nesting_debt(F.col("indent_nesting"), t).cast("long"), zero))
    if blocks:
        parts.append(total(blocks, _block_debt))
    return F.when(F.col("tier") == 3, zero).otherwise(reduce(Column.__add__, parts))


def function_findings(f: Column, t: Thresholds) -> Column:
    """Findings of one function (a struct of its metrics), as an array."""
    name, at = f["name"], dict(line=f["start_line"], symbol=f["name"], col=f["start_col"], end_col=f["start_col"] + F.greatest(F.lit(1), F.length(f["name"])))
    found = [F.when(v > limit, _finding(rule, _severity(v, limit), _text("'", name, "': ", v, f" {what}, limit {limit}"), debt=debt(v - limit), value=v, threshold=limit, **at)) for rule, v, limit, debt, what in _over(f, t)]
    low = f["mi"] < t.maintainability_critical
    debt = _maintenance_debt(f, t)
    found.append(F.when(debt.isNotNull(), _finding("CQ008", F.when(low, "critical").otherwise("major"), _text("'", name, "': maintainability index ", F.format_number(f["mi"], 1)), debt=debt, value=f["mi"], threshold=t.maintainability_warning, **at)))
    return F.array_compact(F.array(*found))


def evaluate(analysis: DataFrame, t: Thresholds = Thresholds(), blocks: str | None = None) -> DataFrame:  # noqa: B008
    """analysis with an array ``findings``: all rules in one pass over each row, in the order of line and rule.

    analysis has tier, lines, line_lengths, todos, indent_nesting, and, where a parser ran, functions, classes and
    has_syntax_errors. ``blocks`` names a column of duplicated blocks, if there is one. Skipped files have no findings.
    """
    columns = set(analysis.columns)
    empty = F.expr(f"cast(array() as array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>)")
    parts: list[Column] = []
    length = lambda i: F.coalesce(F.try_element_at("line_lengths", i + 1), F.lit(1))
    if "functions" in columns:
        parts.append(F.flatten(F.transform("functions", lambda f: function_findings(f, t))))
    if "classes" in columns:
        c_over = F.filter("classes", lambda c: c["methods"] > t.class_methods)
        parts.append(F.transform(c_over, lambda c: _finding("CQ009", _severity(c["methods"], t.class_methods), _text("'", c["name"], "': ", c["methods"], f" methods, limit {t.class_methods}"), c["start_line"], _class_debt(c, t), c["methods"], t.class_methods, c["name"], c["start_col"], c["start_col"] + F.length(c["name"]))))
    if "indent_nesting" in columns:
        n = F.col("indent_nesting")
        debt = _nesting_debt(n, t)
        parts.append(F.when(debt.isNotNull(), F.array(_finding("CQ005", _severity(n["depth"], t.nesting), _text("nesting of about ", n["depth"], f" by indentation, limit {t.nesting}"), n["line"], debt, n["depth"], t.nesting, end_col=length(n["line"])))))
    lines = F.col("lines")
    parts.append(F.when(lines > t.file_length, F.array(_finding("CQ006", _severity(lines, t.file_length), _text(lines, f" lines, limit {t.file_length}"), F.lit(0), _length_debt(lines, t), lines, t.file_length, end_col=length(F.lit(0))))))
    long = F.filter(F.transform("line_lengths", lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda x: x["n"] > t.line_length)
    one = lambda x: _finding("CQ010", F.lit("minor"), _text(x["n"], f" characters, limit {t.line_length}"), x["i"], F.lit(1), x["n"], t.line_length, col=F.lit(t.line_length), end_col=x["n"])
    parts.append(F.transform(F.slice(long, 1, MOST_LINES), one))
    rest = F.size(long) - MOST_LINES
    at = F.try_element_at(long, F.lit(MOST_LINES + 1))
    parts.append(F.when(rest > 0, F.array(_finding("CQ010", F.lit("minor"), _text(rest, f" more lines over {t.line_length} characters"), at["i"], rest, rest, t.line_length, end_col=at["n"]))))
    if "todos" in columns:
        parts.append(F.transform("todos", lambda x: _finding("CQ011", F.lit("info"), x["text"], x["line"], F.lit(0), col=x["col"], end_col=x["col"] + 4)))
    if "has_syntax_errors" in columns:
        parts.append(F.when(F.col("has_syntax_errors"), F.array(_finding("CQ012", F.lit("info"), F.lit("syntax errors; results may be incomplete"), F.lit(0), F.lit(0)))))
    if blocks:
        parts.append(F.transform(blocks, duplication_finding))
    every = F.concat(*(F.coalesce(p, empty) for p in parts))
    ordered = F.array_sort(every, lambda a, b: F.when((a["line"] < b["line"]) | ((a["line"] == b["line"]) & (a["rule_id"] < b["rule_id"])), -1).when((a["line"] == b["line"]) & (a["rule_id"] == b["rule_id"]), 0).otherwise(1))
    return analysis.withColumn("findings", F.when(F.col("tier") == 3, empty).otherwise(ordered))


def duplication_finding(b: Column) -> Column:
    """The finding for a duplicated block: a struct of start_line, end_line, tokens, partner_path and partner_line."""
    n = b["end_line"] - b["start_line"] + 1
    base = _finding("CQ007", F.when(n >= 50, "critical").otherwise("major"), _text(n, " lines also in ", b["partner_path"], " from line ", b["partner_line"] + 1), b["start_line"], _block_debt(b), n)
    return base.withField("end_line", b["end_line"].cast("int"))


def apply_suppressions(analysis: DataFrame) -> DataFrame:
    """findings without those that a suppression of the same file silences.

    A file-wide suppression silences its rules, or everything where it names none; others act on findings whose first
    line is theirs (or the next one).
    """
    hits = lambda f, s: ((s["scope"] == "file") | (f["line"] == s["line"] + F.when(s["scope"] == "nextLine", 1).otherwise(0))) & ((F.size(s["rules"]) == 0) | F.array_contains(s["rules"], f["rule_id"]))
    return analysis.withColumn("findings", F.filter("findings", lambda f: ~F.exists("suppressions", lambda s: hits(f, s))))


def suppress_rows(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """The same over tables: findings(path, line, rule_id, ...) without those that suppressions(path, scope, line, rules) silence, as an anti-join."""
    s = suppressions.select(F.col("path").alias("s_path"), "scope", F.when(F.col("scope") == "nextLine", F.col("line") + 1).otherwise(F.col("line")).alias("s_line"), "rules")
    same = (findings["path"] == s["s_path"]) & ((s["scope"] == "file") | (s["s_line"] == findings["line"])) & ((F.size(s["rules"]) == 0) | F.array_contains(s["rules"], findings["rule_id"]))
    return findings.join(s, same, "left_anti")
