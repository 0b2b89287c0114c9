"""Reports: JSON, SARIF, HTML, a table and diagnostics. Rows are shaped by Spark; a single document is put together on the
driver from an iterator over its rows, so the driver holds one row at a time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import escape
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import format_debt
from tessera.operators.ranking import TABLE_ROWS, squarify
from tessera.operators.rules import RULES

HTML_DETAILS = 50
# Colours of grades in reports, and a set that can be told apart without full colour vision.
GRADE_COLORS = {"A": "#2e9d6a", "B": "#7cb342", "C": "#d9a92e", "D": "#e07b35", "E": "#d14545"}
COLOR_BLIND = {"A": "#0072b2", "B": "#56b4e9", "C": "#f0e442", "D": "#e69f00", "E": "#d55e00"}
# Fixed value: characters that stay as they are in a path within a report, beside letters, digits and _.-~
URI_SAFE = "/;,?:@&=+$!*'()#"
_LEVELS = {"critical": "warning", "major": "warning", "minor": "note", "info": "note"}


def sarif_results(findings: DataFrame) -> DataFrame:
    """Findings as SARIF results: lines and columns from 1, the level, and the rule's place in the table."""
    level = F.element_at(F.create_map(*(F.lit(x) for kv in _LEVELS.items() for x in kv)), F.col("severity"))
    index = F.array_position(F.array(*(F.lit(r[0]) for r in RULES)), F.col("rule_id")).cast("int") - 1
    return findings.select(
        "path", "rule_id", "message", level.alias("level"), (F.col("line") + 1).alias("start_line"), (F.col("col") + 1).alias("start_column"), (F.col("end_line") + 1).alias("end_line"),
        (F.greatest("end_col", "col") + 1).alias("end_column"), index.alias("rule_index"),
    )


def diagnostics(findings: DataFrame) -> DataFrame:
    level = F.when(F.col("severity").isin("critical", "major"), "Warning").when(F.col("severity") == "minor", "Information").otherwise("Hint")
    return findings.withColumn("level", level)


def _camel(name: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in "".join(c if c.isalnum() else " " for c in name).split())


def write_sarif(findings: DataFrame, path: str, version: str) -> None:
    rules = [{"id": i, "name": _camel(n), "shortDescription": {"text": s}, "defaultConfiguration": {"level": "note" if i in ("CQ010", "CQ011", "CQ012") else "warning"}} for i, n, _, s in RULES]
    head = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"}
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(head)[:-1] + ', "runs": [{"tool": {"driver": ' + json.dumps({"name": "tessera", "version": version, "rules": rules}) + '}, "results": [')
        for n, r in enumerate(sarif_results(findings).orderBy("path", "start_line", "rule_id").toLocalIterator()):
            region = {"startLine": r["start_line"], "startColumn": r["start_column"], "endLine": r["end_line"], "endColumn": r["end_column"]}
            f.write((",\n" if n else "\n") + json.dumps({"ruleId": r["rule_id"], "ruleIndex": r["rule_index"], "level": r["level"], "message": {"text": r["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": quote(r["path"], safe=URI_SAFE), "uriBaseId": "SRCROOT"}, "region": region}}]}))
        f.write("\n]}]}\n")


def json_rows(files: DataFrame) -> DataFrame:
    """One JSON text for each file, lines counted from 1."""
    one = F.transform("findings", lambda f: F.struct(f["rule_id"].alias("ruleId"), f["severity"].alias("severity"), f["message"].alias("message"), (f["line"] + 1).alias("line"), f["debt_minutes"].alias("debtMinutes")))
    functions = [F.transform("functions", lambda f: F.struct(f["name"].alias("name"), (f["start_line"] + 1).alias("line"), f["cyclomatic"].alias("cyclomatic"), f["cognitive"].alias("cognitive"), f["mi"].alias("mi"))).alias("functions")] if "functions" in files.columns else []
    return files.select("path", F.to_json(F.struct("path", "tier", "grade", "score", "sloc", F.col("debt_minutes").alias("debtMinutes"), F.col("debt_ratio").alias("debtRatio"), one.alias("findings"), *functions)).alias("json"))


def write_json(files: DataFrame, summary: DataFrame, path: str, version: str) -> None:
    whole = summary.first().asDict(recursive=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write('{\n  "version": ' + json.dumps(version) + ',\n  "corpus": ' + json.dumps(whole) + ',\n  "files": [')
        for n, r in enumerate(json_rows(files).orderBy("path").toLocalIterator()):
            f.write((",\n    " if n else "\n    ") + r["json"])
        f.write("\n  ]\n}\n")


def table_rows(files: DataFrame, n: int = TABLE_ROWS) -> DataFrame:
    """The files with the most debt, partial ones marked."""
    name = F.when(F.col("tier") == 2, F.concat(F.lit("~"), "path")).otherwise(F.col("path"))
    return files.where("debt_minutes > 0 AND tier <> 3").orderBy(F.desc("debt_minutes"), "path").limit(n).select("grade", "score", format_debt(F.col("debt_minutes")).alias("debt"), name.alias("path"))


def summary_line(summary: DataFrame) -> str:
    r = summary.first()
    return f"grade {r['grade']} · score {r['score']} · debt {r['debt_text']} · {r['sloc']} lines of code · {r['files']} files ({r['tier2']} partial)"


def treemap(folders: list[tuple[str, int]], width: int = 960, height: int = 420) -> str:
    """SVG of folders by lines of code."""
    ordered = sorted(((n, s) for n, s in folders if s > 0), key=lambda x: (-x[1], x[0]))
    boxes = squarify([float(s) for _, s in ordered], 0, 0, width, height)
    rects = "".join(f'<rect x="{x:.1f}" y="{y:.1f}" width="{w:.1f}" height="{h:.1f}"><title>{escape(n)}: {s}</title></rect>' for (n, s), (x, y, w, h) in zip(ordered, boxes, strict=True))
    return f'<svg viewBox="0 0 {width} {height}" fill="#9bb" stroke="#fff">{rects}</svg>'


def _rows(df: DataFrame, *columns: str) -> Iterator[str]:
    for r in df.toLocalIterator():
        yield f"<tr class='{escape(str(r['grade']))}'>" + "".join(f"<td>{escape(str(r[c]))}</td>" for c in columns) + "</tr>"


def write_html(files: DataFrame, summary: DataFrame, categories: DataFrame, folders: DataFrame, path: str, colors: dict[str, str] = GRADE_COLORS) -> None:
    """A page without outside parts: summary, categories in per cent, folders, all files by debt, and findings of the worst."""
    ranked = files.where("tier <> 3").orderBy(F.desc("debt_minutes"), "path")
    c = categories.first().asDict()
    total = max(1, sum(c.values()))
    tops = [(r["folder"], r["sloc"]) for r in folders.where(~F.contains("folder", F.lit("/"))).orderBy(F.desc("sloc")).limit(200).collect()]
    with open(path, "w", encoding="utf-8") as f:
        style = "".join(f".{g}{{border-left:4px solid {c}}}" for g, c in colors.items())
        f.write(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Quality report</title><style>{style}</style></head><body><h1>{escape(summary_line(summary))}</h1><ul>")
        f.write("".join(f"<li>{k}: {int(100 * v / total + 0.5)}%</li>" for k, v in c.items()) + f"</ul>{treemap(tops)}<table>")
        for row in _rows(ranked.select("grade", "score", "sloc", format_debt(F.col("debt_minutes")).alias("debt"), "path"), "grade", "score", "sloc", "debt", "path"):
            f.write(row)
        f.write("</table>")
        for r in ranked.where("debt_minutes > 0").limit(HTML_DETAILS).select("path", "findings").toLocalIterator():
            f.write(f"<details><summary>{escape(r['path'])}</summary><ul>" + "".join(f"<li>{x['rule_id']} line {x['line'] + 1}: {escape(x['message'])}</li>" for x in r["findings"]) + "</ul></details>")
        f.write("</body></html>\n")

