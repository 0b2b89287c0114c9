"""Lists, fixes, windows and structure in all languages over the driver tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from tessera.operators import generic, history, ranking, rewrites, rollups, routing, rules, structure
from tessera.plans.analysis_queries import FINDINGS_SQL, LIMITS, MARKERS, MART_SQL, file_mart, findings, measured
from tessera.plans.corpus import document_files, table
from tessera.plans.result_queries import EVENTS_SQL, STRUCTURE_FINDINGS_SQL, STRUCTURE_SQL, event_samples, structured
from tessera.plans.source_queries import split_ctes
from tessera.session import kept
from tessera.streaming import incremental

# --- structure in all languages ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Syntax:
    """How a language writes a function of two parameters, a loop, branches, a call and their ends."""

    head: str = "int {}(int a, int b) {{"
    loop: str = "while (a < b) {"
    both: str = "if (a > 1 && b > 1) {"
    more: str = "} else if (a > 2) {"
    rest: str = "} else {"
    plain: str = "if (a < 0) {"
    call: str = "step(a);"
    end: str = "}"
    done: str = "}"
    params: int = 2


_BARE = {"loop": "while a < b {", "both": "if a > 1 && b > 1 {", "more": "} else if a > 2 {", "plain": "if a < 0 {"}
SYNTAXES = {
    "c": Syntax(), "cpp": Syntax("int Box::{}(int a, int b) const {{"), "c_sharp": Syntax("public int {}(int a, int b)\n{{"), "dart": Syntax(), "go": Syntax("func (s *Box) {}(a, b int) int {{", **{**_BARE, "loop": "for a < b {"}),
    "java": Syntax("static int {}(int a, Map<K, V> b) throws E {{"), "javascript": Syntax("function {}(a, b = pair(1, 2)) {{"), "typescript": Syntax("export function {}(a: number, b?: string): number {{"), "tsx": Syntax("function {}(a: number, b: number): number {{"),
    "kotlin": Syntax("fun {}(a: Int, b: Int): Int {{"), "objc": Syntax("static int {}(int a, int b) {{"), "php": Syntax("function {}($a, $b) {{", "while ($a < $b) {", "if ($a > 1 && $b > 1) {", "} elseif ($a > 2) {", plain="if ($a < 0) {", call="step($a);"),
    "rescript": Syntax("let {} = (a, b) => {{", **_BARE),
    "rust": Syntax("fn {}(a: i32, b: &'a str) -> i32 {{", **_BARE), "scala": Syntax("def {}(a: Int, b: Int): Int = {{"), "solidity": Syntax("function {}(uint a, uint b) public returns (uint) {{"), "swift": Syntax("func {}(a: Int, _ b: Int) -> Int {{", **_BARE),
    "zig": Syntax("fn {}(a: i32, b: i32) i32 {{", both="if (a > 1 and b > 1) {"),
    "lua": Syntax("function {}(a, b)", "while a < b do", "if a > 1 and b > 1 then", "elseif a > 2 then", "else", "if a < 0 then", "step(a)", "end", "end"),
    "ruby": Syntax("def {}(a, b)", "while a < b", "if a > 1 && b > 1", "elsif a > 2", "else", "if a < 0", "step(a)", "end", "end"),
    "bash": Syntax("{}() {{", "while [ $a -lt $b ]; do", "if [ $a -gt 1 ] && [ $b -gt 1 ]; then", "elif [ $a -gt 2 ]; then", "else", "if [ $a -lt 0 ]; then", "step $a", "fi", "}", 0),
    "python": Syntax("def {}(a, b):", "while a < b:", "if a > 1 and b > 1:", "elif a > 2:", "else:", "if a < 0:", "step(a)", "", "", 2),
}
_LOOP_ENDS = {"bash": "done"}


def language_samples(spark, sf_dir):
    """For each document two functions in one of the languages: ``route`` has a loop with branches, ``settle`` branches in each other around a loop; k = 0 to 3 says how many."""
    names = sorted(SYNTAXES)
    parts = ("route", "settle", "loop", "both", "more", "rest", "plain", "call", "end", "leave", "done")
    pieces = {n: [s.head.format("route"), s.head.format("settle"), s.loop, s.both, s.more, s.rest, s.plain, s.call, s.end, _LOOP_ENDS.get(n, s.end), s.done] for n, s in SYNTAXES.items()}
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int")).alias("language_key"), (F.expr(f"doc_id div {len(names)}") % 4).cast("int").alias("k"))
    syntax = F.element_at(F.create_map(*(x for n in names for x in (F.lit(n), F.array(*map(F.lit, pieces[n]))))), F.col("language_key"))
    d = d.withColumn("s", syntax).select("doc_id", "language_key", "k", *(F.element_at("s", i + 1).alias(p) for i, p in enumerate(parts)))
    line = lambda level, text: F.concat(F.repeat(F.lit("    "), F.lit(level) if isinstance(level, int) else level), text, F.lit("\n"))
    c, k = F.col, F.col("k")
    route = [line(0, c("route")), line(1, c("loop")), line(2, c("both")), line(3, c("call")), F.repeat(F.concat(line(2, c("more")), line(3, c("call"))), k), line(2, c("rest")), line(3, c("call")), line(2, c("end")), line(1, c("leave")), line(0, c("done"))]
    levels = F.sequence(F.lit(1), k + 1)
    nested = F.array_join(F.transform(levels, lambda i: line(i, c("plain"))), "")
    closed = F.array_join(F.transform(F.reverse(levels), lambda i: line(i, c("end"))), "")
    settle = [line(0, c("settle")), nested, line(k + 2, c("loop")), line(k + 3, c("call")), line(k + 2, c("leave")), closed, line(0, c("done"))]
    return d.select(F.concat(F.lit("gen/"), c("doc_id").cast("string"), F.lit("."), "language_key").alias("path"), "language_key", F.concat(*route, *settle).alias("text"))


def language_structure(spark, sf_dir):
    measured = structure.measure_structure(language_samples(spark, sf_dir))
    functions = measured.select("path", "language_key", "parsed", F.size("ids").cast("boolean").alias("has_ids"), F.explode_outer("functions").alias("f"))
    return functions.select("path", "language_key", "parsed", "has_ids", "f.name", "f.kind", "f.params", "f.cyclomatic", "f.cognitive", "f.max_nesting")


LANGUAGES_SQL = f"""WITH d AS (SELECT doc_id, [{", ".join(f"'{n}'" for n in sorted(SYNTAXES))}][doc_id % {len(SYNTAXES)} + 1] AS l, ((doc_id // {len(SYNTAXES)}) % 4)::INT AS k FROM documents),
f AS (SELECT *, unnest(['route', 'settle']) AS name FROM d)
SELECT 'gen/' || doc_id || '.' || l AS path, l AS language_key, true AS parsed, true AS has_ids, name, 'function' AS kind, CASE l WHEN 'bash' THEN 0 ELSE 2 END AS params,
    CASE name WHEN 'route' THEN 4 + k ELSE 3 + k END AS cyclomatic, CASE name WHEN 'route' THEN 5 + k ELSE (k + 1) * (k + 2) // 2 + k + 2 END::INT AS cognitive, CASE name WHEN 'route' THEN 2 ELSE k + 2 END AS max_nesting FROM f"""


def structural_mart(spark, sf_dir):
    """The mart's columns that need functions."""
    return rollups.file_mart(structured(spark, sf_dir)).select("path", "tier", "max_cc", "max_cog", "n_major", "dup_lines", F.array_join("rules", ",").alias("rules"))


def lens_symbols(spark, sf_dir):
    """Functions with findings of files that have few enough to be shown in place."""
    files = structured(spark, sf_dir)
    found = rollups.explode_findings(files).where("symbol IS NOT NULL")
    return ranking.lens_symbols(found, 1).select("path", "symbol", "rule_id")


# --- lists ---------------------------------------------------------------------------------------------------------------


def visible_files(spark, sf_dir):
    """What a list shows with a filter and a collapsed folder. The mart is kept first, as a list is filtered again and again."""
    return kept(file_mart(spark, sf_dir)).where(routing.visible("grade:>=b en", ("src1", "src2"))).select("path", "grade")


def drawer_findings(spark, sf_dir):
    """Findings that a panel lists: informal ones only where they are open markers."""
    every = findings(spark, sf_dir).withColumn("severity", F.when(F.col("line") % 5 == 0, "info").otherwise(F.col("severity")))
    return every.where(ranking.shown_in_drawer()).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def sorted_files(spark, sf_dir):
    """The first files of the list for each metric."""
    mart, out = file_mart(spark, sf_dir), None
    for metric in ranking.METRICS:
        top = ranking.by_metric(mart, metric).limit(7).select(F.lit(metric).alias("metric"), "path", F.col(ranking.METRICS[metric]).cast("long").alias("value"))
        out = top if out is None else out.union(top)
    return out


def quick_fixes(spark, sf_dir):
    """What can be done about the findings of every third document, as if it were parsed."""
    files = measured(spark, sf_dir).withColumn("tier", F.when(F.element_at(F.split("path", "/"), -1).cast("long") % 3 == 0, 1).otherwise(2))
    found = rollups.explode_findings(rollups.score_files(rules.evaluate(files, LIMITS)), "language_key", "tier")
    return rewrites.fixes(found, generic.lines(document_files(spark, sf_dir)))


_MARKER = "(?i)\\b(?:TODO|FIXME|HACK|XXX)\\b\\s*:?\\s*"
FIXES_SQL = f"""{FINDINGS_SQL}, asked AS (SELECT DISTINCT path, line, rule_id FROM findings WHERE string_split(path, '/')[-1]::BIGINT % 3 = 0),
offered AS (SELECT a.path, a.line, a.rule_id, l.raw, a.path || ':' || a.line AS id FROM asked a JOIN lines l ON l.path = a.path AND l.line = a.line),
{split_ctes("SELECT DISTINCT id, raw AS line FROM offered WHERE rule_id = 'CQ010'")}
SELECT path, o.line, rule_id, 'split' AS kind, two AS replacement FROM offered o JOIN halves h ON h.id = o.id WHERE rule_id = 'CQ010' AND place IS NOT NULL
UNION ALL SELECT path, line, rule_id, 'remove marker', regexp_replace(raw, '{_MARKER}', '') FROM offered WHERE rule_id = 'CQ011'
UNION ALL SELECT path, line, rule_id, 'silence', regexp_extract(raw, '^\\s*') || '// tessera-disable-next-line ' || rule_id || chr(10) || raw FROM offered"""


# --- series and streams ----------------------------------------------------------------------------------------------------


def history_clear(spark, sf_dir):
    """Samples that have all values, of all series but one."""
    samples = event_samples(spark, sf_dir).withColumn("score", F.when(F.col("score") % 10 != 3, F.col("score")))
    return history.clear(history.clean(samples), 5).groupBy("key").agg(F.count(F.lit(1)).alias("samples"), F.sum("score").alias("score"))


def windowed_events(spark, sf_dir):
    """Events by type and hour, as a stream counts them."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.floor(F.col("value") * 100).cast("long").alias("value"))
    out = incremental.windowed_counts(events)
    return out.select(F.unix_micros("window.start").alias("start"), "event_type", "n", "value")


QUERIES = {
    "language_structure": (language_structure, LANGUAGES_SQL),
    "structural_mart": (structural_mart, f"""WITH {STRUCTURE_FINDINGS_SQL} SELECT g.path, 1 AS tier, any_value(1 + n) AS max_cc, any_value(n * (n + 1) // 2)::INT AS max_cog, count(rule_id)::INT AS n_major, 0 AS dup_lines,
        coalesce(string_agg(rule_id, ',' ORDER BY rule_id), '') AS rules FROM g LEFT JOIN found USING (path) GROUP BY g.path"""),
    "lens_symbols": (lens_symbols, f"WITH {STRUCTURE_FINDINGS_SQL} SELECT path, symbol, rule_id FROM found QUALIFY count(*) OVER (PARTITION BY path) <= 1"),
    "visible_files": (visible_files, f"WITH {MART_SQL} SELECT path, grade FROM mart WHERE grade >= 'B' AND contains(lower(path), 'en') AND string_split(path, '/')[1] NOT IN ('src1', 'src2')"),
    "drawer_findings": (drawer_findings, f"WITH {FINDINGS_SQL}, x AS (SELECT rule_id, CASE WHEN line % 5 = 0 THEN 'info' ELSE severity END AS severity FROM findings) SELECT rule_id, severity, count(*) AS n FROM x WHERE severity <> 'info' OR rule_id = 'CQ011' GROUP BY ALL"),
    "sorted_files": (sorted_files, f"""WITH {MART_SQL}, m AS (SELECT unnest(['debt', 'cyclomatic', 'cognitive', 'duplication']) AS metric, unnest([debt, 0, 0, 0]) AS value, path FROM mart)
        SELECT metric, path, value::BIGINT AS value FROM m QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, path) <= 7"""),
    "quick_fixes": (quick_fixes, f"WITH {FIXES_SQL}"),
    "history_clear": (history_clear, f"WITH {EVENTS_SQL} SELECT key, count(*) AS samples, sum(score)::BIGINT AS score FROM samples WHERE score % 10 <> 3 AND key <> 5 GROUP BY key"),
    "windowed_events": (windowed_events, "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start, event_type, count(*) AS n, sum(floor(value * 100)::BIGINT)::BIGINT AS value FROM events GROUP BY ALL"),
}
