"""Text measurements, rules, scores and roll-ups over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scoring import format_debt, maintainability_index, score_columns
from tessera.functions.text import fnv1a, marker_of, round2, settled
from tessera.operators import generic, ranking, rollups, routing, rules
from tessera.plans.corpus import FILES_SQL, LINES_SQL, TOKENS_SQL, document_files, table

#: Limits under which prose has findings of all sizes.
LIMITS = rules.Thresholds(line_length=80, file_length=8)
MARKERS = ("License", "Licensed", "Copyright")
#: What words and numbers begin with; other tokens are operators.
OPERAND_STARTS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$"


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generic.measure_generic(document_files(spark, sf_dir), MARKERS).withColumn("tier", F.lit(2))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.score_files(rules.evaluate(measured(spark, sf_dir), LIMITS))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without findings, for lists and sums of scores."""
    return rollups.score_measured(measured(spark, sf_dir), LIMITS)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.explode_findings(scored(spark, sf_dir))


def light_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from lines alone: debt of long lines and of long files, without building findings."""
    df = document_files(spark, sf_dir).withColumn("__l", F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1))
    t = F.transform("__l", lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    n, long = F.size("__l"), F.size(F.filter("__l", lambda x: F.length(x) > LIMITS.line_length))
    over = F.when(n > LIMITS.file_length, 60 + F.ceil((n - LIMITS.file_length) / 100) * 10).otherwise(0)
    df = df.select("path", "lang", n.alias("lines"), F.size(F.filter(t, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("#"))).alias("sloc"), (long + over).cast("long").alias("debt_minutes"))
    return df.withColumns(score_columns(F.col("debt_minutes"), F.col("sloc")))


MEASURE_SQL = LINES_SQL + """, measure AS (SELECT path, any_value(lang) AS lang, count(*)::BIGINT AS lines, count(*) FILTER (t <> '' AND NOT starts_with(t, '//') AND NOT starts_with(t, '#'))::BIGINT AS sloc,
    count(*) FILTER (starts_with(t, '//') OR starts_with(t, '#'))::BIGINT AS comment_lines, max(length(raw))::BIGINT AS longest FROM lines GROUP BY path)"""
FINDINGS_SQL = MEASURE_SQL + f""", long AS (SELECT path, line, length(raw) AS n, row_number() OVER (PARTITION BY path ORDER BY line) AS k, count(*) OVER (PARTITION BY path) AS c FROM lines WHERE length(raw) > {LIMITS.line_length}),
findings AS (
    SELECT path, 'CQ006' AS rule_id, CASE WHEN lines >= 2 * {LIMITS.file_length} THEN 'critical' ELSE 'major' END AS severity, 0 AS line, lines::DOUBLE AS value, (60 + ceil((lines - {LIMITS.file_length}) / 100) * 10)::BIGINT AS debt_minutes FROM measure WHERE lines > {LIMITS.file_length}
    UNION ALL SELECT path, 'CQ010', 'minor', line, n, 1 FROM long WHERE k <= {rules.MOST_LINES}
    UNION ALL SELECT path, 'CQ010', 'minor', line, c - {rules.MOST_LINES}, c - {rules.MOST_LINES} FROM long WHERE k = {rules.MOST_LINES + 1}
    UNION ALL SELECT path, 'CQ011', 'info', line, NULL, 0 FROM lines WHERE t <> '' AND regexp_matches(raw, '\\b({"|".join(MARKERS)})\\b'))"""
_GRADE = "CASE WHEN ratio <= 0.05 THEN 'A' WHEN ratio <= 0.1 THEN 'B' WHEN ratio <= 0.2 THEN 'C' WHEN ratio <= 0.5 THEN 'D' ELSE 'E' END"
_SCORE = "(floor(greatest(0, 1 - ratio / 0.5) * 100 + 0.5))::INT"
_RATIO = "CASE WHEN sloc > 0 THEN debt_minutes / (sloc * 30) ELSE 0 END"
SCORES_SQL = FINDINGS_SQL + f""", debts AS (SELECT m.path, any_value(lang) AS lang, any_value(lines) AS lines, any_value(sloc) AS sloc, coalesce(sum(debt_minutes), 0)::BIGINT AS debt_minutes FROM measure m LEFT JOIN findings USING (path) GROUP BY m.path),
ratios AS (SELECT *, {_RATIO} AS ratio FROM debts),
scores AS (SELECT path, lang, lines, sloc, debt_minutes, floor(ratio * 10000 + 0.5) / 10000 AS debt_ratio, {_SCORE} AS score, {_GRADE} AS grade FROM ratios)"""


def scored_sums(sums: str) -> str:
    """SQL that scores the rows of a query with debt_minutes and sloc."""
    return f"SELECT * EXCLUDE (ratio), floor(ratio * 10000 + 0.5) / 10000 AS debt_ratio, {_SCORE} AS score, {_GRADE} AS grade FROM (SELECT *, {_RATIO} AS ratio FROM ({sums}))"


_CATEGORY = "CASE WHEN rule_id IN ('CQ001', 'CQ002', 'CQ005', 'CQ008') THEN 'complexity' WHEN rule_id IN ('CQ003', 'CQ004', 'CQ006', 'CQ009') THEN 'size' WHEN rule_id = 'CQ007' THEN 'duplication' ELSE 'style' END"


def line_stats(spark, sf_dir):
    return measured(spark, sf_dir).select("path", "lines", "sloc", "comment_lines", F.array_max("line_lengths").alias("longest"))


def grade_by_language(spark, sf_dir):
    """Files, lines, code lines and debt by language and grade: one pass and one small shuffle."""
    return light_scored(spark, sf_dir).groupBy("lang", "grade").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("sloc").alias("sloc"), F.sum("debt_minutes").alias("debt_minutes"))


def marker_extract(spark, sf_dir):
    return generic.lines(document_files(spark, sf_dir)).withColumn("marker", marker_of(F.col("raw"), MARKERS)).where("marker IS NOT NULL").select("path", "line", "marker")


def todo_rows(spark, sf_dir):
    return measured(spark, sf_dir).select("path", F.explode_outer("todos").alias("x")).where("x IS NOT NULL").select("path", "x.*")


def token_counts(spark, sf_dir):
    """A file is a row, so its tokens are counted in the row: nothing is shuffled."""
    bags = generic.token_bags(document_files(spark, sf_dir)).where(F.size("words") > 0)
    return bags.select("path", F.size("words").cast("long").alias("tokens"), F.size(F.array_distinct("words")).cast("long").alias("distinct_tokens"))


def fnv_token_ids(spark, sf_dir):
    """Each distinct token once with its hash: the vocabulary is hashed, not the text."""
    return generic.tokens(document_files(spark, sf_dir)).groupBy("token").agg(F.count(F.lit(1)).alias("uses")).withColumn("token_id", fnv1a(F.col("token")))


def vocabulary_halstead(spark, sf_dir):
    """Volume, difficulty, effort and maintainability of each document, words and numbers being operands."""
    bags = generic.token_bags(document_files(spark, sf_dir)).where(F.size("words") > 0)
    operand = lambda t: F.contains(F.lit(OPERAND_STARTS), F.left(t, F.lit(1)))
    long = lambda c: c.cast("long")
    t = settled(bags.select("path", F.size("words").alias("total"), F.size(F.filter("words", operand)).alias("operands"), F.array_distinct("words").alias("kinds"), "sloc"), "total", "operands", "kinds", "sloc")
    h = settled(t.select("path", long(F.size("kinds")).alias("k"), long(F.size(F.filter("kinds", operand))).alias("distinct_operands"), long(F.col("total")).alias("n"), long(F.col("operands")).alias("total_operands"), "sloc"), "k", "distinct_operands", "n", "total_operands", "sloc")
    h = h.select("path", (F.col("k") - F.col("distinct_operands")).alias("distinct_operators"), "distinct_operands", (F.col("n") - F.col("total_operands")).alias("total_operators"), "total_operands", "sloc")
    n = F.col("distinct_operators") + F.col("distinct_operands")
    volume = F.when(n > 1, (F.col("total_operators") + F.col("total_operands")) * F.log2(n)).otherwise(F.lit(0.0))
    difficulty = F.when(F.col("distinct_operands") > 0, F.col("distinct_operators") / 2 * F.col("total_operands") / F.col("distinct_operands")).otherwise(F.lit(0.0))
    h = h.withColumns({"v": volume, "d": difficulty}).withColumns({"volume": round2(F.col("v")), "difficulty": round2(F.col("d")), "effort": round2(F.col("v") * F.col("d"))})
    return h.withColumn("mi", round2(maintainability_index(F.col("volume"), F.lit(1), F.col("sloc")))).drop("v", "d")


HALSTEAD_SQL = "WITH " + TOKENS_SQL + """, k AS (SELECT *, regexp_matches(token, '^[A-Za-z0-9_$]') AS operand FROM tokens),
h AS (SELECT path, count(DISTINCT token) FILTER (NOT operand) AS distinct_operators, count(DISTINCT token) FILTER (operand) AS distinct_operands, count(*) FILTER (NOT operand) AS total_operators, count(*) FILTER (operand) AS total_operands, count(DISTINCT line) AS sloc FROM k GROUP BY path),
v AS (SELECT *, CASE WHEN distinct_operators + distinct_operands > 1 THEN (total_operators + total_operands) * log2(distinct_operators + distinct_operands) ELSE 0 END AS v, CASE WHEN distinct_operands > 0 THEN distinct_operators / 2 * total_operands / distinct_operands ELSE 0 END AS d FROM h),
r AS (SELECT * EXCLUDE (v, d), floor(v * 100 + 0.5) / 100 AS volume, floor(d * 100 + 0.5) / 100 AS difficulty, floor(v * d * 100 + 0.5) / 100 AS effort FROM v)
SELECT *, floor((CASE WHEN volume <= 0 THEN 100 ELSE greatest(0, least(100, (171 - 5.2 * ln(volume) - 0.23 - 16.2 * ln(sloc)) * 100 / 171)) END) * 100 + 0.5) / 100 AS mi FROM r"""


def tier_routing(spark, sf_dir):
    """Tier and reason of each document, one in seven given a generated name and one in eleven the name of a parsed language."""
    files = document_files(spark, sf_dir)
    k = F.element_at(F.split("path", "/"), -1).cast("long")
    named = files.withColumn("path", F.when(k % 7 == 0, F.concat("path", F.lit(".min.js"))).when(k % 11 == 0, F.concat("path", F.lit(".py"))).otherwise(F.concat("path", F.lit(".pas"))))
    routed = routing.route(routing.with_language(named.drop("language_key")))
    return routed.select("path", "language_key", "tier", "skip_reason", routing.counts_toward_score(F.col("tier")).alias("counts"))


TIER_SQL = "WITH " + FILES_SQL + """, n AS (SELECT string_split(path, '/')[-1]::BIGINT AS k, path, text FROM files),
f AS (SELECT CASE WHEN k % 7 = 0 THEN path || '.min.js' WHEN k % 11 = 0 THEN path || '.py' ELSE path || '.pas' END AS path, CASE WHEN k % 7 = 0 THEN 'javascript' WHEN k % 11 = 0 THEN 'python' ELSE 'tier2:pascal' END AS language_key, text, string_split(text, chr(10)) AS l FROM n),
r AS (SELECT path, language_key, CASE WHEN path LIKE '%.min.js' THEN 'generated' WHEN regexp_matches(array_to_string(l[1:5], chr(10)), '(?i)auto-?generated|do not edit|@generated|generated by') THEN 'generated'
    WHEN length(text) >= 2000 AND (length(text) / len(l) > 500 OR list_max(list_transform(l, lambda x: length(x))) > 5000) THEN 'minified' END AS skip_reason FROM f),
t AS (SELECT *, CASE WHEN skip_reason IS NOT NULL THEN 3 WHEN language_key = 'python' THEN 1 ELSE 2 END AS tier FROM r) SELECT *, tier <> 3 AS counts FROM t"""


def rule_findings(spark, sf_dir):
    return findings(spark, sf_dir).select("path", "rule_id", "severity", "line", "value", "debt_minutes")


def long_lines_topk(spark, sf_dir):
    return findings(spark, sf_dir).where("rule_id = 'CQ010'").groupBy("path").agg(F.count(F.lit(1)).alias("findings"), F.sum("debt_minutes").alias("debt_minutes"), F.max("line").alias("last_line"))


def findings_suppressed(spark, sf_dir):
    """Findings left after suppressions by label: toxic documents silence all rules, poor ones CQ010."""
    files = document_files(spark, sf_dir).withColumn("doc_id", F.element_at(F.split("path", "/"), -1).cast("long"))
    labels = table(spark, sf_dir, "labels").where("toxic = 1 OR quality = 0")
    silent = files.select("path", "doc_id").join(labels, "doc_id").select("path", F.lit("file").alias("scope"), F.lit(0).alias("line"), F.when(F.col("toxic") == 1, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("CQ010"))).alias("rules"))
    return rules.suppress_rows(findings(spark, sf_dir), silent).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.sum("debt_minutes").alias("debt_minutes"))


def file_scores(spark, sf_dir):
    return scores(spark, sf_dir).select("path", "lang", "lines", "sloc", "debt_minutes", "debt_ratio", "score", "grade")


def folder_rollup(spark, sf_dir):
    return rollups.folder_scores(scores(spark, sf_dir))


def corpus_score(spark, sf_dir):
    return rollups.corpus_score(scores(spark, sf_dir)).withColumn("debt_text", format_debt(F.col("debt_minutes")))


def debt_by_category(spark, sf_dir):
    return rollups.debt_by_category(findings(spark, sf_dir))


def hotspots(spark, sf_dir):
    return rollups.hotspots(scores(spark, sf_dir)).select("path", "debt_minutes", "grade")


def file_mart(spark, sf_dir):
    return rollups.file_mart(scored(spark, sf_dir))


def mart_rows(spark, sf_dir):
    return file_mart(spark, sf_dir).select("path", "lang", "tier", "grade", "score", "sloc", "debt", "n_critical", "n_major", "n_minor", "n_info", F.array_join("rules", ",").alias("rules"))


MART_SQL = SCORES_SQL + """, mart AS (SELECT s.path, 'PROSE' AS lang, 2 AS tier, any_value(grade) AS grade, any_value(score) AS score, any_value(sloc) AS sloc, any_value(s.debt_minutes) AS debt,
    count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'major') AS n_major, count(*) FILTER (severity = 'minor') AS n_minor, count(*) FILTER (severity = 'info') AS n_info,
    coalesce(string_agg(DISTINCT rule_id, ',' ORDER BY rule_id), '') AS rules FROM scores s LEFT JOIN findings f USING (path) GROUP BY s.path)"""


def corpus_summary(spark, sf_dir):
    files = scored(spark, sf_dir)
    return rollups.corpus_summary(files, rollups.file_mart(files))


def gate_reasons(spark, sf_dir):
    files = scored(spark, sf_dir)
    found = rollups.gate(rollups.corpus_score(files), rollups.fired_rules(rollups.explode_findings(files)), "A", 5.0, ("CQ006", "CQ001"))
    return found.select("passed", F.array_join("reasons", "; ").alias("reasons"))


def filter_language(spark, sf_dir):
    """Files per filter of the interactive language."""
    mart = file_mart(spark, sf_dir)
    queries = ("", "grade:>=c", "grade:a", "rule:cq006", "partial:yes", "partial:no", "src1 grade:>=d", "en/")
    return mart.agg(*(F.count_if(routing.matches(q)).alias(f"q{i}") for i, q in enumerate(queries)))


def top_folder_counts(spark, sf_dir):
    return ranking.top_folders(file_mart(spark, sf_dir))


def navigation(spark, sf_dir):
    return ranking.navigation(file_mart(spark, sf_dir).withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")), "folder")


def issues_by_rule(spark, sf_dir):
    return ranking.issues_by_rule(findings(spark, sf_dir))


def issues_by_file(spark, sf_dir):
    return ranking.issues_by_file(findings(spark, sf_dir)).select("path", "file_debt", "rule_id", "severity", "line")


def panel_findings(spark, sf_dir):
    return ranking.panel_findings(findings(spark, sf_dir), 3).select("path", "rule_id", "line", "rank")


def worst_line(spark, sf_dir):
    return ranking.worst_line(findings(spark, sf_dir))


def log_height(spark, sf_dir):
    files = light_scored(spark, sf_dir)
    most = files.agg(F.max("debt_minutes").alias("most"))
    return files.crossJoin(F.broadcast(most)).select("path", ranking.log_height(F.col("debt_minutes"), F.col("most")).alias("height"))  # one row


def layout_floors(spark, sf_dir):
    """Place and size of every file; files lie in two depths, so the larger one is split by folder."""
    mart = scores(spark, sf_dir).select(F.regexp_replace("path", "^src1", "src1/deep/er").alias("path"), "sloc", F.col("debt_minutes").alias("debt"))
    placed = ranking.place_blocks(ranking.tiers(mart))
    return placed.select("path", "floor", "tier", "row", "column", *(F.round(c, 7).alias(c) for c in ("side", "x", "z", "width", "height")))


LAYOUT_SQL = SCORES_SQL + """, f AS (SELECT regexp_replace(path, '^src1', 'src1/deep/er') AS path, sloc, debt_minutes AS debt FROM scores),
t AS (SELECT *, least(dense_rank() OVER (ORDER BY len(string_split(path, '/'))) - 1, 5) AS tier, len(string_split(path, '/')) - 1 AS depth, regexp_replace(path, '/[^/]*$', '') AS folder FROM f),
c AS (SELECT tier, count(*) AS n, count(DISTINCT folder) AS k FROM t GROUP BY tier),
s AS (SELECT tier FROM c WHERE k > 1 AND (SELECT count(*) FROM c) < 3 ORDER BY n DESC, tier LIMIT 1),
o AS (SELECT *, CASE WHEN tier IN (SELECT tier FROM s) THEN folder ELSE '' END AS own FROM t),
fl AS (SELECT tier, own, min(depth) AS depth, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, tier, own) - 1)::INT AS floor FROM o GROUP BY tier, own),
b AS (SELECT greatest(ceil(sqrt(n)), ceil(n / ceil(sqrt(n)))) + 1.1::DOUBLE AS base FROM fl WHERE floor = 0),
p AS (SELECT base, least(least(2.2, greatest(0.85, base * 0.105)), 0.5 * base / (SELECT count(*) FROM fl)) AS pitch FROM b),
h AS (SELECT base, greatest(0.14, pitch - least(0.26, pitch * 0.26) - 0.14 * pitch) AS tall, (SELECT greatest(1, max(sloc)) FROM f) AS wide, (SELECT greatest(0, max(debt)) FROM f) AS most FROM p),
q AS (SELECT path, sloc, debt, floor, n, CASE WHEN own <> '' THEN own ELSE 'depth ' || fl.depth END AS name, row_number() OVER (PARTITION BY floor ORDER BY path) - 1 AS k, ceil(sqrt(n))::BIGINT AS cols FROM o JOIN fl USING (tier, own)),
r AS (SELECT *, k // cols AS row, CASE WHEN (k // cols) % 2 = 0 THEN k % cols ELSE cols - 1 - k % cols END AS col, ceil(n / cols) AS rows, greatest(1.8, base * pow(0.74, floor)) AS side FROM q, h),
w AS (SELECT *, greatest(0.3, least(1.35, (side - 1.1) / greatest(cols, rows))) AS fit FROM r),
z AS (SELECT *, (0.62 + 0.34 * sqrt(sloc / wide)) * fit AS width, 0.07 + (tall - 0.07) * CASE WHEN most <= 0 THEN 0.55 WHEN debt <= 0 THEN 0 ELSE ln(1 + debt) / ln(1 + most) END AS up FROM w)
SELECT path, floor, name AS tier, row::INT AS row, col::INT AS "column", round(side, 7) AS side, round((col - (cols - 1) / 2) * fit, 7) AS x, round((row - (rows - 1) / 2) * fit, 7) AS z, round(width, 7) AS width, round(least(up, width * 1.6), 7) AS height FROM z"""


def worst_files(spark, sf_dir):
    return ranking.worst_file(file_mart(spark, sf_dir)).select("path", "debt", "grade")


def severity_share(spark, sf_dir):
    counts = findings(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("severity", "n", ranking.share_percent(F.col("n"), F.col("total")).alias("percent"))  # one row


def finding_details(spark, sf_dir):
    return rollups.detail(scored(spark, sf_dir), rules.rule_table(spark)).select("path", "rule_id", "line", "name", "category", "debt_text")


_NAMES = " ".join(f"WHEN '{r[0]}' THEN '{r[1]}'" for r in rules.RULES)
_DEBT_TEXT = "CASE WHEN m < 60 THEN m || ' min' WHEN m // 60 < 8 THEN (m // 60) || ' h' || CASE WHEN m % 60 > 0 THEN ' ' || (m % 60) || ' min' ELSE '' END ELSE (m // 480) || ' d' || CASE WHEN (m // 60) % 8 > 0 THEN ' ' || ((m // 60) % 8) || ' h' ELSE '' END END"

QUERIES = {
    "line_stats": (line_stats, f"WITH {MEASURE_SQL} SELECT path, lines, sloc, comment_lines, longest FROM measure"),
    "grade_by_language": (grade_by_language, f"WITH {SCORES_SQL} SELECT lang, grade, count(*) AS files, sum(lines)::BIGINT AS lines, sum(sloc)::BIGINT AS sloc, sum(debt_minutes)::BIGINT AS debt_minutes FROM scores GROUP BY ALL"),
    "marker_extract": (marker_extract, f"WITH {LINES_SQL} SELECT path, line, left(trim(regexp_extract(raw, '\\b({'|'.join(MARKERS)})\\b[:\\s-]*(.*)', 1) || ' ' || regexp_extract(raw, '\\b({'|'.join(MARKERS)})\\b[:\\s-]*(.*)', 2)), 120) AS marker FROM lines WHERE regexp_matches(raw, '\\b({'|'.join(MARKERS)})\\b')"),
    "todo_rows": (todo_rows, f"WITH {LINES_SQL} SELECT path, line, length(regexp_extract(raw, '^(.*?)\\b({'|'.join(MARKERS)})\\b', 1))::INT AS col, left(trim(regexp_extract(raw, '\\b({'|'.join(MARKERS)})\\b[:\\s-]*(.*)', 1) || ' ' || regexp_extract(raw, '\\b({'|'.join(MARKERS)})\\b[:\\s-]*(.*)', 2)), 120) AS text FROM lines WHERE t <> '' AND regexp_matches(raw, '\\b({'|'.join(MARKERS)})\\b')"),
    "token_counts": (token_counts, f"WITH {TOKENS_SQL} SELECT path, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens FROM tokens GROUP BY path"),
    "fnv_token_ids": (fnv_token_ids, f"WITH {TOKENS_SQL} SELECT token, count(*) AS uses, list_reduce([2166136261::BIGINT] || list_transform(string_split(token, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS token_id FROM tokens GROUP BY token"),
    "vocabulary_halstead": (vocabulary_halstead, HALSTEAD_SQL),
    "tier_routing": (tier_routing, TIER_SQL),
    "rule_findings": (rule_findings, f"WITH {FINDINGS_SQL} SELECT * FROM findings"),
    "long_lines_topk": (long_lines_topk, f"WITH {FINDINGS_SQL} SELECT path, count(*) AS findings, sum(debt_minutes)::BIGINT AS debt_minutes, max(line) AS last_line FROM findings WHERE rule_id = 'CQ010' GROUP BY path"),
    "findings_suppressed": (findings_suppressed, f"WITH {FINDINGS_SQL}, l AS (SELECT string_split(f.path, '/')[-1]::BIGINT AS doc_id, f.* FROM findings f) SELECT rule_id, count(*) AS findings, sum(debt_minutes)::BIGINT AS debt_minutes FROM l WHERE NOT EXISTS (SELECT 1 FROM labels x WHERE x.doc_id = l.doc_id AND (x.toxic = 1 OR (x.quality = 0 AND l.rule_id = 'CQ010'))) GROUP BY rule_id"),
    "file_scores": (file_scores, f"WITH {SCORES_SQL} SELECT * FROM scores"),
    "folder_rollup": (folder_rollup, f"WITH {SCORES_SQL} " + scored_sums("SELECT folder, sum(debt_minutes)::BIGINT AS debt_minutes, sum(sloc)::BIGINT AS sloc FROM (SELECT string_split(path, '/') AS p, debt_minutes, sloc, unnest([array_to_string(string_split(path, '/')[1:1], '/'), array_to_string(string_split(path, '/')[1:2], '/')]) AS folder FROM scores) GROUP BY folder")),
    "corpus_score": (corpus_score, f"WITH {SCORES_SQL}, c AS ({scored_sums('SELECT sum(debt_minutes)::BIGINT AS debt_minutes, sum(sloc)::BIGINT AS sloc FROM scores')}) SELECT *, {_DEBT_TEXT.replace('m ', 'debt_minutes ')} AS debt_text FROM c"),
    "debt_by_category": (debt_by_category, f"WITH {FINDINGS_SQL} SELECT " + ", ".join(f"coalesce(sum(debt_minutes) FILTER ({_CATEGORY} = '{c}'), 0)::BIGINT AS {c}" for c in ("complexity", "size", "duplication", "style")) + " FROM findings"),
    "hotspots": (hotspots, f"WITH {SCORES_SQL} SELECT path, debt_minutes, grade FROM scores WHERE debt_minutes > 0 ORDER BY debt_minutes DESC, path LIMIT 5"),
    "file_mart": (mart_rows, f"WITH {MART_SQL} SELECT * FROM mart"),
    "corpus_summary": (corpus_summary, f"WITH {SCORES_SQL}, c AS ({scored_sums('SELECT sum(debt_minutes)::BIGINT AS debt_minutes, sum(sloc)::BIGINT AS sloc, count(*) AS files, 0::BIGINT AS tier1, count(*) AS tier2, 0::BIGINT AS skipped, 0.0::DOUBLE AS duplicated_pct FROM scores')}) SELECT *, {_DEBT_TEXT.replace('m ', 'debt_minutes ')} AS debt_text FROM c"),
    "gate_reasons": (gate_reasons, f"WITH {SCORES_SQL}, c AS ({scored_sums('SELECT sum(debt_minutes)::BIGINT AS debt_minutes, sum(sloc)::BIGINT AS sloc FROM scores')}), r AS (SELECT list_filter([CASE WHEN grade > 'A' THEN 'grade ' || grade || ' is below A' END, CASE WHEN debt_ratio * 100 > 5 THEN 'debt ratio ' || printf('%.1f', debt_ratio * 100) || '% exceeds 5%' END, CASE WHEN EXISTS (SELECT 1 FROM findings WHERE rule_id = 'CQ006') THEN 'rule CQ006 fired' END], lambda x: x IS NOT NULL) AS l FROM c) SELECT len(l) = 0 AS passed, array_to_string(l, '; ') AS reasons FROM r"),
    "filter_language": (filter_language, f"WITH {MART_SQL} SELECT count(*) AS q0, count(*) FILTER (grade >= 'C') AS q1, count(*) FILTER (grade = 'A') AS q2, count(*) FILTER (rules LIKE '%CQ006%') AS q3, count(*) FILTER (tier = 2) AS q4, count(*) FILTER (tier = 1) AS q5, count(*) FILTER (contains(lower(path), 'src1') AND grade >= 'D') AS q6, count(*) FILTER (contains(lower(path), 'en/')) AS q7 FROM mart"),
    "top_folder_counts": (top_folder_counts, f"WITH {FILES_SQL} SELECT string_split(path, '/')[1] AS folder, count(*) AS files FROM files GROUP BY 1 ORDER BY files DESC, folder LIMIT 12"),
    "navigation": (navigation, f"WITH {SCORES_SQL}, m AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, path, debt_minutes FROM scores) SELECT folder, path, coalesce(lead(path) OVER w, first_value(path) OVER w) AS next, coalesce(lag(path) OVER w, last_value(path) OVER (PARTITION BY folder ORDER BY debt_minutes DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous FROM m WINDOW w AS (PARTITION BY folder ORDER BY debt_minutes DESC, path)"),
    "issues_by_rule": (issues_by_rule, f"WITH {FINDINGS_SQL} SELECT rule_id, count(*) AS findings, sum(debt_minutes)::BIGINT AS debt_minutes FROM findings GROUP BY rule_id"),
    "issues_by_file": (issues_by_file, f"WITH {FINDINGS_SQL} SELECT path, (sum(debt_minutes) OVER (PARTITION BY path))::BIGINT AS file_debt, rule_id, severity, line FROM findings"),
    "panel_findings": (panel_findings, f"WITH {FINDINGS_SQL}, r AS (SELECT path, rule_id, line, row_number() OVER (PARTITION BY path ORDER BY list_position(['critical', 'major', 'minor', 'info'], severity), line, rule_id)::INT AS rank FROM findings) SELECT * FROM r WHERE rank <= 3"),
    "worst_line": (worst_line, f"WITH {FINDINGS_SQL} SELECT path, arg_max(line, debt_minutes * 1000000 - line) AS line FROM findings GROUP BY path"),
    "log_height": (log_height, f"WITH {SCORES_SQL} SELECT path, CASE WHEN max(debt_minutes) OVER () <= 0 THEN 0.55 WHEN debt_minutes <= 0 THEN 0 ELSE ln(1 + debt_minutes) / ln(1 + max(debt_minutes) OVER ()) END AS height FROM scores"),
    "layout_floors": (layout_floors, f"WITH {LAYOUT_SQL}"),
    "worst_file": (worst_files, f"WITH {SCORES_SQL} SELECT path, debt_minutes AS debt, grade FROM scores ORDER BY debt_minutes DESC, path LIMIT 1"),
    "severity_share": (severity_share, f"WITH {FINDINGS_SQL} SELECT severity, count(*) AS n, floor(100 * count(*) / sum(count(*)) OVER () + 0.5)::BIGINT AS percent FROM findings GROUP BY severity"),
    "finding_details": (finding_details, f"WITH {FINDINGS_SQL} SELECT path, rule_id, line, CASE rule_id {_NAMES} END AS name, {_CATEGORY} AS category, {_DEBT_TEXT.replace('m ', 'debt_minutes ')} AS debt_text FROM findings"),
}
