"""History over events and orders, and structural measurements over generated code."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scoring import score_columns
from tessera.operators import history, ranking, rollups, routing, rules, structure
from tessera.plans.corpus import table
from tessera.session import kept

NOW = 1_706_745_600_000
ORDERS_NOW = 1_000_000_000_000


def event_samples(spark, sf_dir):
    """One sample for each user and millisecond."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t")).agg(F.max("value").alias("v"))
    return e.select("key", "t", F.lit("A").alias("grade"), F.floor("v").alias("score"), F.floor(F.col("v") * 10).alias("debt_minutes"), F.lit(1000).alias("sloc"), F.lit(10).alias("files"), F.lit(None).cast("long").alias("n"))


EVENTS_SQL = "samples AS (SELECT user_id AS key, (epoch_us(ts) // 1000) AS t, floor(max(value))::BIGINT AS score, floor(max(value) * 10)::BIGINT AS debt_minutes FROM events GROUP BY user_id, (epoch_us(ts) // 1000))"


def order_samples(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderstatus").alias("key"), (F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86_400_000).alias("t"), F.col("o_orderpriority").alias("grade"),
        (F.col("o_orderkey") % 101).alias("score"), F.floor("o_totalprice").alias("debt_minutes"), (F.col("o_custkey") + 1).alias("sloc"), F.lit(3).cast("long").alias("files"), (F.col("o_orderkey") % 4 + 1).alias("n"),
    ).groupBy("key", "t").agg(*(F.max_by(c, F.struct("debt_minutes", "sloc", "grade")).alias(c) for c in ("grade", "score", "debt_minutes", "sloc", "files", "n")))


ORDERS_SQL = """raw AS (SELECT o_orderstatus AS key, epoch_us(o_orderdate) // 1000 + o_orderkey % 86400000 AS t, o_orderpriority AS grade, o_orderkey % 101 AS score, floor(o_totalprice)::BIGINT AS debt_minutes, o_custkey + 1 AS sloc, 3::BIGINT AS files, o_orderkey % 4 + 1 AS n FROM orders),
samples AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY key, t ORDER BY debt_minutes DESC, sloc DESC, grade DESC) = 1)"""
_CUT = str(ORDERS_NOW - history.ROLL_UP_AFTER_DAYS * history.DAY_MS)
ROLLED_SQL = ORDERS_SQL + f""", rolled AS (SELECT key, max(t) AS t, arg_max(grade, t) AS grade, floor(sum(score * n) / sum(n) + 0.5)::BIGINT AS score, floor(sum(debt_minutes * n) / sum(n) + 0.5)::BIGINT AS debt_minutes, floor(sum(sloc * n) / sum(n) + 0.5)::BIGINT AS sloc, floor(sum(files * n) / sum(n) + 0.5)::BIGINT AS files, sum(n)::BIGINT AS n
    FROM samples WHERE t < {_CUT} GROUP BY key, date_trunc('month', epoch_ms(t))
    UNION ALL SELECT key, t, grade, score, debt_minutes, sloc, files, n FROM samples WHERE t >= {_CUT})"""


def history_burst_collapse(spark, sf_dir):
    return history.collapse_bursts(event_samples(spark, sf_dir), gap=3_600_000).select("key", "t", "score")


def history_monthly_rollup(spark, sf_dir):
    return history.roll_up(order_samples(spark, sf_dir), ORDERS_NOW)


def history_ring_buffer(spark, sf_dir):
    return history.keep_newest(event_samples(spark, sf_dir), most=5).select("key", "t", "score")


def history_compact(spark, sf_dir):
    return history.compact(order_samples(spark, sf_dir), ORDERS_NOW)


def history_delta(spark, sf_dir):
    return history.delta(event_samples(spark, sf_dir))


def history_sparkline(spark, sf_dir):
    return history.sparkline(event_samples(spark, sf_dir), 100, 20)


def trend_captions(spark, sf_dir):
    d = history.delta(event_samples(spark, sf_dir))
    return d.select("key", history.trend_caption(F.col("since_start"), F.col("span")).alias("caption"))


def hierarchy_scores(spark, sf_dir):
    """Suppliers as files, nations and regions as folders: debt is returned quantity, code is shipped lines."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).cast("long").alias("debt_minutes"), F.count(F.lit(1)).alias("sloc"))  # noqa: E741
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    files = l.join(s, "s_suppkey").join(n, "n_nationkey").join(r, "r_regionkey")
    return rollups.folder_scores(files.select(F.concat_ws("/", "r_name", "n_name", F.col("s_suppkey").cast("string")).alias("path"), F.lit(1).alias("tier"), "debt_minutes", "sloc"))


HIERARCHY_SQL = """f AS (SELECT r_name, n_name, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS debt_minutes, count(*) AS sloc FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name, s_suppkey),
g AS (SELECT unnest([r_name, r_name || '/' || n_name]) AS folder, debt_minutes, sloc FROM f)"""


def generated_code(spark, sf_dir):
    """A Python function for each document: nested ifs and parameters, as many as its id says."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("n"), (F.col("doc_id") % 9 + 1).cast("int").alias("p"))
    params = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p")), lambda i: F.concat(F.lit("a"), i.cast("string"))), ", ")
    ifs = F.when(F.col("n") > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: F.concat(F.repeat(F.lit("    "), i), F.lit("if a1 > "), i.cast("string"), F.lit(":\n"))), "")).otherwise("")
    text = F.concat(F.lit("def f"), F.col("doc_id").cast("string"), F.lit("("), params, F.lit("):\n"), ifs, F.repeat(F.lit("    "), F.col("n") + 1), F.lit("return a1"))
    return d.select(F.concat(F.lit("gen/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language_key"), text.alias("text"))


def structured(spark, sf_dir):
    return rollups.score_files(rules.evaluate(structure.analyze(routing.route(generated_code(spark, sf_dir)))))


def structural_metrics(spark, sf_dir):
    functions = structured(spark, sf_dir).select("path", "tier", F.explode_outer("functions").alias("f")).where("f IS NOT NULL")
    return functions.select("path", "tier", "f.name", "f.kind", "f.params", "f.cyclomatic", "f.cognitive", "f.max_nesting", "f.sloc")


STRUCTURE_SQL = "g AS (SELECT doc_id, (doc_id % 5)::INT AS n, (doc_id % 9 + 1)::INT AS p, 'gen/' || doc_id || '.py' AS path FROM documents)"


def structural_findings(spark, sf_dir):
    return rollups.explode_findings(structured(spark, sf_dir)).select("path", "rule_id", "severity", "line", "debt_minutes", "symbol")


STRUCTURE_FINDINGS_SQL = STRUCTURE_SQL + """, found AS (SELECT path, 'CQ004' AS rule_id, 'major' AS severity, 0 AS line, (15 + 5 * (p - 7))::BIGINT AS debt_minutes, 'f' || doc_id AS symbol FROM g WHERE p > 7
    UNION ALL SELECT path, 'CQ005', 'major', 0, 10 * (n - 3), 'f' || doc_id FROM g WHERE n > 3)"""


def symbols_left_join(spark, sf_dir):
    files = kept(structured(spark, sf_dir).select("path", "functions", "findings"))  # both sides of the join come from one parse
    functions = files.select("path", F.explode_outer("functions").alias("f")).where("f IS NOT NULL").select("path", "f.name", "f.start_line", "f.sloc")
    return rollups.symbols(functions, rollups.explode_findings(files)).select("path", "name", "sloc", "n_findings", "debt_minutes", "debt_ratio", "score", "grade")


def panel_symbols(spark, sf_dir):
    files = kept(structured(spark, sf_dir).select("path", "functions", "findings"))  # both sides of the join come from one parse
    functions = files.select("path", F.explode_outer("functions").alias("f")).where("f IS NOT NULL").select("path", "f.name", "f.start_line", "f.sloc")
    ranked = ranking.panel_symbols(rollups.symbols(functions, rollups.explode_findings(files)))
    return ranked.select("path", "name", "rank")


def ratio_grades(spark, sf_dir):
    """Grades of every order as if its price were debt and its key a size: the bounds of the scale at volume."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 100).cast("long").alias("debt_minutes"), (F.col("o_custkey") % 500).alias("sloc"))
    return o.withColumns(score_columns(F.col("debt_minutes"), F.col("sloc"))).groupBy("grade").agg(F.count(F.lit(1)).alias("orders"), F.sum("score").alias("score_sum"), F.min("debt_ratio").alias("least"), F.max("debt_ratio").alias("most"))


_GRADE = "CASE WHEN ratio <= 0.05 THEN 'A' WHEN ratio <= 0.1 THEN 'B' WHEN ratio <= 0.2 THEN 'C' WHEN ratio <= 0.5 THEN 'D' ELSE 'E' END"
_SCORED = "SELECT *, floor(ratio * 10000 + 0.5) / 10000 AS debt_ratio, floor(greatest(0, 1 - ratio / 0.5) * 100 + 0.5)::INT AS score, " + _GRADE + " AS grade FROM (SELECT *, CASE WHEN sloc > 0 THEN debt_minutes / (sloc * 30) ELSE 0 END AS ratio FROM ({}))"
_CAPTION = (
    "CASE WHEN since_start > 0 THEN 'improved by ' || since_start || CASE WHEN since_start = 1 THEN ' point' ELSE ' points' END "
    "WHEN since_start < 0 THEN 'dropped by ' || -since_start || CASE WHEN since_start = -1 THEN ' point' ELSE ' points' END ELSE 'held steady' END "
    "|| CASE WHEN floor(span / 86400000 + 0.5) >= 2 THEN ' over ' || floor(span / 86400000 + 0.5)::BIGINT || ' days' ELSE '' END"
)
_DELTA = "delta AS (SELECT key, arg_max(score, t) - arg_min(score, t) AS since_start, arg_max(score, t) - list(score ORDER BY t DESC)[2] AS since_last, max(t) - min(t) AS span FROM samples GROUP BY key HAVING count(*) >= 2)"

QUERIES = {
    "history_burst_collapse": (history_burst_collapse, f"WITH {EVENTS_SQL}, x AS (SELECT *, lead(t) OVER (PARTITION BY key ORDER BY t) AS nx FROM samples) SELECT key, t, score FROM x WHERE nx IS NULL OR nx - t >= 3600000"),
    "history_monthly_rollup": (history_monthly_rollup, f"WITH {ROLLED_SQL} SELECT * FROM rolled"),
    "history_ring_buffer": (history_ring_buffer, f"WITH {EVENTS_SQL} SELECT key, t, score FROM samples QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC) <= 5"),
    "history_compact": (history_compact, f"WITH {ROLLED_SQL} SELECT * FROM rolled QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC) <= {history.MOST_SAMPLES}"),
    "history_delta": (history_delta, f"WITH {EVENTS_SQL}, {_DELTA} SELECT * FROM delta"),
    "history_sparkline": (history_sparkline, f"""WITH {EVENTS_SQL}, p AS (SELECT key, t, score, min(t) OVER w AS t0, greatest(1, max(t) OVER w - min(t) OVER w) AS span FROM samples WINDOW w AS (PARTITION BY key))
        SELECT key, CASE WHEN count(*) < 2 THEN '' ELSE string_agg(printf('%.1f', (t - t0) / span * 100) || ',' || printf('%.1f', 20 - greatest(0, least(100, score)) / 100 * 20), ' ' ORDER BY t) END AS points FROM p GROUP BY key"""),
    "trend_captions": (trend_captions, f"WITH {EVENTS_SQL}, {_DELTA} SELECT key, {_CAPTION} AS caption FROM delta"),
    "hierarchy_scores": (hierarchy_scores, f"WITH {HIERARCHY_SQL} SELECT folder, debt_minutes, sloc, debt_ratio, score, grade FROM ({_SCORED.format('SELECT folder, sum(debt_minutes)::BIGINT AS debt_minutes, sum(sloc)::BIGINT AS sloc FROM g GROUP BY folder')})"),
    "structural_metrics": (structural_metrics, f"WITH {STRUCTURE_SQL} SELECT path, 1 AS tier, 'f' || doc_id AS name, 'function' AS kind, p AS params, 1 + n AS cyclomatic, (n * (n + 1) // 2)::INT AS cognitive, n AS max_nesting, n + 2 AS sloc FROM g"),
    "structural_findings": (structural_findings, f"WITH {STRUCTURE_FINDINGS_SQL} SELECT * FROM found"),
    "symbols_left_join": (symbols_left_join, f"WITH {STRUCTURE_FINDINGS_SQL} SELECT path, name, sloc, n_findings, debt_minutes, debt_ratio, score, grade FROM ({_SCORED.format(chr(10) + 'SELECT g.path, any_value(chr(102) || doc_id) AS name, any_value(n + 2) AS sloc, count(rule_id) AS n_findings, coalesce(sum(debt_minutes), 0)::BIGINT AS debt_minutes FROM g LEFT JOIN found USING (path) GROUP BY g.path')})"),
    "panel_symbols": (panel_symbols, f"WITH {STRUCTURE_SQL} SELECT path, 'f' || doc_id AS name, 1 AS rank FROM g"),
    "ratio_grades": (ratio_grades, f"SELECT grade, count(*) AS orders, sum(score)::BIGINT AS score_sum, min(debt_ratio) AS least, max(debt_ratio) AS most FROM ({_SCORED.format('SELECT o_orderkey, floor(o_totalprice / 100)::BIGINT AS debt_minutes, o_custkey % 500 AS sloc FROM orders')}) GROUP BY grade"),
}
