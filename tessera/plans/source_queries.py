"""Sources, caches, change feeds and rewrites over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import languages, rewrites, routing, rules
from tessera.operators.rules import MOST_LINES
from tessera.plans.analysis_queries import FINDINGS_SQL, LIMITS, MARKERS, findings
from tessera.plans.corpus import FILES_SQL, document_files, page_files, table
from tessera.sinks import reports
from tessera.sources import cache, notebooks
from tessera.streaming import incremental


_MARKER = rf"\b({'|'.join(MARKERS)})\b[:\s-]*(.*)"


def notebook_cells(spark, sf_dir):
    """Conversations as notebooks: what the assistant says is code."""
    t = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    cell = F.struct(F.col("turn"), F.when(F.col("role") == "assistant", "code").otherwise("markdown").alias("cell_type"), F.col("text").alias("source"))
    books = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    text = F.to_json(F.struct(F.transform("c", lambda x: F.struct(x["cell_type"].alias("cell_type"), x["source"].alias("source"))).alias("cells")))
    return notebooks.code_lines(books.select(F.concat(F.lit("nb/"), F.col("conv_id").cast("string")).alias("path"), text.alias("text")))


NOTEBOOK_SQL = r"""WITH c AS (SELECT 'nb/' || conv_id AS path, role, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE WHEN role = 'assistant' THEN 'code' ELSE 'markdown' END, text))::INT AS cell FROM conversations WHERE text IS NOT NULL),
l AS (SELECT path, cell, string_split(text, chr(10)) AS l FROM c WHERE role = 'assistant'),
x AS (SELECT path, cell, i, l[i + 1] AS raw FROM l, unnest(range(len(l))) AS y(i))
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY cell, i) - 1)::INT AS line, cell, CASE WHEN regexp_matches(raw, '^\s*[%!]') THEN '# ' || raw ELSE raw END AS code FROM x"""


def excluded_pages(spark, sf_dir):
    """Pages left after folder, glob and ignore rules over their paths."""
    path = F.col("path")
    ignored = routing.ignore_regexes("# drafts\n*.org/**/1*.html\n!keep\n")
    return page_files(spark, sf_dir).where(~routing.excluded(path, ("de", "node_modules"), ("**/fr/*.html/*",), ignored)).select("path")


def language_keys(spark, sf_dir):
    """Languages of generated file names, one extension after the other."""
    exts = [*sorted(languages.extension_map()), ".ipynb", ".json", ".zzz", ""]
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, exts)), (F.col("doc_id") % len(exts) + 1).cast("int")).alias("ext"))
    found = routing.with_language(d.select("doc_id", F.concat(F.lit("a/b.c/F"), F.col("doc_id").cast("string"), F.upper("ext")).alias("path")), (".ZZZ",))
    return found.groupBy("language_key").agg(F.count(F.lit(1)).alias("files"), F.min(languages.display_name(F.col("language_key"))).alias("name"))


_EXTS = [*sorted(languages.extension_map()), ".ipynb", ".json", ".zzz", ""]
_KEYS = [*(languages.extension_map()[e] for e in sorted(languages.extension_map())), "notebook:python", None, "tier2:zzz", None]
_NAMES = {k: n for k, (n, _) in languages.STRUCTURED.items()} | {f"tier2:{k}": v[0] for k, v in languages.PLAIN.items()} | {"notebook:python": "Jupyter Notebook", "tier2:zzz": "ZZZ"}
LANGUAGE_SQL = f"""WITH k AS (SELECT [{", ".join("NULL" if k is None else f"'{k}'" for k in _KEYS)}][doc_id % {len(_EXTS)} + 1] AS language_key FROM documents)
SELECT language_key, count(*) AS files, CASE language_key {" ".join(f"WHEN '{k}' THEN '{n}'" for k, n in sorted(_NAMES.items()))} END AS name FROM k WHERE language_key IS NOT NULL GROUP BY language_key"""


def cache_misses(spark, sf_dir):
    """Documents whose content isn't among that of the first sources."""
    files = cache.with_key(document_files(spark, sf_dir))
    return cache.misses(files, files.where("path LIKE 'src1%'").select("content_key")).select("path", "content_key")


def vanished_files(spark, sf_dir):
    """Paths known from documents that a listing of the labelled ones lacks."""
    known = document_files(spark, sf_dir).select("path", F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"))
    listed = known.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return incremental.vanished(known, listed).select("path")


def latest_generation(spark, sf_dir):
    """The newest event of each user and type: later generations win, the larger id on a tie."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id")).alias("generation"), "value")
    return incremental.latest(e).select("path", F.col("generation.id").alias("event_id"), "value")


def removed_prefix(spark, sf_dir):
    """What is left when src1 and all below it are deleted, and one file."""
    files = document_files(spark, sf_dir).select("path", "lang")
    gone = spark.createDataFrame([("src1",), ("src2/en",)], "path string")
    return incremental.without_removed(files, gone).groupBy("lang").agg(F.count(F.lit(1)).alias("files"))


def upserts(spark, sf_dir):
    """A stored table of documents brought up to date with newer versions of one source."""
    files = document_files(spark, sf_dir).select("path", F.lit(1).alias("generation"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    newer = files.where("path LIKE 'src3/%'").select("path", F.lit(2).alias("generation"), (F.col("size") * 2).alias("size"))
    stale = files.where("path LIKE 'src4/%'").select("path", F.lit(0).alias("generation"), F.lit(-1).alias("size"))
    return incremental.upsert(files, newer.unionByName(stale)).groupBy("generation").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))


def threshold_provenance(spark, sf_dir):
    _, source = rules.merge_thresholds({"nesting": 4, "parameters": 5}, {"nesting": 5, "line_length": 100})
    return spark.createDataFrame(list(source.items()), "threshold string, source string").groupBy("source").agg(F.count(F.lit(1)).alias("thresholds"))


def sarif_results(spark, sf_dir):
    return reports.sarif_results(findings(spark, sf_dir)).select("path", "rule_id", "level", "start_line", "start_column", "end_column", "rule_index")


def diagnostics(spark, sf_dir):
    return reports.diagnostics(findings(spark, sf_dir)).select("path", "rule_id", "line", "level", "message")


def removed_markers(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  x = 1  # todo: "), "p_name", F.lit(" FIXME ok")).alias("line"))
    return d.select("p_partkey", rewrites.remove_marker(F.col("line")).alias("line"), rewrites.suppression_comment(F.col("line"), F.lit("CQ010"), "python").alias("comment"))


#: Calls with strings, escapes, nested brackets, comments and open quotes.
_LINE = """CASE p_partkey % 5 WHEN 0 THEN concat('    call(', chr(39), p_name, chr(39), ', second_argument, third)')
    WHEN 1 THEN concat('  f([a, b], "x, ', chr(92), '" y", ', p_name, ', {k: 1, l: 2}, end) # one, two') WHEN 2 THEN concat('g(', p_name, ', `open, ', p_type, ', rest')
    WHEN 3 THEN concat(chr(9), 'hh(', p_brand, '), (', p_name, ',', p_type, ', 12345678) // (a, b, c)') ELSE concat('(', p_name, ', aa, bb / cc, dd,, eeeeeeeeee, ff, gg)') END"""


def split_lines(spark, sf_dir):
    """Where a line may be split, and the line in two."""
    d = table(spark, sf_dir, "part").select("p_partkey", F.expr(_LINE).alias("line"))
    return d.select("p_partkey", F.coalesce(rewrites.split_point(F.col("line")), F.lit(-1)).alias("at"), rewrites.split_long_line(F.col("line")).alias("line"))


_P = rewrites.LEXEMES.replace("'", "''")


def split_ctes(lines: str) -> str:
    """SQL of tables up to ``halves``(id, line, place, two) over the rows id and line of a query: where each may be split, and the line in two."""
    return f"""l AS ({lines}),
x AS (SELECT id, line, unnest(regexp_extract_all(line, '{_P}')) AS x, unnest(range(len(regexp_extract_all(line, '{_P}')))) AS k FROM l),
o AS (SELECT *, coalesce(sum(length(x)) OVER w, 0)::BIGINT AS place, coalesce(sum(CASE WHEN x IN ('(', '[', '{{') THEN 1 WHEN x IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER w, 0) AS depth,
    regexp_matches(x, '^["''`]') AND (length(x) = 1 OR left(x, 1) <> right(x, 1)) AS bad FROM x WINDOW w AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT id, line, length(line) / 2 AS half, list(place ORDER BY k) FILTER (x = ',' AND depth = 1) AS commas, bool_or(bad) AS bad FROM o GROUP BY id, line),
b AS (SELECT *, list_reduce([-1::BIGINT] || coalesce(commas, []), lambda b, i: CASE WHEN b < 0 OR abs(i - half) < abs(b - half) THEN i + 1 ELSE b END) AS best FROM c),
s AS (SELECT id, line, CASE WHEN NOT bad AND best >= {rewrites.LEAST_HEAD} AND length(line) - best >= {rewrites.LEAST_TAIL} THEN best END AS place FROM b),
halves AS (SELECT *, CASE WHEN place IS NULL THEN line ELSE rtrim(left(line, place)) || chr(10) || regexp_extract(line, '^\\s*') || '  ' || ltrim(substr(line, place + 1)) END AS two FROM s)"""


SPLIT_SQL = f"""WITH {split_ctes(f'SELECT p_partkey AS id, {_LINE} AS line FROM part')} SELECT id AS p_partkey, coalesce(place, -1)::INT AS "at", two AS line FROM halves"""

QUERIES = {
    "notebook_cells": (notebook_cells, NOTEBOOK_SQL),
    "excluded_pages": (excluded_pages, r"""WITH p AS (SELECT regexp_replace(regexp_extract(coalesce(url, ''), '://([^/?#]*[^?#]*)', 1), '/+$', '') || '/' || page_id || '.html' AS path FROM pages)
        SELECT path FROM p WHERE NOT list_contains(string_split(path, '/'), 'de') AND NOT list_contains(string_split(path, '/'), 'node_modules') AND NOT regexp_matches(path, '^(?:.*fr/[^/]*\.html/[^/]*)$') AND NOT regexp_matches(path, '^[^/]*\.org/.*1[^/]*\.html(?:/.*)?$')"""),
    "language_keys": (language_keys, LANGUAGE_SQL),
    "cache_misses": (cache_misses, f"WITH {FILES_SQL}, k AS (SELECT path, sha256('{cache.ENGINE_VERSION}' || chr(0) || 'tier2:prose' || chr(0) || text) AS content_key FROM files) SELECT * FROM k WHERE content_key NOT IN (SELECT content_key FROM k WHERE path LIKE 'src1%')"),
    "vanished_files": (vanished_files, f"WITH {FILES_SQL} SELECT path FROM files WHERE string_split(path, '/')[-1]::BIGINT NOT IN (SELECT doc_id FROM labels)"),
    "latest_generation": (latest_generation, "SELECT user_id || '/' || event_type AS path, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"),
    "removed_prefix": (removed_prefix, f"WITH {FILES_SQL} SELECT lang, count(*) AS files FROM files WHERE NOT starts_with(path, 'src1/') AND NOT starts_with(path, 'src2/en/') GROUP BY lang"),
    "upserts": (upserts, f"WITH {FILES_SQL}, u AS (SELECT CASE WHEN path LIKE 'src3/%' THEN 2 ELSE 1 END AS generation, length(text) * CASE WHEN path LIKE 'src3/%' THEN 2 ELSE 1 END AS size FROM files) SELECT generation, count(*) AS files, sum(size)::BIGINT AS size FROM u GROUP BY generation"),
    "threshold_provenance": (threshold_provenance, "SELECT * FROM (VALUES ('explicit', 2::BIGINT), ('project', 1), ('default', 8)) AS t(source, thresholds)"),
    "sarif_results": (sarif_results, f"""WITH {FINDINGS_SQL}, p AS (SELECT f.*, length(l.raw) AS n, regexp_extract(l.raw, '^(.*?)\\b(License|Licensed|Copyright)\\b', 1) AS before, row_number() OVER (PARTITION BY f.path, f.rule_id ORDER BY f.line) AS k FROM findings f JOIN lines l ON l.path = f.path AND l.line = f.line),
        s AS (SELECT path, rule_id, CASE WHEN severity IN ('critical', 'major') THEN 'warning' ELSE 'note' END AS level, line + 1 AS start_line,
            CASE WHEN rule_id = 'CQ010' AND k <= 20 THEN 80 WHEN rule_id = 'CQ011' THEN length(before) ELSE 0 END AS c, CASE WHEN rule_id = 'CQ011' THEN length(before) + 4 ELSE n END AS e FROM p)
        SELECT path, rule_id, level, start_line, (c + 1)::INT AS start_column, (greatest(e, c) + 1)::INT AS end_column, (right(rule_id, 3)::INT - 1) AS rule_index FROM s"""),
    "diagnostics": (diagnostics, f"""WITH {FINDINGS_SQL} SELECT f.path, rule_id, f.line, CASE WHEN severity IN ('critical', 'major') THEN 'Warning' WHEN severity = 'minor' THEN 'Information' ELSE 'Hint' END AS level,
        CASE WHEN rule_id = 'CQ006' THEN value::BIGINT || ' lines, limit {LIMITS.file_length}' WHEN rule_id = 'CQ010' AND g.k <= {MOST_LINES} THEN value::BIGINT || ' characters, limit {LIMITS.line_length}'
            WHEN rule_id = 'CQ010' THEN value::BIGINT || ' more lines over {LIMITS.line_length} characters' ELSE left(trim(regexp_extract(raw, '{_MARKER}', 1) || ' ' || regexp_extract(raw, '{_MARKER}', 2)), 120) END AS message
        FROM findings f JOIN lines l ON l.path = f.path AND l.line = f.line LEFT JOIN long g ON g.path = f.path AND g.line = f.line"""),
    "removed_markers": (removed_markers, "SELECT p_partkey, '  x = 1  # ' || p_name || ' FIXME ok' AS line, '  # tessera-disable-next-line CQ010' AS comment FROM part"),
    "split_lines": (split_lines, SPLIT_SQL),
}
