"""The driver tables seen as files, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import spread

LANGUAGE = "tier2:prose"

#: One file a document: source/language/id.
FILES_SQL = "files AS (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id AS path, coalesce(text, '') AS text, lang FROM documents)"
#: Lines from 0, with surrounding white space trimmed.
LINES_SQL = (
    FILES_SQL + ", split AS (SELECT path, lang, string_split_regex(text, '\\r?\\n') AS l FROM files), "
    "lines AS (SELECT path, lang, i::INT AS line, l[i + 1] AS raw, regexp_replace(l[i + 1], '^\\s+|\\s+$', '', 'g') AS t FROM split, unnest(range(len(l))) AS x(i)), "
    "code AS (SELECT * FROM lines WHERE t <> '' AND NOT starts_with(t, '//') AND NOT starts_with(t, '#'))"
)
#: Tokens of code lines, with positions from 0.
TOKEN_SQL = r"""'[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|\S'"""
TOKENS_SQL = LINES_SQL + f""", per_line AS (SELECT path, line, regexp_extract_all(raw, {TOKEN_SQL}) AS w FROM code),
tokens AS (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY line, j) - 1)::INT AS pos, line, w[j + 1] AS token FROM per_line, unnest(range(len(w))) AS y(j))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    return spread(table(spark, sf_dir, "documents").select(path.alias("path"), F.lit(LANGUAGE).alias("language_key"), "text", "lang"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*[^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(F.concat(F.regexp_replace(site, "/+$", ""), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("tier2:html").alias("language_key"), F.col("html").alias("text"))
