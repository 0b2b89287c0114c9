"""URL filters with redirect equivalence: block decisions spread over redirect and canonical-link edges, explicit allows come first."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and all its subdomains where the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed by contract.
RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A url as a node: scheme and host in lower case, no fragment, and / for an empty path; null where there is no ://."""
    head = F.translate(F.regexp_extract(url, r"^([^:/?#]*)://", 1), _UPPER, _LOWER)
    host = F.translate(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1), _UPPER, _LOWER)
    rest = F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*([^#]*)", 1)
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(url.rlike(r"^[^:/?#]+://"), F.concat(head, F.lit("://"), host, rest))


_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)")
_TAG = re.compile(r"""(?is)<(link|meta)\b((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_ATTRIBUTE = re.compile(r"""(?is)([a-z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_REFRESH = re.compile(r"""(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?(.*?)["']?\s*$""")


def markup_targets(url: str, html: str) -> list[str]:
    """Where the page says that it lives or leads: targets of canonical links and meta refreshes, outside comments and scripts."""
    out = []
    for m in _TAG.finditer(_HIDDEN.sub("", html)):
        has = {k.lower(): unescape(v.strip("\"'")).strip() for k, v in reversed(_ATTRIBUTE.findall(m[2]))}
        target = None
        if m[1].lower() == "link" and "canonical" in has.get("rel", "").lower().split():
            target = has.get("href")
        elif m[1].lower() == "meta" and has.get("http-equiv", "").lower() == "refresh" and (r := _REFRESH.match(has.get("content", ""))):
            target = r[1]
        if target and not target.startswith("#"):
            try:
                target = urljoin(url, target)
            except ValueError:
                continue
            if "://" in target:
                out.append(target)
    return out


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) urls of canonical links and of meta refreshes in the pages' markup.

    Only pages that hold the words at all are parsed. Null pages and hrefs that lead nowhere give none; repeated edges stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(u.as_py(), t) for u, h in zip(batch.column(0), batch.column(1), strict=True) for t in markup_targets(u.as_py(), h.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.string())], names=["source", "target"])

    low = F.lower(html)
    hints = F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("http-equiv"))
    return pages.where(F.col(url).isNotNull() & hints).select(url, html).mapInArrow(run, "source string, target string")


def own_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as a struct of name and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the last to fit, so the longest, is outermost
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(urls: DataFrame, edges: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url") -> DataFrame:
    """urls with host, path, rule, verdict and cause: ``rule``, ``alias allow``, ``alias block`` or ``none``.

    edges(source, target) are redirects and canonical links; urls joined by them, in either direction and over any
    number of steps, are aliases. A url's own longest rule decides. Without one, an allow rule that fits any alias
    allows; else a block rule that fits any alias blocks; else the url is allowed. Aliases count even where no row has
    them. A null url, or one without ://, has empty host and path, no aliases, and is allowed. Repeated rows are judged
    alike. Only the urls that are ends of edges are shuffled for components and verdicts; the join back is by url and
    an equi-join that AQE splits where one url is hot.
    """
    node = node_of(F.col(url))
    judged = urls.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    judged = judged.withColumns({"__own": own_rule(F.col("host"), F.col("path"), rules), "__node": node})
    links = edges.select(node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    members = connected_components(links)
    own = members.withColumns({"host": url_host(F.col("node")), "path": url_path(F.col("node"))})
    own = own.withColumn("own", own_rule(F.col("host"), F.col("path"), rules)["verdict"])
    verdicts = own.groupBy("label").agg(F.max(F.col("own") == "allow").alias("any_allow"), F.max(F.col("own") == "block").alias("any_block"))
    spread = members.join(verdicts, "label").where("any_allow OR any_block").select(F.col("node").alias("__node"), F.when(F.col("any_allow"), "allow").otherwise("block").alias("__alias"))
    out = judged.join(spread, "__node", "left")
    return out.withColumns({
        "rule": F.col("__own.rule"),
        "verdict": F.coalesce("__own.verdict", "__alias", F.lit("allow")),
        "cause": F.when(F.col("__own").isNotNull(), "rule").when(F.col("__alias").isNotNull(), F.concat(F.lit("alias "), "__alias")).otherwise("none"),
    }).drop("__own", "__node", "__alias")


def op1_redirect_urls(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    pages = table(spark, sf_dir, "pages")
    judged = judge_urls(pages.select("page_id", "url"), page_edges(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "cause")


_NODE = r"""lower(regexp_extract({u}, '^([^:/?#]*)://', 1)) || '://' || lower(regexp_extract({u}, '^[^:/?#]*://([^/?#]*)', 1)) || CASE WHEN starts_with(regexp_extract({u}, '^[^:/?#]*://[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END || regexp_extract({u}, '^[^:/?#]*://[^/?#]*([^#]*)', 1)"""
_FITS = "CASE " + " ".join(
    f"WHEN ({{h}} = '{r.host}' OR ends_with({{h}}, '.{r.host}')) AND starts_with({{p}}, '{r.path}') THEN '{r.name}={r.verdict}'" for r in sorted(RULES, key=lambda r: (-len(r.name), r.name))
) + " END"
_HOST, _PATH = r"lower(regexp_extract({u}, '^(?s:.*?)://([^/?#]*)', 1))", r"regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
#: Aliases by canonical links that are absolute urls in double quotes, the form in which crawled pages have them.
OP1_SQL = f"""
WITH RECURSIVE links AS (
    SELECT DISTINCT {_NODE.format(u="url")} AS u, {_NODE.format(u="target")} AS v
    FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<link rel="canonical" href="([^"]*)"', 1)) AS target FROM pages) WHERE url IS NOT NULL AND target LIKE '%://%'
), both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS a, u AS b FROM both_ways UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON e.u = r.b),
alias AS (SELECT a, bool_or(r LIKE '%=allow') AS any_allow, bool_or(r LIKE '%=block') AS any_block
    FROM (SELECT a, {_FITS.format(h=_HOST.format(u="b"), p=_PATH.format(u="b"))} AS r FROM reach) GROUP BY a),
p AS (SELECT page_id, coalesce({_HOST.format(u="url")}, '') AS host, coalesce({_PATH.format(u="url")}, '') AS path, {_NODE.format(u="url")} AS node FROM pages),
j AS (SELECT *, {_FITS.format(h="host", p="path")} AS own FROM p)
SELECT page_id, host, path, string_split(own, '=')[1] AS rule,
    CASE WHEN own IS NOT NULL THEN string_split(own, '=')[2] WHEN any_allow THEN 'allow' WHEN any_block THEN 'block' ELSE 'allow' END AS verdict,
    CASE WHEN own IS NOT NULL THEN 'rule' WHEN any_allow THEN 'alias allow' WHEN any_block THEN 'alias block' ELSE 'none' END AS cause
FROM j LEFT JOIN alias ON a = node
"""
