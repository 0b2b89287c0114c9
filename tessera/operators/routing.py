"""Which kind of analysis a file gets, and the filters over results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import GRADE_ORDER
from tessera.functions.text import glob_regex
from tessera.operators import braces
from tessera.operators.languages import STRUCTURED, detect_language

# What marks generated and minified files, and folders that are never looked into.
GENERATED_PATH = r"(?i)(\.min\.(js|css)$)|(\.pb\.go$)|(_pb2(_grpc)?\.py$)|(\.g\.dart$)|(\.freezed\.dart$)|(\.designer\.cs$)|(\.generated\.\w+$)"
GENERATED_HEADER = r"(?i)auto-?generated|do not edit|@generated|generated by"
HEADER_LINES = 5
MINIFIED_LEAST, MINIFIED_MEAN, MINIFIED_LINE = 2000, 500, 5000


def is_generated_path(path: Column) -> Column:
    return path.rlike(GENERATED_PATH)


def has_generated_header(text: Column) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, HEADER_LINES), "\n").rlike(GENERATED_HEADER)


def is_minified(text: Column) -> Column:
    parts = F.split(text, "\n", -1)
    return (F.length(text) >= MINIFIED_LEAST) & ((F.length(text) / F.size(parts) > MINIFIED_MEAN) | F.exists(parts, lambda l: F.length(l) > MINIFIED_LINE))  # noqa: E741


#: Languages whose structure is measured.
PARSERS = ("python", *braces.SCANNED)


def route(files: DataFrame, parsers: tuple[str, ...] = PARSERS) -> DataFrame:
    """files(path, language_key, text) with tier, skip_reason and note.

    Tier 3 is skipped: generated by its path or its first lines, or minified, in this order. Tier 1 has a parser; the
    rest, languages whose parser is missing included, is tier 2.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.regexp_replace("language_key", "^notebook:", "")
    reason = F.when(is_generated_path(F.col("path")), "generated").when(has_generated_header(text), "generated").when(is_minified(text), "minified")
    tier = F.when(reason.isNotNull(), 3).when(key.isin(*parsers), 1).otherwise(2)
    note = F.when(reason.isNull() & key.isin(*braces.SCANNED), "measured by a token scanner").when(reason.isNull() & ~key.isin(*parsers) & key.isin(*STRUCTURED), F.concat(F.lit("no parser for "), key, F.lit("; partial analysis")))
    return files.withColumns({"tier": tier, "skip_reason": reason, "note": note})


def counts_toward_score(tier: Column, include_partial: bool = True, in_workspace: Column | None = None) -> Column:
    own = (tier != 3) & (F.lit(include_partial) | (tier == 1))
    return own if in_workspace is None else own & in_workspace


def excluded(path: Column, folders: tuple[str, ...], globs: tuple[str, ...] = (), ignored: tuple[str, ...] = ()) -> Column:
    """A path with a segment among ``folders``, or that a glob or an ignore pattern (see ignore_regexes) fits."""
    hit = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders))) if folders else F.lit(False)
    for r in [*map(glob_regex, globs), *ignored]:
        hit = hit | path.rlike(r)
    return hit


def ignore_regexes(text: str) -> tuple[str, ...]:
    """Regexes of an ignore file's patterns: comments and negations are dropped, a pattern without / fits at any depth, and all below a folder goes with it."""
    out = []
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line[0] in "#!":
            continue
        body = line.rstrip("/").removeprefix("/")
        anchored = "/" in line.rstrip("/")
        inner = glob_regex(body)[4:-2]
        out.append(f"^{'' if anchored else '(?:.*/)?'}(?:{inner})(?:/.*)?$")
    return tuple(out)


def matches(query: str) -> Column:
    """A filter over file marts (path, grade, tier, rules): all terms must hold.

    grade:c, grade:>=c (c or worse), rule:cq001, partial:yes, partial:no; anything else is looked for in the path.
    """
    out = F.lit(True)
    for term in query.lower().split():
        if m := re.fullmatch(r"grade:>=([a-e])", term):
            hit = F.instr(F.lit(GRADE_ORDER), F.col("grade")) >= GRADE_ORDER.index(m[1].upper()) + 1
        elif m := re.fullmatch(r"grade:([a-e])", term):
            hit = F.col("grade") == m[1].upper()
        elif m := re.fullmatch(r"rule:(cq\d{3})", term):
            hit = F.coalesce(F.array_contains("rules", m[1].upper()), F.lit(False))
        elif term in ("partial:yes", "partial:no"):
            hit = F.col("tier") == (2 if term == "partial:yes" else 1)
        else:
            hit = F.contains(F.lower("path"), F.lit(term))
        out = out & hit
    return out


def visible(query: str, collapsed: tuple[str, ...] = ()) -> Column:
    """What a list of files shows: measured, not below a collapsed top folder, and fitting the query."""
    top = F.element_at(F.split("path", "/"), 1)
    return (F.col("tier") != 3) & ~top.isin(*collapsed) & matches(query) if collapsed else (F.col("tier") != 3) & matches(query)


def with_language(files: DataFrame, extra_extensions: tuple[str, ...] = ()) -> DataFrame:
    """Files in a known language, with its key."""
    return files.withColumn("language_key", detect_language(F.col("path"), extra_extensions)).where("language_key IS NOT NULL")
