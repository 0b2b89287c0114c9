"""Measurements of a file from its text alone: one row in, one row out, nothing shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import LINE_END, MARKERS, TOKEN, indent_width, lines_of, marker_column, marker_of, settled, starts_with_any, trimmed, utf16_length
from tessera.operators.languages import NO_INDENT_NESTING, comment_prefixes, plain_name

DIRECTIVE_PREFIX = "tessera"


def directive_pattern(prefix: str = DIRECTIVE_PREFIX) -> str:
    return rf"(?i){prefix}-disable(-next-line|-line|-file)?(?![A-Za-z0-9_])[:\s]*([A-Za-z0-9,\s]*)"


def directive(line: Column, at: Column, prefix: str = DIRECTIVE_PREFIX) -> Column:
    """The suppression that a comment line holds, as a struct of scope, line and rules (empty: all); null without one."""
    p = directive_pattern(prefix)
    kind = F.lower(F.regexp_extract(line, p, 1))
    scope = F.when(kind == "-file", "file").when(kind == "-next-line", "nextLine").otherwise("line")
    rules = F.regexp_extract_all(F.upper(F.regexp_extract(line, p, 2)), F.lit(r"CQ\d{3}"), F.lit(0))
    return F.when(line.rlike(p), F.struct(scope.alias("scope"), at.cast("int").alias("line"), rules.alias("rules")))


def measure_generic(files: DataFrame, markers: tuple[str, ...] = MARKERS, prefix: str = DIRECTIVE_PREFIX) -> DataFrame:
    """files(path, language_key, text, ...) with lines, sloc, comment_lines, line_lengths, todos, suppressions and indent_nesting.

    A null text counts as empty: one empty line. Lines count from 0.
    """
    df = files.withColumn("__lines", lines_of(F.coalesce("text", F.lit(""))))
    df = df.withColumn("__prefixes", comment_prefixes(F.col("language_key")))
    entry = lambda l, i: F.struct(i.cast("int").alias("line"), l.alias("raw"), trimmed(l).alias("t"))  # noqa: E731, E741
    df = df.withColumn("__full", F.filter(F.transform("__lines", entry), lambda x: x["t"] != ""))
    comment = lambda x: starts_with_any(x["t"], F.col("__prefixes"))
    df = df.withColumn("__code", F.filter("__full", lambda x: ~comment(x)))
    todo = lambda x: F.struct(x["line"].alias("line"), marker_column(x["raw"], markers).cast("int").alias("col"), marker_of(x["raw"], markers).alias("text"))
    found = F.transform(F.filter("__full", comment), lambda x: directive(x["raw"], x["line"], prefix))
    df = df.withColumns({
        "lines": F.size("__lines"),
        "sloc": F.size("__code"),
        "comment_lines": F.size("__full") - F.size("__code"),
        "line_lengths": F.transform("__lines", lambda l: utf16_length(l).cast("int")),  # noqa: E741
        "todos": F.transform(F.filter("__full", lambda x: marker_of(x["raw"], markers).isNotNull()), todo),
        "suppressions": F.filter(found, lambda s: s.isNotNull()),
        "__indents": F.transform("__code", lambda x: F.struct(indent_width(x["raw"]).alias("w"), x["line"].alias("line"))),
    })
    return _indent_nesting(df).drop("__lines", "__prefixes", "__full", "__code", "__indents")


def _indent_nesting(df: DataFrame) -> DataFrame:
    """indent_nesting: the deepest indentation in units, less one, and its first line; null for markup.

    The unit is the most common step of 2 to 8 to a deeper line, the earliest on a tie, and 4 without any.
    """
    widths = F.concat(F.array(F.lit(0)), F.transform("__indents", lambda x: x["w"]))
    steps = F.filter(F.transform("__indents", lambda x, i: x["w"] - F.element_at(widths, i + 1)), lambda d: (d >= 2) & (d <= 8))
    df = df.withColumn("__steps", steps)
    votes = F.transform(F.array_distinct("__steps"), lambda d: F.struct(F.size(F.filter("__steps", lambda e: e == d)).alias("n"), (-F.array_position("__steps", d)).alias("first"), d.alias("d")))
    df = df.withColumn("__unit", F.coalesce(F.array_max(votes)["d"], F.lit(4)))
    deepest = F.array_max(F.transform("__indents", lambda x: F.struct(F.floor(x["w"] / F.col("__unit")).cast("int").alias("depth"), (-x["line"]).alias("at"))))
    nesting = F.struct(F.greatest(F.lit(0), F.coalesce(deepest["depth"], F.lit(0)) - 1).alias("depth"), F.when(deepest["depth"] > 0, -deepest["at"]).otherwise(0).alias("line"))
    return df.withColumn("indent_nesting", F.when(~plain_name(F.col("language_key")).isin(*NO_INDENT_NESTING), nesting)).drop("__steps", "__unit")


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 0), raw and trimmed text of each line."""
    return files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_END, -1)).alias("line", "raw")).withColumn("trimmed", trimmed(F.col("raw")))


def code_lines(files: DataFrame) -> DataFrame:
    """path and ``code``, an array of line and raw text of the lines that are neither blank nor comments. Rows are independent."""
    df = files.select("path", comment_prefixes(F.col("language_key")).alias("__p"), lines_of(F.coalesce("text", F.lit(""))).alias("__l"))
    entry = lambda l, i: F.struct(i.cast("int").alias("line"), l.alias("raw"), trimmed(l).alias("t"))  # noqa: E731, E741
    return df.select("path", F.filter(F.transform("__l", entry), lambda x: (x["t"] != "") & ~starts_with_any(x["t"], F.col("__p"))).alias("code"))


def token_lists(files: DataFrame) -> DataFrame:
    """path and ``words``, an array of line and token over the code lines of each file. Rows are independent."""
    per_line = F.transform("code", lambda x: F.transform(F.regexp_extract_all(x["raw"], F.lit(TOKEN), F.lit(0)), lambda t: F.struct(x["line"].alias("line"), t.alias("token"))))
    return settled(code_lines(files).select("path", F.flatten(per_line).alias("words")), "words")


def token_bags(files: DataFrame) -> DataFrame:
    """path, ``words`` (the tokens of the code lines) and ``sloc``, where lines don't matter: tokens don't cross line ends, so one pass over the joined lines finds them all."""
    df = code_lines(files)
    words = F.regexp_extract_all(F.array_join(F.transform("code", lambda x: x["raw"]), "\n"), F.lit(TOKEN), F.lit(0))
    return settled(settled(df, "code").select("path", words.alias("words"), F.size("code").cast("long").alias("sloc")), "words", "sloc")


def tokens(files: DataFrame) -> DataFrame:
    """path, pos (from 0), line and token over the code lines of each file."""
    return token_lists(files).select("path", F.posexplode("words").alias("pos", "x")).select("path", "pos", "x.line", "x.token")
