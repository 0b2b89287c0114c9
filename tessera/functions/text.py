"""Column builders for text: the white space, length, hash and number rules of the measured metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The metrics are defined over these patterns.
LINE_END = r"\r?\n"
TOKEN = r"""[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[^\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"""
MARKERS = ("TODO", "FIXME", "HACK", "XXX")
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
#: White space around lines: ASCII's and that beyond, character by character.
_SPACE = " \t\n\x0b\f\r\u00a0\ufeff\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def lines_of(text: Column) -> Column:
    """All lines, the last one included even where it is empty."""
    return F.split(text, LINE_END, -1)


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE))


def starts_with_any(line: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: F.startswith(line, p))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))


def half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(x + 0.5)


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns computed once for each row, whatever is asked of them later.

    They pass through a generator of one row. Filters on a column are otherwise pushed below the projection that makes it,
    with the whole of its expression in them, and what several columns share is made anew for each.
    """
    held = F.explode_outer(F.array(F.struct(*(F.col(f"`{n}`") for n in names)))).alias("__settled")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*rest, held).select(*(F.col(f"__settled.`{c}`") if c in names else F.col(f"`{c}`") for c in df.columns))


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def fnv1a(word: Column) -> Column:
    """32-bit FNV-1a over code points below 65536 (UTF-16 units), as a long."""
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(4294967295))


def indent_width(line: Column) -> Column:
    """Leading blanks, a tab counting four."""
    return F.length(F.replace(F.regexp_extract(line, r"^[ \t]*", 0), F.lit("\t"), F.lit("    ")))


def _holds_any(line: Column, words: tuple[str, ...]) -> Column:
    """Cheaper than a pattern, and before it: most lines hold none."""
    return reduce(Column.__or__, (F.contains(line, F.lit(w)) for w in words))


def marker_of(line: Column, markers: tuple[str, ...] = MARKERS, cap: int = 120) -> Column:
    """The first marker of the line and what follows it, at most ``cap`` characters; null without one."""
    # look-arounds keep the word borders ASCII
    pattern = rf"(?<![A-Za-z0-9_])({'|'.join(markers)})(?![A-Za-z0-9_])[:\s-]*(.*)"
    text = F.concat(F.regexp_extract(line, pattern, 1), F.lit(" "), F.regexp_extract(line, pattern, 2))
    return F.when(_holds_any(line, markers) & line.rlike(pattern), F.substring(trimmed(text), 1, cap))


def marker_column(line: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """Where the first marker of the line starts, from 0."""
    before = rf"^(.*?)(?<![A-Za-z0-9_])(?:{'|'.join(markers)})(?![A-Za-z0-9_])"
    return F.length(F.regexp_extract(line, before, 1))


def glob_regex(glob: str) -> str:
    """An anchored Java regex for a glob: ** crosses folders, * and ? do not, {a,b} and bare commas are alternatives."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out += ".*"
            i += 3 if glob.startswith("**/", i) else 2
            continue
        out += {"*": "[^/]*", "?": "[^/]", "{": "(", "}": ")", ",": "|"}.get(c) or ("\\" + c if c in r".+^$()[]|\\" else c)
        i += 1
    return f"^(?:{out})$"
