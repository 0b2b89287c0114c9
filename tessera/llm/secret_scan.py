"""Secret scans with a trigram index: Boolean trigram queries derived from each regex pick candidates, which are then verified.

Everything is a DataFrame or SQL function. index_postings() makes the inverted index, a posting (trigram, text) for each
trigram that a rule asks for, where a text goes by two 64-bit hashes, so copies share their postings. candidates()
intersects the postings of each rule's query. Only candidates are verified; rules without a mandatory trigram look at
every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable

#: Candidates up to which they travel to the texts; beyond, texts are dealt by hash.
FEW_CANDIDATES = 300_000


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed by contract. hex matches whole runs, of which those of 16 and more count, so the run's length stands in the pattern.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Public formats of further credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES

# --- Boolean trigram queries -------------------------------------------------------------------------------------------
# A query is True (every text may match), a trigram, or ("and" | "or", parts).


def _both(parts: list):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(parts: list):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


class _Regex:
    """A regex as branches of items: ("char", c), ("any",) for one of several characters, ("edge",) for what takes none,
    ("group", branches), and ("repeat", least, most, item)."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0
        self.branches = self.either()
        if self.at < len(pattern):
            raise ValueError(f"unbalanced parenthesis in {pattern!r}")

    def see(self, text: str) -> bool:
        if not self.pattern.startswith(text, self.at):
            return False
        self.at += len(text)
        return True

    def either(self) -> list[list[tuple]]:
        out = [self.sequence()]
        while self.see("|"):
            out.append(self.sequence())
        return out

    def sequence(self) -> list[tuple]:
        out = []
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            item = self.atom()
            while (found := _QUANTIFIER.match(self.pattern, self.at)) is not None:
                self.at = found.end()
                sign, least, most = found.groups()
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(sign) or (int(least or 0), int(most) if most else int(least or 0) if most is None else None)
                item = ("repeat", low, high, item)
            out.append(item)
        return out

    def atom(self) -> tuple:
        p = self.pattern
        if self.see("("):
            look = _LOOK.match(p, self.at)
            opened = _OPENED.match(p, self.at)
            self.at = look.end() if look else opened.end() if opened else self.at
            branches = self.either()
            if not self.see(")"):
                raise ValueError(f"unbalanced parenthesis in {p!r}")
            return ("edge",) if look else ("group", branches)
        if self.see("["):
            found = _CLASS.match(p, self.at)
            if found is None:
                raise ValueError(f"unfinished class in {p!r}")
            self.at = found.end()
            return ("any",)
        if self.see("\\"):
            code = _CODE.match(p, self.at)
            if code:
                self.at = code.end()
                return ("char", chr(int(code[1] or code[2], 16)))
            c = p[self.at]
            self.at += 1
            return ("edge",) if c in "bBAZz" else ("char", {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}.get(c, c)) if not c.isalnum() or c in "tnrf" else ("any",)
        c = p[self.at]
        self.at += 1
        return ("any",) if c == "." else ("edge",) if c in "^$" else ("char", c)


_QUANTIFIER = re.compile(r"(?:([*+?])|\{(\d*)(?:,(\d*))?\})[?+]?")
_LOOK = re.compile(r"\?<?[=!]")
_OPENED = re.compile(r"\?(?:[a-zA-Z-]*:|P?<\w+>|>)")
_CLASS = re.compile(r"\^?\]?(?:\\.|[^\]\\])*\]", re.S)
_CODE = re.compile(r"x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})")


def _derive(items: list[tuple]) -> object:
    found, run = [], ""

    def close() -> None:
        nonlocal run
        found.extend(run[i : i + 3] for i in range(len(run) - 2))
        run = ""

    def walk(items: list[tuple]) -> None:
        nonlocal run
        for item in items:
            if item[0] == "char" and ord(item[1]) < 128:
                run += item[1].lower()
            elif item[0] == "group" and len(item[1]) == 1:
                walk(item[1][0])
            elif item[0] == "group":
                close()
                found.append(_either([_derive(b) for b in item[1]]))
            elif item[0] == "repeat" and item[1] == item[2] == 1:
                walk([item[3]])
            elif item[0] == "repeat" and item[1]:
                close()
                found.append(_derive([item[3]]))
            elif item[0] != "edge":
                close()

    walk(items)
    close()
    return _both(found)


def trigram_query(pattern: str) -> object:
    """What any text with a match must contain, in lower case: True where the regex has no mandatory trigram."""
    return _either([_derive(b) for b in _Regex(pattern).branches])


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


# --- the index ---------------------------------------------------------------------------------------------------------

_WORD = 62
_KEY = ["__text_1", "__text_2"]


def _grams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))


def index_postings(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """trigram, __text_1, __text_2: the inverted index over the rules' trigrams of texts(__text_1, __text_2, __text), each posting once."""
    grams = F.array(*map(F.lit, _grams(rules))).cast("array<string>")
    low = texts.select(*_KEY, F.lower("__text").alias("low"))
    return low.select(F.explode(F.filter(grams, lambda g: F.contains(F.col("low"), g))).alias("trigram"), *_KEY).distinct()


def _fulfils(query, grams: list[str]) -> Column:
    """Whether a text's postings, bit i of column b<j> for trigram 62 j + i, fulfil the query."""
    if isinstance(query, str):
        query = ("and", (query,))
    kind, parts = query
    terms = [_fulfils(p, grams) for p in parts if not isinstance(p, str)]
    masks: dict[int, int] = {}
    for t in (p for p in parts if isinstance(p, str)):
        j, i = divmod(grams.index(t), _WORD)
        masks[j] = masks.get(j, 0) | 1 << i
    for j, mask in masks.items():
        hit = F.col(f"b{j}").bitwiseAND(F.lit(mask).cast("long"))
        terms.append(hit == F.lit(mask) if kind == "and" else hit != 0)
    return reduce(Column.__and__ if kind == "and" else Column.__or__, terms)


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """__text_1, __text_2, rules: the texts whose postings fulfil the query of any rule, and bit r for each such rule r.

    Postings meet by text, combined before the shuffle; a rule without a mandatory trigram has no bit.
    """
    grams, queries = _grams(rules), [trigram_query(r.pattern) for r in rules]
    if not grams:
        return postings.select(*_KEY, F.lit(0).cast("long").alias("rules")).where("false")
    words = []
    for j in range(0, len(grams), _WORD):
        bit = F.element_at(F.create_map(*(F.lit(x) for i, g in enumerate(grams[j : j + _WORD]) for x in (g, 1 << i))), F.col("trigram")).cast("long")
        words.append(F.coalesce(F.bit_or(bit), F.lit(0).cast("long")).alias(f"b{j // _WORD}"))
    bits = [F.when(_fulfils(q, grams), F.lit(1 << r)).otherwise(F.lit(0)).cast("long") for r, q in enumerate(queries) if q is not True]
    return postings.groupBy(*_KEY).agg(*words).select(*_KEY, reduce(Column.bitwiseOR, bits).alias("rules")).where("rules <> 0")


# --- verification ------------------------------------------------------------------------------------------------------


def _spans(rule: Rule, rank: int) -> Column:
    """Spans of a rule in the column __text, as structs of start, rank, kind and end in code points.

    Between matches lies what split() gives, so starts are running sums of lengths.
    """
    pattern = F.lit(rule.pattern)
    between, whole = F.split(F.col("__text"), rule.pattern, -1), F.regexp_extract_all(F.col("__text"), pattern, F.lit(0))
    judged = whole if rule.group == 0 else F.regexp_extract_all(F.col("__text"), pattern, F.lit(rule.group))
    lengths = F.zip_with(F.transform(F.slice(between, F.lit(1), F.size(whole)), F.length), F.zip_with(F.transform(whole, F.length), F.transform(judged, F.length), lambda w, g: F.struct(w.alias("w"), g.alias("g"))), lambda b, m: F.struct(b.alias("b"), m["w"].alias("w"), m["g"].alias("g")))
    span = lambda start, w: F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + w).alias("end"))
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    step = lambda acc, x: F.struct((acc["at"] + x["b"] + x["w"]).alias("at"), F.when(x["g"] >= rule.least, F.concat(acc["spans"], F.array(span(acc["at"] + x["b"], x["w"])))).otherwise(acc["spans"]).alias("spans"))
    return F.aggregate(lengths, zero, step, lambda acc: acc["spans"])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """docs with an array of spans (start, rank of the rule, kind, end) in order of start and rank; texts stay as they are.

    Null and empty texts have no spans. Rows are judged alone, repeated ones alike; an empty table gives one. Lengths are
    code points, ends exclusive. All docs columns are kept, the output column replaces one of its name; __text,
    __text_1, __text_2 and rules are names that docs may not have. Candidates are broadcast while they are few.
    """
    body = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    body = body.withColumns({_KEY[0]: F.xxhash64("__text"), _KEY[1]: F.xxhash64(F.lit(1), F.col("__text"))})
    postings = durable(index_postings(body.select(*_KEY, "__text"), rules))
    found = durable(candidates(postings, rules))
    indexed = body.join(F.broadcast(found) if found.count() <= FEW_CANDIDATES else found, _KEY, "left")
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    spans = []
    for rank, rule in enumerate(rules):
        hit = F.col("__text").rlike(rule.pattern)
        if trigram_query(rule.pattern) is not True:
            hit = (F.coalesce("rules", F.lit(0).cast("long")).bitwiseAND(F.lit(1 << rank).cast("long")) != 0) & hit
        spans.append(F.when(hit, _spans(rule, rank)).otherwise(empty))
    every = F.array_sort(F.concat(*spans), lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["rank"] < b["rank"])), -1).otherwise(1))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    return indexed.select(*kept, every.alias(out))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each span that a rule finds replaced by ``mark``; overlapping spans become one. Texts without any stay byte for byte."""
    body = scan_secrets(docs, rules, text, "__spans")
    merged = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("done")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(s["end"].alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["done"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["done"]).alias("done"))
        ),
        lambda acc: F.concat(acc["done"], F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    return body.withColumn(text, F.when(F.size("__spans") > 0, merged).otherwise(F.col(text))).drop("__spans")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"))


def _sql_spans(rule: Rule, rank: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(len(regexp_extract_all(t, '{p}'))), lambda i: {{
        'start': coalesce(list_sum(list_transform(string_split_regex(t, '{p}')[1:i + 1], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i], lambda x: length(x))), 0)::BIGINT,
        'rank': {rank}, 'kind': '{rule.kind}', 'w': length(regexp_extract_all(t, '{p}')[i + 1]), 'g': length(regexp_extract_all(t, '{p}', {rule.group})[i + 1])}}), lambda m: m.g >= {rule.least})"""


_JOIN = "array_to_string(list_transform({}, lambda m: m.kind || ':' || m.start || ':' || (m.start + m.w)), ',')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, list_sort(list_concat({", ".join(_sql_spans(r, k) for k, r in enumerate(RULES))})) AS every FROM d)
SELECT doc_id, {", ".join(f"len(list_filter(every, lambda m: m.kind = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in BASE_RULES)},
    sha256({_JOIN.format(f"list_filter(every, lambda m: m.rank < {len(BASE_RULES)})")}) AS base_sha256, {_JOIN.format("every")} AS spans
FROM s
"""
