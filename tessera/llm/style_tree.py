"""Main text of web pages by site style trees.

The element trees of a host's pages are merged by path; a node is important if its presentation (the sequence of child
elements) varies over pages, and a leaf if its contents do. Importance goes up the tree, and branches of low importance
are cut out of each page. The pages of all hosts make one more tree, for menus and adverts that few pages of a host, but
many of the web, repeat, and for hosts with few pages. A branch is as important as the lower of the two says. What
markup itself says (nav, footer, scripts, forms, some class names, and article or main around the text) is a prior
for what neither tree can judge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, durable

#: Branches whose importance, and that of all below them, is less are cut: such branches of an article or main, and others.
LEAST_WITHIN, LEAST_IMPORTANCE = 0.2, 0.85
#: Weight of what lies below a node, to the power of its number of presentations.
DAMPING = 0.9
#: A host's node is judged if at least so many of its pages have it, else by the tree of all hosts.
LEAST_PAGES = 8
#: Words of a run by which contents are compared, and runs of a block that are, those of least hash.
RUN, RUNS = 5, 2
#: Stands for all hosts where a host stands; no host holds it.
ALL = "/"
#: Cut paths, over all hosts, up to which they travel to the pages; beyond, pages are dealt by host.
FEW_CUTS = 500_000

#: Copied pages of up to so many different contents travel to the pages; beyond, pages are dealt by content.
FEW_COPIES = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is code or is never shown.
RAW = frozenset("script style noscript template svg iframe object canvas textarea title annotation annotation-xml".split())
#: Elements that hold no main text, by their meaning in HTML.
OUTSIDE = frozenset("head nav footer aside form button select option dialog menu".split()) | RAW
#: Formulas run on in their paragraph; an annotation repeats one as code.
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | MATH
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Start tags that end an open element of these names, up to the container.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role that name parts around the main text.
PRIOR = frozenset(
    "ad ads advert adverts advertisement banner sponsored promo nav navbar menu breadcrumb breadcrumbs sidebar footer header "
    "cookie consent notice popup newsletter subscribe share related comment comments".split()
)

#: Those that name such parts within article or main, too, where the others name parts of the text.
PRIOR_WITHIN = frozenset("ad ads advert adverts advertisement share comment comments newsletter subscribe".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_NAMED = re.compile(r"""(?i)(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"(?i)</{t}\s*>") for t in RAW}


class Node:
    """``why`` says what by itself puts an element outside the main text: its meaning ("tag"), its class ("word") or that it isn't shown ("hidden")."""

    __slots__ = ("children", "depth", "key", "parent", "path", "tag", "why")

    def __init__(self, tag: str, key: str, parent: Node | None, why: str):
        self.tag, self.key, self.parent, self.why, self.children = tag, key, parent, why, []
        self.path = xxhash.xxh64_intdigest(key, parent.path if parent else 0)
        self.depth = parent.depth + 1 if parent else 0

    @property
    def off(self) -> bool:
        return any(x.why for x in _ancestors(self))


def _attributes(raw: str) -> tuple[str, set[str], bool]:
    names, words, hidden = [], set(), False
    for k, v in _NAMED.findall(raw):
        k, v = k.lower(), v.strip("\"'").lower()
        if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none", v)):
            hidden = True
        elif k in ("class", "id", "role"):
            found = _WORDS.findall(v)
            words.update(found)
            if k != "role":
                names.append(f"{k}={'-'.join(found)}")
    return " ".join(names), words, hidden


def parse(html: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The root, and the blocks of text in order, each with the element that it lies in.

    Missing end tags, a page that is cut off, and stray end tags are taken as browsers do, as far as blocks go. White
    space in a block, line breaks included, becomes one blank; empty blocks are dropped, as are the parts of a block
    in inline elements that are off. The first h1 of an article or main puts all that holds it in the text.
    """
    root = Node("#root", "#root", None, "")
    stack, pieces = [root], []
    text: list[tuple[Node, str]] = []
    home, headed = root, False

    def flush() -> None:
        if text:
            pieces.append((home, text.copy()))
            text.clear()

    def pop(n: int) -> None:
        if any(x.tag not in INLINE for x in stack[n:]):
            flush()
        del stack[n:]

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            rest = html[at:]
            cut = re.search(r"<(?:[A-Za-z/!?][^>]*)?$", rest)  # the page ends within a tag
            piece = rest[: cut.start()] if cut else rest
            if piece:
                if not text:
                    home = _block(stack)
                text.append((stack[-1], piece))
            break
        if m.start() > at:
            if not text:
                home = _block(stack)
            text.append((stack[-1], html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if tag == "br":
            text.append((stack[-1], " ")) if text else None
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in IMPLIED:
            ends, within = IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in within:
                    break
                if stack[i].tag in ends:
                    pop(i)
                    break
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        named, words, hidden = _attributes(m[3]) if m[3] else ("", (), False)
        top = stack[-1]
        within = any(x.tag in ("article", "main") for x in stack)
        why = "hidden" if hidden else "tag" if tag in OUTSIDE or (tag == "header" and not within) else ""
        if not why and tag == "article":
            why = "word" if {"comment", "comments", "reply", "related", "ad", "advert", "promo", "teaser"}.intersection(words) else ""
        elif not why and tag not in ("html", "body", "main", "h1"):
            why = "word" if (PRIOR_WITHIN if within else PRIOR).intersection(words) else ""
        if tag == "h1" and within and not headed:
            headed = True
            for x in reversed(stack):
                if x.tag in ("article", "main"):
                    break
                if x.why != "hidden":
                    x.why = ""
        node = Node(tag, f"{tag} {named}" if named else tag, top, why)
        if tag not in INLINE:
            top.children.append(node)
        if m[3].endswith("/") and (tag == "svg" or tag in MATH):
            continue
        if tag in RAW:
            end = _END[tag].search(html, at)
            at = end.end() if end else size
            continue
        stack.append(node)
    flush()
    blocks = []
    for home, parts in pieces:
        shown = {n: not any(x.why for x in _until(n, home)) for n in {n for n, _ in parts}}
        words = unescape("".join([t for n, t in parts if shown[n]])).split()
        if words:
            blocks.append((home, " ".join(words)))
    return root, blocks


def _block(stack: list[Node]) -> Node:
    for x in reversed(stack):
        if x.tag not in INLINE:
            return x
    return stack[0]


def _ancestors(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _until(node: Node, end: Node) -> Iterator[Node]:
    while node is not end:
        yield node
        node = node.parent


def _judged(html: str, low: frozenset[int], low_within: frozenset[int], prior: bool) -> list[tuple[set[str], str, bool, bool]]:
    """Of each block that is text at all: the elements around it, its text, whether the tree cuts it, and whether the prior puts it outside."""
    _, blocks = parse(html)
    seen = []
    for node, text in blocks:
        tags, cut, within, off = set(), False, False, False
        above = list(_ancestors(node))
        article = any(x.tag in ("article", "main") for x in above)
        for x in above:
            tags.add(x.tag)
            within = within or x.tag in ("article", "main")
            cut = cut or (not within and x.path in (low_within if article else low) and x.tag not in ("#root", "html", "body"))
            off = off or bool(x.why) and (prior or x.why == "hidden" or x.tag in RAW or x.tag == "head")
        if prior or not off:
            seen.append((tags, text, cut, off))
    return seen


def main_text(html: str, low: frozenset[int] | set[int] = frozenset(), low_within: frozenset[int] | set[int] = frozenset(), prior: bool = True) -> str:
    """The page's main text: blocks of important branches, within article (or else main) where there is one with text.

    What is cut in an article or main is cut by branches within it; where cuts take all text, it stays. Without the
    prior only what is never shown and the tree's cuts go.
    """
    seen = [(tags, text, cut) for tags, text, cut, off in _judged(html, low, low_within, prior) if not off]
    for around in ("article", "main") if prior else ():
        there = [(text, cut) for tags, text, cut in seen if around in tags]
        if there:
            return "\n".join([t for t, cut in there if not cut] or [t for t, _ in there])
    return "\n".join([t for _, t, cut in seen if not cut] or [t for _, t, _ in seen])


def removed_by_tree(html: str, low: frozenset[int] | set[int], low_within: frozenset[int] | set[int]) -> tuple[int, int]:
    """Blocks of shown text that main_text() leaves out, and how many of them the tree alone would."""
    seen = _judged(html, low, low_within, True)
    kept = main_text(html, low, low_within)
    lines = kept.split("\n") if kept else []
    gone = [cut for _, text, cut, _ in seen if text not in lines]
    return len(gone), sum(gone)


def _content(text: str) -> list[int]:
    words = text.split()
    if len(words) <= RUN:
        return [xxhash.xxh64_intdigest(text)]
    return sorted({xxhash.xxh64_intdigest(" ".join(words[i : i + RUN])) for i in range(len(words) - RUN + 1)})[:RUNS]


def page_features(html: str) -> dict[tuple[int, int, int, int], float]:
    """(path, path of the parent, 2 * depth, presentation): 0 for each element path, and (path, parent, 2 * depth + 1, run of words): its share of the words, for leaf texts."""
    root, blocks = parse(html)
    styles: dict[tuple[int, int, int], set[str]] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        todo += node.children
        runs = [c.key for i, c in enumerate(node.children) if i == 0 or node.children[i - 1].key != c.key]
        styles.setdefault((node.path, node.parent.path if node.parent else 0, 2 * node.depth), set()).add("\n".join(runs))
    out = {(p, q, kind, xxhash.xxh64_intdigest("\0".join(sorted(s)))): 0.0 for (p, q, kind), s in styles.items()}
    for n, t in blocks:
        runs = _content(t)
        for run in runs:
            key = (n.path, n.parent.path if n.parent else 0, 2 * n.depth + 1, run)
            out[key] = out.get(key, 0.0) + len(t.split()) / len(runs)
    return out


_signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
_HOST = re.compile(r"(?s)^.*?://([^/?#]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _host_column() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def style_trees(pages: DataFrame) -> DataFrame:
    """host (ALL for the tree of all hosts), path, parent, pages, importance (null where too few pages have it) of each element.

    A page counts a feature once, and equal pages, of a host or of all, count as one: each of n copies adds 1 / n. Tasks
    add up their own pages' counts before the shuffle, counts meet by feature, then by path, so a host with a third of
    all pages is spread over tasks. A presentation's entropy is taken to the base of the number of pages m. A content
    is compared by runs of words; one that k pages have counts ln k / ln m, weighed by the words that it stands for.
    Importance goes up the tree by one round for each level: a level's nodes meet the sums over their judged children by
    host and path, so no task holds a host. Rounds are as many as the deepest judged path is long; each is kept durably.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[tuple, list[float]] = {}
            for url, html, n, all_n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                host = host_of(url)
                for f, words in page_features(html or "").items():
                    for site, copies in ((host, n or 1), (ALL, all_n or 1)):
                        have = count.setdefault((site, *f), [0.0, 0.0])
                        have[0] += 1 / copies
                        have[1] += words / copies
            if count:
                host, path, parent, kind, feature = zip(*count, strict=True)
                k, words = zip(*count.values(), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(host, pa.string()), *(pa.array(list(map(_signed, x)), pa.int64()) for x in (path, parent)), pa.array(kind, pa.int32()), pa.array(list(map(_signed, feature)), pa.int64()), pa.array(k, pa.float64()), pa.array(words, pa.float64())],
                    names=["host", "path", "parent", "kind", "feature", "k", "words"],
                )

    told = pages.select("url", "html", F.xxhash64(_host_column(), "html").alias("same1"), F.xxhash64("html", _host_column()).alias("same2"), F.xxhash64("html").alias("any1"), F.xxhash64(F.lit(1), F.col("html")).alias("any2"))
    weighed = told
    for same, name in ((["same1", "same2"], "n"), (["any1", "any2"], "all_n")):
        copies = durable(told.groupBy(same).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1))
        weighed = weighed.join(F.broadcast(copies) if copies.count() <= FEW_COPIES else copies, same, "left")
    features = weighed.select("url", "html", "n", "all_n").mapInArrow(run, "host string, path long, parent long, kind int, feature long, k double, words double")
    shared = features.groupBy("host", "path", "parent", "kind", "feature").agg(F.greatest(F.round(F.sum("k")), F.lit(1.0)).alias("k"), F.sum("words").alias("words"))
    look, content = F.col("kind") % 2 == 0, F.col("kind") % 2 == 1
    nodes = durable(shared.groupBy("host", "path", "parent").agg(
        F.sum(F.when(look, F.col("k"))).cast("long").alias("pages"), F.count(F.when(look, 1)).alias("looks"), F.sum(F.when(look, F.col("k") * F.log("k"))).alias("look_sum"),
        F.sum(F.when(content, F.col("words"))).alias("contents"), F.sum(F.when(content, F.col("words") * F.log("k"))).alias("content_sum"), F.max(F.expr("kind div 2")).alias("depth"),
    ))
    log_pages = F.log("pages")
    judged = durable(nodes.where(F.col("pages") >= LEAST_PAGES).select(
        "host", "path", "parent", "pages", "depth", F.pow(F.lit(DAMPING), "looks").alias("w"), (1 - F.col("look_sum") / F.col("pages") / log_pages).alias("look"),
        F.when(F.col("contents") > 0, 1 - F.least(F.lit(1.0), F.col("content_sum") / F.col("contents") / log_pages)).alias("content"),
    ))
    deepest = judged.agg(F.max("depth")).first()[0]
    tree = below = judged.where("false").select("host", "path", "parent", "pages", F.lit(0.0).alias("own"), F.lit(0.0).alias("importance"))
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        sums = below.groupBy("host", F.col("parent").alias("path")).agg(F.sum(F.col("own") * F.col("pages")).alias("part"), F.sum("pages").alias("weight"), F.max("importance").alias("most"))
        level = judged.where(F.col("depth") == depth).join(sums, ["host", "path"], "left")
        part = F.coalesce("part", F.lit(0.0)) + F.coalesce(F.col("content") * F.col("pages"), F.lit(0.0))
        weight = F.coalesce("weight", F.lit(0)) + F.when(F.col("content").isNotNull(), F.col("pages")).otherwise(0)
        mean = F.when(weight > 0, part / weight).otherwise(1.0)  # neither text nor judged children: no reason to cut
        own = (1 - F.col("w")) * F.col("look") + F.col("w") * mean
        below = durable(level.withColumn("own", own).select("host", "path", "parent", "pages", "own", F.greatest("own", "most").alias("importance")))
        tree = tree.union(below)
    return nodes.select("host", "path", "parent", "pages").join(tree.select("host", "path", "importance"), ["host", "path"], "left")


def cut_paths(trees: DataFrame, least_importance: float = LEAST_IMPORTANCE, least_within: float = LEAST_WITHIN) -> DataFrame:
    """host, low and low_within: the paths of its elements whose importance, the lower of the host's tree's and that of all hosts, is less."""
    every = trees.where(F.col("host") == ALL).select("path", F.col("importance").alias("anywhere"))
    here = trees.where(F.col("host") != ALL).join(every, "path", "left").select("host", "path", F.least("importance", "anywhere").alias("importance"))
    low = here.where(F.col("importance") < max(least_importance, least_within))
    paths = lambda least: F.array_sort(F.collect_set(F.when(F.col("importance") < least, F.col("path"))))
    return low.groupBy("host").agg(paths(least_importance).alias("low"), paths(least_within).alias("low_within"))


def with_cuts(pages: DataFrame, *columns: str) -> DataFrame:
    """The columns of pages, html, low and low_within."""
    cuts = durable(cut_paths(style_trees(pages)))
    few = (cuts.agg(F.sum(F.size("low"))).first()[0] or 0) <= FEW_CUTS
    return pages.select(*columns, "html", _host_column().alias("host")).join(F.broadcast(cuts) if few else cuts, "host", "left").select(*columns, "html", "low", "low_within")


def _path_sets(lows: list[pa.Array]) -> Iterator[tuple[frozenset[int], ...]]:
    """The sets of each row; rows of a host have the same, and a host's follow each other often."""
    seen: dict[bytes, frozenset[int]] = {}
    for row in zip(*lows, strict=True):
        out = []
        for paths in row:
            raw = np.zeros(0, np.int64) if paths.values is None else np.asarray(paths.values)
            key = raw.tobytes()
            if key not in seen:
                if len(seen) > 256:
                    seen.clear()
                seen[key] = frozenset(raw.view(np.uint64).tolist())
            out.append(seen[key])
        yield tuple(out)


def extract_main_text(pages: DataFrame, prior: bool = True) -> DataFrame:
    """page_id, url and text (the main text, blocks joined by a line feed) of each page.

    A null or empty page has an empty text; a null url belongs to the host with an empty name; repeated rows are
    extracted alike; an empty table gives one; other columns are not read. Each page of a host carries all cuts of the
    host, which are broadcast while they are few; else pages meet them by host, and Spark splits a hot one.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "", low, within, prior) for html, (low, within) in zip(batch.column(2), _path_sets([batch.column(3), batch.column(4)]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return with_cuts(pages, "page_id", "url").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")


def tree_share(pages: DataFrame) -> DataFrame:
    """page_id, removed and by_tree: blocks of shown text outside the main text, and those of them that the trees cut by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [removed_by_tree(html.as_py() or "", low, within) for html, (low, within) in zip(batch.column(1), _path_sets([batch.column(2), batch.column(3)]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(2))], names=["page_id", "removed", "by_tree"])

    return with_cuts(pages, "page_id").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, removed long, by_tree long")


def op2_style_tree(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
