"""URL filters, style trees, near duplicates, sharding, repeated strings and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import importlib.util
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, hilbert_shards, minhash, style_tree, suffix_dedup, url_filter


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, k) for k in range(201, 240)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    parent = list(range(400))
    for u, v in edges:
        a, b = find(parent, u), find(parent, v)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges * 2, "u long, v long")).collect()}
    assert got == {n: find(parent, n) for u, v in edges if u != v for n in (u, v)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_url_parts_and_rules(spark):
    rows = ["http://A.Example.NET/en/x?q=/de/#f", "https://example.com/de/", "https://x.org/fr/1", "https://net/", "http://b.net", "no scheme", None, "http://org/de/", "ftp://example.com?x://y/de/", "http://notexample.com/de/x"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(rows)], "page_id long, url string, verdict string")
    r = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.judge_urls(df, spark.createDataFrame([], "source string, target string")).collect()}
    assert r == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.com", "/de/", "example.com/de/", "block"), 2: ("x.org", "/fr/1", "org/fr/", "allow"), 3: ("net", "/", "net/", "block"),
        4: ("b.net", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("org", "/de/", None, "allow"), 8: ("example.com", "", None, "allow"), 9: ("notexample.com", "/de/x", None, "allow"),
    }


def test_aliases(spark):
    link = lambda u: f'<html><head><link rel="canonical" href="{u}"></head>'
    rows = [
        (1, "http://free.example/a", link("http://bad.net/x")), (2, "http://free.example/b", '<META http-equiv=refresh content="0; url=/a">'), (3, "http://bad.net/x", ""),
        (4, "http://two.example/", link("http://x.org/fr/ok") + link("http://bad.net/y")), (5, "http://free.example/c", f"<!-- {link('http://bad.net/x')} -->"), (6, "http://own.org/fr/z", link("http://bad.net/x")), (7, None, link("http://bad.net/x")), (8, "http://free.example/a#part", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    r = {x["page_id"]: (x["verdict"], x["cause"]) for x in url_filter.judge_urls(pages, url_filter.page_edges(pages)).collect()}
    assert r[3] == ("block", "rule")
    assert r[6] == ("allow", "rule")
    # 6 is an alias of bad.net/x, and its explicit allow holds for all aliases without a rule of their own
    assert (r[1], r[2], r[8]) == (("allow", "alias allow"),) * 3
    assert (r[4], r[5], r[7]) == (("allow", "alias allow"), ("allow", "none"), ("allow", "none"))
    fewer = pages.where("page_id <> 6")
    r = {x["page_id"]: (x["verdict"], x["cause"]) for x in url_filter.judge_urls(fewer, url_filter.page_edges(fewer)).collect()}
    assert (r[1], r[2], r[8]) == (("block", "alias block"),) * 3


PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>Home<li>About</ul></nav><div class='cookie-notice'>We use</div><div id=sidebar>Side</div>{}<section class='comments'><article class='comment'>Nice</article></section><form>Mail<input></form><footer>&copy; x</footer>"


def test_main_text():
    m = style_tree.main_text
    assert m(PAGE.format("<article><h1>Head &amp; line</h1><p>One\n two<br>three <b>bold</b><p>Next&nbsp;one<script>var a='</p>';</script></article>")) == "Head & line\nOne two three bold\nNext one"
    assert m(PAGE.format("<div><p>Body</p></div>")) == "Body"
    assert m(PAGE.format("<main><p>In</p><aside>x</aside></main><p>Out</p>")) == "In"
    assert m("") == m("<html>") == m("<nav>x") == ""
    assert m("<p>a &lt;b&gt; < c") == "a <b> < c"
    assert m("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>") == "x\ny\n1\n2"
    assert m("<p>cut off <a hre") == "cut off"


def test_style_tree_cuts_what_all_pages_share(spark):
    page = lambda i: f"<body><div class=top><span>Same words on all pages</span></div><div class=box><p>Text number {i}</p><p>More {i * 7}</p></div></body>"
    rows = [(i, f"http://Site.example/{i}", page(i)) for i in range(20)] + [(100, "http://small.example/", page(3)), (101, None, None), (102, "http://site.example/x", "")]
    r = {x["page_id"]: x["text"] for x in style_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert r[5] == "Text number 5\nMore 35"
    assert r[100] == "Text number 3\nMore 21"  # too few pages of the host, but all hosts' tree knows
    assert (r[101], r[102]) == ("", "")


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(220):
        k = rng.random()
        if k < 0.5:
            t = " ".join(passage + [rng.choice(words) for _ in range(rng.randrange(10, 60))])
        elif k < 0.8:
            w = passage + passage[::-1]
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        else:
            t = rng.choice([None, "", "a b", "A  b", "x", " ".join(passage), " ".join(rng.choice(words) for _ in range(40))])
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("small", [8, 2])
def test_near_duplicates(spark, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "FIRST_SHARE", small)
    monkeypatch.setattr(minhash, "ALL_AT_ONCE", 4096 if small == 8 else 0)
    rows = near_rows()
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*rows, (None, "a b"), (3, rows[3][1])], "doc_id long, text string").withColumn("kept", F.lit("mine")).repartition(3)
    got = minhash.near_duplicate_classes(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, False)
        else:
            label = find(parent, r["doc_id"])
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label, label == r["doc_id"])


def test_min_max_estimate():
    rng = np.random.RandomState(6)
    a = rng.randint(0, 1 << 62, 2000).astype(np.uint64)
    b = np.concatenate((a[:1500], rng.randint(0, 1 << 62, 500).astype(np.uint64)))
    s = minhash.signatures(np.concatenate((np.unique(a), np.unique(b))), np.array([0, len(np.unique(a))]), 500)
    assert np.mean(s[0] == s[1]) == pytest.approx(1500 / 2500, abs=0.05)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert minhash.near_duplicate_classes(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert hilbert_shards.hilbert_shards(none, ["source", "lang"], ["doc_id"]).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3)])
def test_hilbert_curve(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = hilbert_shards.hilbert_index(points, bits)
    assert sorted(index.tolist()) == list(range(len(points)))
    steps = np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(1)
    assert (steps == 1).all()  # neighbours on the curve are neighbours in space


def test_shards(spark):
    rows = [(i, "x" * (i % 50), "hot" if i % 3 else f"s{i % 7}", None if i % 11 == 0 else "en") for i in range(500)] + [(7, None, None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("size", F.length("text")).repartition(6)
    got = hilbert_shards.hilbert_shards(df, ["source", "lang", "size"], ["doc_id"]).collect()
    by: dict[int, list[int]] = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by[s]) for s in range(24)]
    assert sum(counts) == 505
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in order] == sorted(r["hilbert"] for r in got)


def brute_repeats(rows, n=100):
    """Results in the order of the rows."""
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            gone[i : i + n] |= w in seen
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def removed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("doc", "n_bytes", "copies", "key")}).repartition(5)
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(df).collect()), key=str)


def repeats_rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.choice([120, 300, 900]))) for _ in range(6)]
    return [(i, "".join(rng.choice([rng.choice(base)[rng.randrange(100) :][: rng.randrange(90, 400)], "".join(rng.choice("xyé") for _ in range(rng.randrange(60))), "z" * rng.randrange(250)]) for _ in range(rng.randrange(6)))) for i in range(100)] + [(900, None), (901, "short")]


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 16), (5000, 400)])
def test_repeats(spark, sizes, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", sizes[0])
    monkeypatch.setattr(suffix_dedup, "DEALT_BYTES", sizes[1])
    rows = repeats_rows()
    assert removed(spark, rows) == sorted(brute_repeats(rows), key=str)


def test_repeats_are_merged_over_shards(spark):
    """With the constants as they are: a passage in 9,000 documents, in pairs of equal surroundings, is more than a shard."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(140))
    edge = ["".join(rng.choice("ijklmnop ") for _ in range(70)) for _ in range(4500)]
    rows = [(i, edge[i % 4500] + passage + edge[(i * 7 + i // 4500) % 4500]) for i in range(9000)]
    assert 9000 * 170 > suffix_dedup.SHARD_BYTES
    assert removed(spark, rows) == sorted(brute_repeats(rows), key=str)


def test_repeats_of_null_and_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (150, 400, 400))
    assert [x[2] for x in removed(spark, [(1, a + a), (2, b), (7, a + a + "x"), (9, c)])] == [150, 0, 300, 0]
    # one document of a doc_id is judged before the other, and a null comes first
    for first, second in ((None, None), (5, 5)):
        rows = [(first, a + a), (second, b), (7, a + a + "x"), (9, c), (9, None), (9, None), (9, "short"), (9, "short")]
        assert removed(spark, rows) == sorted(brute_repeats(rows), key=str)
    rows = [(5, b), (5, b), (5, b), (4, b[:200]), (None, b[150:])]
    want = brute_repeats([(None, b[150:]), (4, b[:200]), (5, b), (5, b), (5, b)])
    assert removed(spark, rows) == sorted(want, key=str)


def test_repeats_in_very_long_texts(spark, monkeypatch):
    rng = np.random.RandomState(6)
    text = rng.randint(97, 123, (5 << 20)).astype(np.uint8).tobytes().decode()
    cut = (2 << 20) - 50  # over the border of two chunks
    rows = [(1, text), (2, "#" * 30 + text[cut : cut + 300] + "#" * 30), (3, text[100:400] + text[4 << 20 : (4 << 20) + 150])]
    assert [x[1:4] for x in removed(spark, rows)] == [(5 << 20, 0, 0), (360, 300, 1), (450, 450, 1)]


def test_suffix_array_and_prefixes():
    rng = random.Random(8)
    for _ in range(40):
        pieces = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        body = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces])
        starts = np.cumsum(size) - size
        ends = np.repeat(starts + size, size).astype(np.int32)
        suffix = lambda i: body[i : ends[i]].tobytes()  # noqa: E731, B023
        want = sorted(range(len(body)), key=lambda i: (suffix(i), i))
        sa = suffix_dedup.suffix_array(body, ends)
        assert sa.tolist() == want
        shared = suffix_dedup.common_prefixes(body, starts, ends, sa).tolist()
        lcp = [0] + [next((k for k, (x, y) in enumerate(zip(suffix(a), suffix(b), strict=False)) if x != y), min(len(suffix(a)), len(suffix(b)))) for a, b in zip(want, want[1:])]  # noqa: RUF007
        assert shared == lcp


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = "one two three four five six seven eight nine ten eleven twelve"
    base = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [
        (1, base, "en", "s", 1), (2, base, "en", "s", 1), (3, base.replace("wordaa", "other"), "en", "s", 1), (4, "123 456", "en", "s", 1), (5, None, "en", "s", 1), (6, f"before {item} after", "en", "s", 1),
        (8, "keep this plain text with password = abcdefghijklmnop inside", "en", "s", 1), (9, "clean words stay as they are", "en", "s", 1), (None, "a row without a number", "en", "s", 1), (9, "clean words stay as they are", "en", "s", 1),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted((r["doc_id"] for r in docs.collect()), key=str))
    first = [1, 2, 3, 6, 8, 9, 9, None]
    assert kept == [first, [1, 6, 8, 9, None], [1, 8, 9, None], [1, 8, 9, None]]
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    assert text[8] == ("keep this plain text with [secret] inside", 41)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 8, 9, None}


def test_bands_follow_the_similarity():
    assert minhash.bands_for(85) == (minhash.BANDS, minhash.ROWS) == (44, 9)
    for percent in (1, 50, 80, 85, 90, 99, 100):
        bands, rows = minhash.bands_for(percent)
        assert (1 - (min(percent, 99) / 100) ** rows) ** bands <= 1e-5
        assert bands * rows <= 2 * len(minhash._FLIP)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline_links_near_copies_from_80_percent(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(104)]
    text = lambda tail, k: " ".join([*words[: 104 - k], *(f"{tail}{i}" for i in range(k))])
    rows = [(1, " ".join(words)), (2, text("b", 10)), (3, text("c", 12))]  # 90 of 110 shingles are 0.818, 88 of 112 are 0.786
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()} == {1, 3}


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline_keeps_each_text_of_a_repeated_id(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(104)]
    rows = [
        (1, " ".join(words), "b"), (1, "a text that is no copy of anything else", "s"), (2, " ".join([*words[:100], "x", "y", "z", "q"]), "s"), (1, " ".join(words), "a"),
        (3, "another text that stands here once only", "s"), (3, "Another text that stands here once only", "s"), (4, "and one more that is alone as well", "s"),
    ]
    docs = spark.createDataFrame([(i, t, None, s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted((r["doc_id"], r["text"].lower(), r["source"]) for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert got == sorted([(1, rows[0][1], "a"), (1, rows[1][1], "s"), (3, rows[4][1], "s"), (4, rows[6][1], "s")])


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline_without_any_language(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "plain words", None), (2, "12 34", None), (3, None, None), (4, "Ünï", None), (5, "", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect()} == {1, 4}


@pytest.mark.parametrize("few", [100_000, 0])
def test_style_tree_counts_copies_once(spark, few, monkeypatch):
    monkeypatch.setattr(style_tree, "FEW_COPIES", few)
    page = lambda i: f"<body><article><h1>Head {i}</h1><p>Text of article {i}</p></article></body>"
    bare = lambda i: f"<body><div class=box><p>Text of page {i}</p></div></body>"
    rows = [(i, f"http://one.example/{i}", page(1)) for i in range(30)] + [(100 + i, f"http://two.example/{i}", page(i % 2)) for i in range(200)] + [(400 + i, f"http://bare.example/{i}", bare(i % 3)) for i in range(60)]
    r = {x["page_id"]: x["text"] for x in style_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert {r[i] for i in range(30)} == {"Head 1\nText of article 1"}
    assert {r[100 + i] for i in range(200)} == {f"Head {k}\nText of article {k}" for k in range(2)}
    assert {r[400 + i] for i in range(60)} == {f"Text of page {k}" for k in range(3)}
    trees = style_tree.style_trees(spark.createDataFrame([*rows, *[(500 + i, f"http://many.example/{i // 3}", page(i // 3)) for i in range(30)]], "page_id long, url string, html string").repartition(5))
    assert {(x["host"], x["pages"]) for x in trees.where("importance IS NOT NULL").collect() if x["host"] != style_tree.ALL} == {("many.example", 10)}


def test_cuts_leave_the_article():
    html = "<body><div><article><h1>Head</h1><p>Text</p></article></div></body>"
    paths = {n.path for b, _ in style_tree.parse(html)[1] for n in style_tree._ancestors(b)}
    heading, text = (b.path for b, _ in style_tree.parse(html)[1])
    assert style_tree.main_text(html, paths, paths) == style_tree.main_text(html, paths) == "Head\nText"
    assert style_tree.main_text(html, (), paths - {heading}) == "Head"
    assert style_tree.main_text(html, (), {text}) == "Head"
    bare = html.replace("article", "section")
    paths = {n.path for b, _ in style_tree.parse(bare)[1] for n in style_tree._ancestors(b)}
    text = style_tree.parse(bare)[1][1][0].path
    assert style_tree.main_text(bare, {text}) == "Head"
    assert style_tree.main_text(bare, paths) == "Head\nText"


def test_style_tree_judges_rare_templates_of_a_large_host(spark):
    section = lambda i: f"<body><div class=strip><span>Same words in this section</span></div><div class=text><p>Section text {i}</p></div></body>"
    other = lambda i: f"<body><div class=box><p>Text {i}</p></div></body>"
    rows = [(i, f"http://large.example/{i}", section(i) if i < 9 else other(i)) for i in range(1200)] + [(2000 + i, f"http://own.example/{i}", section(i)) for i in range(9)]
    r = {x["page_id"]: x["text"] for x in style_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert r[500] == "Text 500"
    assert all(r[i] == r[2000 + i] == f"Section text {i}" for i in range(9))


def test_style_tree_goes_up_level_by_level(spark):
    rng = random.Random(3)
    page = lambda i: "<body>" + "".join(f"<div class={rng.choice('abc')}><ul><li>{rng.choice(['same', str(rng.random())])}</li></ul><p>{rng.randrange(4)}</p></div>" for _ in range(rng.randrange(1, 5))) + f"<p>{i}</p></body>"
    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", page(i)) for i in range(80)]
    got = {(x["host"], x["path"]): (x["pages"], x["importance"]) for x in style_tree.style_trees(spark.createDataFrame(rows, "page_id long, url string, html string")).where("importance IS NOT NULL").collect()}
    want = {}
    for host in ("a.example", "b.example", style_tree.ALL):
        count, parent = {}, {}
        for _, url, html in rows:
            for (path, above, kind, feature), words in style_tree.page_features(html).items() if host in (style_tree.ALL, style_tree.host_of(url)) else ():
                have = count.setdefault(path, ({}, {}))[kind % 2].setdefault(feature, [0, 0.0])
                have[0], have[1], parent[path] = have[0] + 1, have[1] + words, above
        m = {p: n for p, n in ((p, sum(k for k, _ in looks.values())) for p, (looks, _) in count.items()) if n >= 8}

        def up(p):
            looks, contents = count[p]
            below = [up(c) + (m[c],) for c in m if parent[c] == p]
            parts = [(own, n) for own, _, n in below]
            if contents:
                parts.append((1 - min(1, sum(w * np.log(k) for k, w in contents.values()) / sum(w for _, w in contents.values()) / np.log(m[p])), m[p]))
            look = sum(k / m[p] * np.log(m[p] / k) for k, _ in looks.values()) / np.log(m[p])
            w = 0.9 ** len(looks)
            own = (1 - w) * look + w * (sum(a * b for a, b in parts) / sum(b for _, b in parts) if parts else 1)
            most = max([own, *(x[1] for x in below)])
            want[host, style_tree._signed(p)] = (m[p], pytest.approx(most))
            return own, most

        up(next(p for p in m if parent[p] == 0))
    assert got == want


def words_of(text):
    return Counter(text.split())


def test_style_trees_find_the_articles_without_the_prior(spark):
    """Without class names, nav, footer or article to go by, the trees' cuts leave the articles; the prior has little to add."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    alone = {r["page_id"]: r["text"] for r in style_tree.extract_main_text(pages, prior=False).collect()}
    both = {r["page_id"]: r["text"] for r in style_tree.extract_main_text(pages).collect()}
    right = got = want = 0
    for i, text in both.items():
        a, b = words_of(alone[i]), words_of(text)
        right, got, want = right + (a & b).total(), got + a.total(), want + b.total()
    assert 2 * right / (got + want) > 0.99
    share = style_tree.tree_share(pages).agg(F.sum("removed"), F.sum("by_tree")).first()
    assert share[1] > 0.9 * share[0]


def test_style_tree_edge_rows(spark):
    schema = "page_id long, url string, html string, host string, low string, text string"
    page = "<body><div class=top>Same words on all pages</div><p>Own text</p></body>"
    rows = [(1, "http://a.example/", page, "x", "y", "z"), (1, "http://a.example/", page, "x", "y", "z"), (None, None, None, None, None, None), (2, "", "", "", "", ""), (3, "http://a.example/", "<p>" + "long text " * 300_000, "", "", "")]
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in style_tree.extract_main_text(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([*[(1, "http://a.example/", "Same words on all pages\nOwn text")] * 2, (None, None, ""), (2, "", ""), (3, "http://a.example/", ("long text " * 300_000).strip())], key=str)
    assert style_tree.extract_main_text(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("few", [500_000, -1])
def test_few_or_many_cuts(spark, few, monkeypatch):
    monkeypatch.setattr(style_tree, "FEW_CUTS", few)
    page = lambda i: f"<body><div class=top>Same words on all pages</div><div class=box><p>Text number {i}</p></div></body>"
    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", page(i)) for i in range(40)]
    assert {r["page_id"]: r["text"] for r in style_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {i: f"Text number {i}" for i in range(40)}


def test_main_text_keeps_what_is_in_the_article():
    m = style_tree.main_text
    for name in ("article-header", "entry-header", "notice", "promo-text"):
        assert m(f"<article><div class='{name}'><h1>Head</h1><p>Lead</p></div><p>Text</p></article>") == "Head\nLead\nText"
    for name in ("legal", "social-history", "related-work", "search"):
        assert m(f"<main><h1>Head</h1><section class='{name}'><p>Text</p></section></main>") == "Head\nText"
    assert m("<article><div class='share'><p>By</p><h1>Head</h1></div><div class='share'>Send it</div><p>Text</p><div id=comments><h1>Comments</h1><p>x</p></div><div class=ads>x</div></article>") == "By\nHead\nText"
    assert m("<article><div class='comments' hidden><h1>Head</h1></div><p>Text</p></article>") == "Text"
    assert m("<div class='related-work'><p>x</p></div><p>Text</p>") == "Text"
    assert m("<article><figure><img src=a><figcaption>A caption</figcaption></figure><p>Let <math><mi>x</mi><mo>=</mo><mspace width='1em'/><mn>2</mn><annotation>x = 2</annotation></math> be.</p></article>") == "A caption\nLet x=2 be."
    assert m("<p><span style='display:none'>x</span>Visible <b hidden>y</b>text</p>") == "Visible text"
    assert m("<p><span class='notice'>Note:</span> text</p>") == "text"
    assert m("<article><p><span class='notice'>Note:</span> text</p></article>") == "Note: text"
    assert m("<nav><p>x</p><b>y</b></nav><p>Text</p>") == "Text"


def test_shards_tell_long_names_apart(spark):
    rows = [(i, f"https://{'abcd'[i % 4]}.example/", "en") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string").repartition(5)
    cells: dict[str, set[int]] = {}
    for r in hilbert_shards.hilbert_shards(df, ["source", "lang"], ["doc_id"], 4).collect():
        cells.setdefault(r["source"], set()).add((r["hilbert"], r["shard"]))
    assert len(cells) == 4
    assert all(len(c) == 1 for c in cells.values())
    assert len(set.union(*cells.values())) == 4


def test_text_bounds(spark):
    rng = random.Random(8)
    values = ["hot"] * 150 + [f"common-prefix-{rng.randrange(200)}" for _ in range(250)] + [chr(rng.randrange(32, 0x3000)) for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    order = sorted(values)
    assert hilbert_shards.text_bounds(df, "v", 4) == sorted({order[-(-k * len(order) // 16) - 1] for k in range(1, 16)})
    assert hilbert_shards.text_bounds(df.where("false"), "v", 4) == []
