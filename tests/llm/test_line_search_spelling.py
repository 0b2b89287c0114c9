"""Line dedup, ranked search and spelling variants against plain versions of what they are to give."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import line_dedup, ranked_search, spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed: int, n: int, alphabet: str = "abcé") -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7)))
    lines = [" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(30)]
    pad = lambda s: rng.choice(["", " ", "\t", "\r"]) + (s.upper() if rng.random() < 0.2 and s.isascii() else s) + rng.choice(["", " ", "\r"])
    rows = [(i * 3 - 5, "\n".join(pad(rng.choice(lines)) for _ in range(rng.randint(1, 6)))) for i in range(n)]
    return [*rows, (900, None), (901, ""), (902, "\n"), (903, "\n\n"), (904, "x" * 3000 + "\n" + lines[0])]


# --- line dedup


def plain_lines(docs: list[tuple]) -> list[tuple]:
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(UPPER)
    place = lambda d: math.inf if d is None else d
    held = defaultdict(set)
    for d, text in docs:
        for line in (text or "").split("\n"):
            held[key(line)].add(place(d))
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == place(d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("far", [False, True])
def test_lines_equal_brute_force(spark, monkeypatch, far):
    if far:  # the arrays stay where they are, in several shards, and hot shards are answered in pieces
        for name, value in (("FEW_BYTES", -1), ("SHARD_LINES", 4), ("PROBES", 3)):
            monkeypatch.setattr(line_dedup, name, value)
    docs = corpus(1, 60) + corpus(2, 5)[:3] + [(None, "a line of no document\nshared by many of them"), (None, "shared by many of them"), (77, "Shared by many of them "), (78, "shared by many of them")]
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    got = rows_of(line_dedup.drop_repeated_lines(df))
    assert got == plain_lines(docs)
    assert any(r[2] for r in got)


def test_lines_edges(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    same = [(1, "one line that repeats itself\none line that repeats itself")] * 3
    assert [r["n_dropped"] for r in line_dedup.drop_repeated_lines(spark.createDataFrame(same, SCHEMA)).collect()] == [0, 0, 0]
    odd = spark.createDataFrame([(1, "a repeated long line", "x"), (2, "a repeated long line\nend", "y")], "doc_id int, text string, shard string")
    got = line_dedup.drop_repeated_lines(odd, keep_text=True).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == ["a repeated long line", "end"]
    three = spark.createDataFrame([(i, "held by three of them") for i in range(3)] + [(i, "held by two of them") for i in (4, 5)], SCHEMA)
    assert [r["n_dropped"] for r in line_dedup.drop_repeated_lines(three, least=3).orderBy("doc_id").collect()] == [0, 1, 1, 0, 0]
    with pytest.raises(ValueError, match="integer"):
        line_dedup.drop_repeated_lines(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_perfect_slots():
    rng = np.random.RandomState(3)
    x, y = (rng.randint(0, 1 << 62, 5000).astype(np.uint64) for _ in range(2))
    x[:50] = x[0]  # equal first hashes are told apart by the second
    slots = line_dedup.PerfectSlots.build(x, y)
    assert sorted(slots.find(x, y).tolist()) == list(range(5000))
    assert len(slots.bits) * 64 < 6 * 5000
    shard = line_dedup.Shard.unpack(line_dedup.Shard.build(x, y, np.arange(5000), np.arange(5000) + 7).pack())
    count, first = shard.probe(np.concatenate((x, x + np.uint64(1))), np.concatenate((y, y)))
    assert count[:5000].tolist() == list(range(5000)) and (first[5000:] == line_dedup.LAST).all()
    empty = line_dedup.Shard.build(*[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 2)
    assert empty.probe(x[:2], y[:2])[0].tolist() == [0, 0]


# --- ranked search


def plain_search(docs: list[tuple], items: list[tuple], top: int) -> list[tuple]:
    terms = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    size, words = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, bag in bags:
            m = 50 + 50 * bag.total() * size // words
            s = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if bag[t])
            if s > 0:
                scores.append((-s, math.inf if d is None else d, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2])[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    if small:  # many clusters, levels, rounds and blocks of queries
        for name, value in (("CLUSTER", 4), ("ARRANGED", 32), ("SAMPLE", 40), ("FIRST_VISITS", 1), ("GROWTH", 2), ("QUERY_TERMS", 8), ("COLUMNS", 3), ("QUERIES", 2), ("CLUSTER_POSTINGS", 12)):
            monkeypatch.setattr(ranked_search, name, value)
    docs = corpus(4, 150, "abé1") + [(1000 + i, "abé equal texts tie") for i in range(12)] + [(None, "abé equal texts tie"), (5000, "-- ..")]
    items = [(i, t) for i, (_, t) in enumerate(corpus(5, 8, "abé1"))] + [(50, "equal ties tie"), (51, "nowhere"), (52, None), (53, "a b é 1 a")]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = ranked_search.ranked_search(df, spark.createDataFrame(items, "item_id long, text string"), 7)
    assert rows_of(got) == plain_search(docs, items, 7)


def test_search_stops_early(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "CLUSTER", 8)
    monkeypatch.setattr(ranked_search, "FIRST_VISITS", 2)
    visited = []
    scores = ranked_search.cluster_bounds

    def bounds(clusters, queries):
        out = scores(clusters, queries)
        visited.append((clusters.count(), out.count()))
        return out

    monkeypatch.setattr(ranked_search, "cluster_bounds", bounds)
    rng = random.Random(8)
    topics = [[f"t{k}w{i}" for i in range(20)] for k in range(8)]
    docs = [(i, " ".join(rng.choice(topics[i % 8]) for _ in range(30))) for i in range(640)]
    items = [(k, " ".join(topic[:6])) for k, topic in enumerate(topics)]
    got = rows_of(ranked_search.ranked_search(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), 5))
    assert got == plain_search(docs, items, 5) and all(item == d % 8 for item, _, d, _ in got)
    clusters, bounded = visited[0]
    assert clusters > 60 and bounded < 8 * clusters / 3  # bisection has put a topic's documents together: a query can't score in the other clusters


def test_bisection_puts_like_documents_together():
    rng = np.random.RandomState(0)
    kind = rng.permutation(np.arange(64) % 2)
    terms = np.concatenate([rng.choice(20, 8, False) + 20 * k for k in kind])
    right, _, _ = ranked_search.bisect(np.repeat(np.arange(64), 8), terms, 64)
    assert abs(kind[right].mean() - 0.5) > 0.45 and right.sum() == 32
    order = ranked_search.arrange(np.arange(0, 513, 8), terms, 16)
    assert sorted(order.tolist()) == list(range(64))


def test_search_edges(spark):
    queries, none = "item_id long, text string", spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "a term")], queries)
    assert ranked_search.ranked_search(none, one).collect() == []
    assert ranked_search.ranked_search(spark.createDataFrame([(1, "a term")], SCHEMA), spark.createDataFrame([], queries)).collect() == []
    assert ranked_search.ranked_search(spark.createDataFrame([(1, None), (2, "..")], SCHEMA), one).collect() == []
    odd = spark.createDataFrame([("x", "rare term", 3), ("y", "other", 4)], "doc_id string, text string, cluster int")
    assert [(r["rank"], r["doc_id"]) for r in ranked_search.ranked_search(odd, one).collect()] == [(1, "x")]


# --- spelling variants


def plain_variants(docs: list[tuple]) -> list[tuple]:
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, out = {}, []
    for w in words:
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = (best if best and words[best] >= 2 * words[w] else None, len(others))
    for w, (form, n_near) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, form, root, words[w], n_near, words[form] if form else None))
    return sorted(out, key=repr)


def spellings(seed: int, words: int, texts: int) -> list[tuple]:
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcéñÿ") for _ in range(rng.randint(4, 7))) for _ in range(words)]
    base += [w[:i] + c + w[i + (rng.random() < 0.5) :] for w in base for i, c in [(rng.randrange(len(w)), rng.choice("abé"))]]
    weights = [1 / (k + 1) for k in range(len(base))]
    rng.shuffle(weights)
    docs = [(i, " ".join(rng.choices(base, weights, k=80)) + rng.choice(["", "X", " Éa1b×c"])) for i in range(texts)]
    docs.append((2000, "winding " * 4 + "wending " * 9 + "wendings " * 19 + "tending " * 20))  # forms that lead on to others
    return [*docs, (None, docs[0][1]), (3, None), (4, ""), (9, "q" * 500 + " " + "q" * 499 + " zzzz " * 3), (10, ("q" * 500 + " " + "q" * 499 + " ") * 3)]


@pytest.mark.parametrize("block", [4096, 5])
def test_variants_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    if block == 5:
        monkeypatch.setattr(spelling, "PAIRS", 64)
        monkeypatch.setattr(spelling, "COUNTED", 20)
    docs = spellings(6, 60, 60)
    want = plain_variants(docs)
    assert rows_of(spelling.spelling_variants(spark.createDataFrame(docs, SCHEMA).repartition(4))) == want
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)


def test_variants_edges(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = spark.createDataFrame([(1, "apples apples apples apple's", "n"), (2, "apples apples applet applet applet applet", "m")], "doc_id int, text string, word string")
    got = {r["word"]: r for r in spelling.spelling_variants(odd).collect()}
    assert set(got) == {"apples", "applet"} and got["applet"]["form"] is None and got["apples"]["n_near"] == 1


def test_checksums_and_masks():
    text = "abcéÿ".encode()
    body = np.frombuffer(text, np.uint8)
    got = spelling.checksums(body, np.array([0, 1, 3]), np.array([7, 3, 3]), np.array([zlib.crc32(b"12:"), 0, 5], np.uint32))
    assert got.tolist() == [zlib.crc32(b"12:" + text), zlib.crc32(b"bc"), 5]
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    for _ in range(200):
        word = "".join(rng.choice(letters) for _ in range(8))
        i = rng.randrange(8)
        for other in (word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i + 1 :]):
            data = np.frombuffer((word + other).encode(), np.uint8)
            codes, starts = spelling.letters(np.array([0, len(word.encode()), len(data)]), data)
            a, b = spelling.masks(codes, starts)
            assert int(a ^ b).bit_count() <= 2
            assert any((a ^ b) >> np.uint64(21 * k) & np.uint64((1 << 21) - 1) == 0 for k in range(3))
