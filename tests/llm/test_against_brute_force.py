"""Operators without SQL against plain Python: aliases, features of stored texts, language predictions, curve order."""

from __future__ import annotations

import hashlib
import io
import os
import random
import zlib
from bisect import bisect_right
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hilbert_shards, language_id, media, url_filter

SF = "/root/testdata/sf0.01"


def test_random_aliases(spark):
    rng = random.Random(21)
    hosts = ["a.net", "b.example.com", "c.org", "d.io", "e.io", "f.example.net"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['de/', 'en/', 'fr/', 'x/'])}{i}" for i in range(120)]
    edges = [(rng.choice(urls), rng.choice([*urls, f"http://out.io/{rng.randrange(9)}", "http://gone.net/", "nowhere", None])) for _ in range(90)] * 2 + [(u, u) for u in urls[:3]]
    parent: dict[str, str] = {}

    def root(u):
        while parent.setdefault(u, u) != u:
            u = parent[u]
        return u

    for u, v in edges:
        if v and "://" in v and u != v:
            parent[root(u)] = root(v)

    def own(u):
        host, path = u.split("://")[1].split("/", 1)
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith(f".{r.host}")) and f"/{path}".startswith(r.path)]
        return max(fits, key=lambda r: len(r.name)).verdict if fits else None

    want = {}
    for u in urls:
        verdict, cause = own(u), "rule"
        if verdict is None:
            others = {own(v) for v in list(parent) if v != u and root(v) == root(u)}
            verdict = "allow" if "allow" in others or "block" not in others else "block"
            cause = f"alias {verdict}" if others & {"allow", "block"} else "none"
        want[u] = (verdict, cause)
    pages = spark.createDataFrame([(u, "x") for u in [*urls, *urls[:4]]], "url string, host string").repartition(3)
    got = url_filter.judge_urls(pages, spark.createDataFrame(edges, "source string, target string")).collect()
    assert len(got) == len(urls) + 4
    assert {r["url"]: (r["verdict"], r["cause"]) for r in got} == want
    assert {c for _, c in want.values()} == {"rule", "alias allow", "alias block", "none"}
    assert url_filter.judge_urls(pages.where("false"), url_filter.page_edges(spark.createDataFrame([], "url string, html string"))).collect() == []


def mean_under(pixels, height, width):
    """Each target pixel is the mean of the area under it, by fractions."""
    rows, cols, bands = pixels.shape
    out = np.zeros((height, width, bands))
    for y in range(height):
        for x in range(width):
            top, bottom, left, right = Fraction(y * rows, height), Fraction((y + 1) * rows, height), Fraction(x * cols, width), Fraction((x + 1) * cols, width)
            total = [Fraction(0)] * bands
            for i in range(floor(top), ceil(bottom)):
                for j in range(floor(left), ceil(right)):
                    part = (min(bottom, i + 1) - max(top, i)) * (min(right, j + 1) - max(left, j))
                    total = [t + part * int(v) for t, v in zip(total, pixels[i, j], strict=True)]
            out[y, x] = [float(t / ((bottom - top) * (right - left))) for t in total]
    return out


def test_features_of_texts(spark):
    rng = random.Random(22)
    texts = ["", "short", "".join(chr(rng.randrange(32, 900)) for _ in range(700)), "abc " * 500]
    rows = [(i, t, "mine") for i, t in enumerate(texts)] + [(None, None, "x"), (1, "short", "y")]
    got = media.text_media(spark.createDataFrame(rows, "doc_id long, text string, dhash string").repartition(3)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    for r in got:
        raw = (texts[r["doc_id"]] if r["doc_id"] is not None else "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        pixels = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
        tile = np.load(io.BytesIO(bytes(r["tile_npy"])))
        assert np.abs(tile - mean_under(pixels, media.TILE, media.TILE)).max() <= 0.5 + 1e-6
        small = np.rint(mean_under(pixels, 8, 9)).astype(int)
        grey = (299 * small[:, :, 0] + 587 * small[:, :, 1] + 114 * small[:, :, 2]) // 1000
        bits = "".join(str(int(a > b)) for line in grey for a, b in zip(line, line[1:]))  # noqa: RUF007
        assert bin(int(r["dhash"], 16) ^ int(bits, 2)).count("1") <= 1  # a mean that ends in a half may be rounded either way
    long = "long text, " * 200_000
    r = media.text_media(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert (r["n_bytes"], r["payload_sha256"]) == (len(long), hashlib.sha256(long.encode() + b" " * (-len(long) % 192)).hexdigest())


def brute_vector(text, dimensions):
    letters = language_id.letter_vectors(dimensions).astype(float)
    table = language_id.symbols()
    s = [0]
    for c in text.lower():
        k = int(table[ord(c)])
        if k or s[-1]:
            s.append(k)
    if s[-1]:
        s.append(0)
    return sum((np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(s, s[1:], s[2:])), np.zeros(dimensions))


def test_predictions(spark):
    rng = random.Random(23)
    words = {"aa": "the of and thing over with", "bb": "der und die nicht über mit", "cc": "la les des avec où à", "dd": "la les des avec où à"}
    train = [(lang, " ".join(rng.choices(w.split(), k=rng.randrange(1, 9)))) for lang, w in words.items() for _ in range(5)]
    train = [x for x in train if x[0] != "dd"] + [("dd", t) for lang, t in train if lang == "cc"]  # two languages that no text tells apart
    docs = spark.createDataFrame([*train, (None, "the the"), ("aa", None)], "lang string, text string").repartition(3)
    names, vectors = language_id.prototypes(docs, F.lit(True), dimensions=256)
    want = {k: sum(brute_vector(t, 256) for lang, t in train if lang == k) for k in words}
    assert names == sorted(words)
    assert all((v == want[k]).all() for k, v in zip(names, vectors, strict=True))
    unit = {k: v / np.linalg.norm(v) for k, v in want.items()}
    mean = sum(unit.values()) / len(unit)
    texts = [None, "", "12 $", "thing", "über die", "LES Où", "x", "the " * 300_000, *(" ".join(rng.choices(" ".join(words.values()).split(), k=4)) for _ in range(60))]
    rows = [(i, t, "a", 7.0, "c") for i, t in enumerate(texts)]
    got = language_id.identify(spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, lang_pred string, score double, source string").repartition(4), names, vectors).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        v = brute_vector(texts[r["doc_id"]] or "", 256)
        if not any(c.isalpha() for c in texts[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        near = {k: v @ (u - mean) / np.linalg.norm(u - mean) / np.linalg.norm(v) for k, u in unit.items()}
        assert near[r["lang_pred"]] == pytest.approx(max(near.values()), abs=1e-9)
        assert r["lang_pred"] != "dd"  # the first by name of equal ones
        assert r["score"] == pytest.approx(np.clip(v @ unit[r["lang_pred"]] / np.linalg.norm(v), 0, 1), abs=1e-9)
    assert language_id.identify(spark.createDataFrame([], "text string"), names, vectors).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_held_out_accuracy(spark):
    got = language_id.op6_hyperdimensional_lang(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r["lang_pred"] == r["lang"] for r in got if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(held) > 100
    assert np.mean(held) >= 0.95


def test_curve_order(spark):
    rng = random.Random(24)
    rows = [(i, rng.choice(["hot"] * 3 + [f"s{k}" for k in range(9)]), rng.choice([None, "en", "de"]), rng.choice([None, rng.randrange(1000)]), "mine", 5) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, size long, part string, place int").repartition(5)
    got = {r["doc_id"]: r for r in hilbert_shards.hilbert_shards(df, ["source", "lang", "size"], ["doc_id"], 24, 3).collect()}
    columns = [[("+" + r[k] if r[k] is not None else "") for r in rows] for k in (1, 2)] + [[r[3] if r[3] is not None else -(1 << 62) for r in rows]]
    cells = []
    for values in columns:
        order, n = sorted(values), len(values)
        cuts = sorted({order[max(ceil(k * n / 8) - 1, 0)] for k in range(1, 8)})
        cells.append([bisect_right(cuts, v) for v in values])
    index = hilbert_shards.hilbert_index(np.array(cells).T, 3).tolist()
    for place, i in enumerate(sorted(range(len(rows)), key=lambda i: (index[i], i))):
        shard = place * 24 // len(rows)
        assert (got[i]["hilbert"], got[i]["shard"], got[i]["slot"]) == (index[i], shard, place - ceil(shard * len(rows) / 24)), i
        assert (got[i]["part"], got[i]["place"]) == ("mine", 5)


def test_curve_prunes_files(spark):
    """A shard's least and greatest values leave out most shards for a condition on any one dimension, unlike an order by id."""
    rng = random.Random(25)
    rows = [(i, rng.randrange(1000), rng.randrange(1000)) for i in range(6000)]
    out = hilbert_shards.hilbert_shards(spark.createDataFrame(rows, "doc_id long, x long, y long"), ["x", "y"], ["doc_id"], 64)
    bounds = out.groupBy("shard").agg(*(f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("low", F.min), ("high", F.max)))).collect()
    for c in ("x", "y"):
        read = [sum(b[f"low_{c}"] <= v <= b[f"high_{c}"] for b in bounds) for v in range(0, 1000, 50)]
        assert np.mean(read) < 64 / 4
