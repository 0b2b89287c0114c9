"""Benchmark decontamination by greedy string tiling.

Seeds, runs of five words that a document and a test item share, are joined; only pairs that share enough of them for the
coverage asked for are tiled, by running Karp-Rabin hashes. A document is its text: equal texts are looked at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_VALUE, bounded_batches, chunks, durable, mix, range_hash, range_sums, shingle_hashes, texts_of

#: Shortest match, in words, that becomes a tile.
LEAST = 5
#: Share of a test item's words under tiles from which a document is contaminated.
COVERAGE = 0.8
#: Words of 64 bits of the filter of seeds that travels to the documents: 8 MB, whatever the benchmark's size.
FILTER_WORDS = 1 << 20
#: Pairs of equal runs that a round of tiling holds at once; beyond, it goes word by word.
PAIRS = 1 << 20
#: Leaks up to which the result travels to the documents; beyond, documents are dealt by text.
FEW_LEAKS = 100_000

#: ASCII letters and digits, and all bytes of other characters, make words.
_PART = np.zeros(256, bool)
_PART[48:58] = _PART[97:123] = _PART[128:] = True


def chunk_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the texts in lower case, and which text it is in; words are runs of ASCII letters, digits and non-ASCII characters."""
    low = [t.decode("utf-8", "replace").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join([*low, b""]), np.uint8)
    edge = np.diff(np.concatenate(([False], _PART[data], [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = mix(range_hash(range_sums(BYTE_VALUE[data]), starts, ends) + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(np.cumsum([len(t) + 1 for t in low]), starts, "right")


def word_values(text: bytes) -> np.ndarray:
    return chunk_words([text])[0]


def seeds_of(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; runs of different widths have different hashes."""
    return mix(shingle_hashes(words, width) + np.uint64(width))


def filter_places(seeds: np.ndarray, words: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Two places in the filter for each seed: word and bit."""
    n = np.uint64(words)
    return ((seeds >> np.uint64(6)) % n, seeds & np.uint64(63)), ((seeds >> np.uint64(34)) % n, (seeds >> np.uint64(28)) & np.uint64(63))


def _windows(words: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of s unmarked words, and their running Karp-Rabin hashes modulo 2^64."""
    n = len(words) - s + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = range_sums(words)
    taken = np.concatenate(([0], np.cumsum(~free)))
    at = np.flatnonzero(taken[s:] == taken[:-s])
    return at, range_hash(sums, at, at + s)


def _longest(item: np.ndarray, text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, least: int) -> tuple[int, list[tuple[int, int]]]:
    """The greatest length of a common unmarked run of ``least`` words or more, and where runs of it begin, by item and text."""
    at_i, hash_i = _windows(item, free_i, least)
    at_t, hash_t = _windows(text, free_t, least)
    near = np.isin(hash_t, hash_i)
    at_t, hash_t = at_t[near], hash_t[near]
    order = np.argsort(hash_t, kind="stable")
    at_t, hash_t = at_t[order], hash_t[order]
    low, high = np.searchsorted(hash_t, hash_i, "left"), np.searchsorted(hash_t, hash_i, "right")
    count = high - low
    total = int(count.sum())
    if not total:
        return 0, []
    if total <= PAIRS:
        p = np.repeat(at_i, count)
        t = at_t[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(total)]
        order = np.lexsort((p, t - p))
        p, t = p[order], t[order]
        # equal runs that follow each other on a diagonal are one match
        head = np.flatnonzero(np.concatenate(([True], (np.diff(t - p) != 0) | (np.diff(p) != 1))))
        length = np.diff(np.concatenate((head, [total]))) + least - 1
        most = int(length.max())
        p, t = p[head[length == most]], t[head[length == most]]
    else:  # many repeated words: the match that ends at each word of the text, for one word of the item after the other
        run, most, found = np.zeros(len(text) + 1, np.int32), least, []
        for i in range(len(item)):
            now = np.zeros(len(text) + 1, np.int32)
            if free_i[i]:
                now[1:] = np.where((text == item[i]) & free_t, run[:-1] + 1, 0)
            run, top = now, int(now.max())
            if top > most:
                most, found = top, []
            if top == most:
                ends = np.flatnonzero(run == most)
                found.append((np.full(len(ends), i + 1 - most), ends - most))
        p, t = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((t, p))
    return most, list(zip(p[order].tolist(), t[order].tolist(), strict=True))


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Non-overlapping common runs (start in item, start in text, length), longest first.

    Each round hashes all runs of ``least`` unmarked words on both sides, joins equal ones to matches as long as they go,
    and marks those of the greatest length, from the left, that no tile of this round overlaps; rounds end when
    nothing of ``least`` words is left. Order of tiles in item and text is free, so reordered passages are covered.
    """
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    while True:
        most, best = _longest(item, text, free_i, free_t, least)
        if not best:
            return tiles
        for p, t in best:
            if free_i[p : p + most].all() and free_t[t : t + most].all():
                free_i[p : p + most] = free_t[t : t + most] = False
                tiles.append((p, t, most))


def covered(item: np.ndarray, text: np.ndarray, least: int = LEAST, coverage: float = COVERAGE) -> tuple[int, int, int] | None:
    """Words of the item under tiles, tiles, and the longest, if they cover enough."""
    width = min(least, len(item))
    shared = np.isin(seeds_of(item, width), seeds_of(text, width))
    if (np.convolve(shared, np.ones(width, int))[: len(item)] > 0).sum() < coverage * len(item):  # tiles lie within shared seeds
        return None
    tiles = greedy_tiles(item, text, width)
    total = sum(n for _, _, n in tiles)
    return (total, len(tiles), max(n for _, _, n in tiles)) if total and total >= coverage * len(item) else None


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """iid (a number of the row), item_id and the hashes of its words, of each item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts_of(batch.column(2))
            for a, b in chunks(offsets):
                words, owner = chunk_words([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)])
                ends = np.searchsorted(owner, np.arange(b - a + 1), "left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), pa.ListArray.from_arrays(pa.array(ends), pa.array(words.view(np.int64)))], names=["iid", "item_id", "words"])

    rows = benchmark.select(F.monotonically_increasing_id().alias("iid"), "item_id", "text")
    made = rows.mapInArrow(run, f"iid long, item_id {benchmark.schema['item_id'].dataType.simpleString()}, words array<long>")
    return durable(made.where(F.size("words") > 0))


def item_seeds(items: DataFrame, least: int, coverage: float) -> DataFrame:
    """seed, iid, width and need: a document that contains the item has at least ``need`` of these rows.

    A tile of n words has n - w + 1 >= n / w seeds of w words, so of an item's seeds a document shares a part of at least
    coverage / w. Half of that part, less one, may be left out: the seeds that most items have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for iid, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                item = words.values.to_numpy().view(np.uint64)
                width = min(least, len(item))
                seeds = seeds_of(item, width)
                n = len(seeds)
                share = max(1, math.ceil(math.ceil(coverage * len(item) - 1e-9) / width))
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), *(pa.array(np.full(n, x, np.int64)) for x in (iid, width, share))], names=["seed", "iid", "width", "share"])

    every = durable(items.select("iid", "words").mapInArrow(run, "seed long, iid long, width long, share long"))
    frequent = every.groupBy("seed").agg(F.count(F.lit(1)).alias("f"))
    least_out = F.expr("(share + 1) div 2 - 1")
    ordered = every.join(frequent, "seed").groupBy("iid", "width", "share").agg(F.sort_array(F.collect_list(F.struct("f", "seed"))).alias("s"))
    kept = F.slice("s", F.lit(1), (F.size("s") - least_out).cast("int"))
    return durable(ordered.select("iid", "width", (F.col("share") - least_out).alias("need"), F.explode(kept).alias("x")).select(F.col("x.seed").alias("seed"), "iid", "width", "need"))


def seed_filter(seeds: DataFrame, words: int) -> np.ndarray:
    """A Bloom filter of fixed size over the seeds, built by an aggregate; at most ``words`` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, bit in filter_places(batch.column(0).to_numpy().view(np.uint64), words):
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array((np.uint64(1) << bit).view(np.int64))], names=["word", "bits"])

    found = seeds.select("seed").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _may_contain(seeds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    (w1, b1), (w2, b2) = filter_places(seeds, len(bits))
    return ((bits[w1] >> b1) & (bits[w2] >> b2) & np.uint64(1)).astype(bool)


_TEXT = ["__text_1", "__text_2"]


def leaks_by_text(texts: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """__text_1, __text_2 and leaks, of texts(__text_1, __text_2, text) that contain a test item."""
    spark = texts.sparkSession
    items = benchmark_items(benchmark)
    seeds = item_seeds(items, least, coverage)
    shared = spark.sparkContext.broadcast((seed_filter(seeds, FILTER_WORDS), sorted(r["width"] for r in seeds.select("width").distinct().collect())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, widths = shared.value
        for batch in batches:
            offsets, data = texts_of(batch.column(2))
            for a, b in chunks(offsets):
                words, owner = chunk_words([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)])
                hit = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
                for width in widths:
                    h = seeds_of(words, width)
                    if len(h):
                        inside = _may_contain(h, bits) & (owner[: len(h)] == owner[width - 1 :])
                        hit.append((owner[: len(h)][inside], h[inside]))
                text, seed = (np.concatenate(x) for x in zip(*hit, strict=True))
                if not len(text):
                    continue
                order = np.lexsort((seed, text))
                text, seed = text[order], seed[order]
                first = np.concatenate(([True], (text[1:] != text[:-1]) | (seed[1:] != seed[:-1])))
                text, seed = text[first], seed[first]
                rows, count = np.unique(text, return_counts=True)
                low, high = np.searchsorted(owner, rows, "left"), np.searchsorted(owner, rows, "right")
                for lo in range(0, len(rows), 256):
                    part = slice(lo, lo + 256)
                    ends = np.concatenate(([0], np.cumsum(count)))[lo : lo + 256 + 1]
                    spans = np.concatenate(([0], np.cumsum((high - low)[part])))
                    body = np.concatenate([words[x:y] for x, y in zip(low[part].tolist(), high[part].tolist(), strict=True)])
                    at = pa.array(rows[part] + a)
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(at) for c in batch.columns[:2]), pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(seed[ends[0] : ends[-1]].view(np.int64))), pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), pa.array(body.view(np.int64)))],
                        names=[*_TEXT, "seeds", "words"],
                    )

    hits = durable(texts.mapInArrow(run, "__text_1 long, __text_2 long, seeds array<long>, words array<long>").dropDuplicates(_TEXT))
    shares = hits.select(*_TEXT, F.explode("seeds").alias("seed")).join(seeds.select("seed", "iid", "need"), "seed").groupBy(*_TEXT, "iid", "need").agg(F.count(F.lit(1)).alias("n"))
    pairs = shares.where("n >= need").select(*_TEXT, "iid")
    both = pairs.join(hits.select(*_TEXT, "words"), _TEXT).join(items.select("iid", "item_id", F.col("words").alias("item")), "iid").select(*_TEXT, "item_id", "words", "item")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for i, (text, item) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                text, item = (x.values.to_numpy().view(np.uint64) for x in (text, item))
                got = covered(item, text, least, coverage)
                if got:
                    keep.append(i)
                    found.append((got[0], len(item), got[1], got[2]))
            counts = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(keep, pa.int64())) for c in batch.columns[:3]), *counts], names=[*_TEXT, "item_id", *_COUNTS])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    tiled = both.mapInArrow(tile, f"__text_1 long, __text_2 long, item_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS))
    return durable(tiled.groupBy(_TEXT).agg(F.sort_array(F.collect_list(F.struct("item_id", *_COUNTS))).alias("leaks")))


_COUNTS = ["covered", "item_words", "tiles", "longest"]


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, out: str = "leaks") -> DataFrame:
    """docs with an array of the test items that the whole text contains: item_id, covered, item_words, tiles, longest, in this order.

    An item counts if tiles of at least ``least`` words cover at least ``coverage`` of its words; a shorter item must
    occur as a whole. Case and punctuation don't matter. Null and empty texts have no leaks, null, empty and wordless
    items match nothing; repeated items are reported each, repeated rows alike. Empty tables on either side give no
    leaks. Only texts that a filter of fixed size lets through go into the join of seeds; documents get the result by
    two 64-bit hashes of their texts, broadcast while it is small. All columns are kept; one named like the output is
    replaced, and __text_1 and __text_2 are names that docs may not have.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() != out.lower()]
    told = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*names, "text"])), F.xxhash64("text").alias(_TEXT[0]), F.xxhash64(F.lit(1), F.col("text")).alias(_TEXT[1]))
    leaks = leaks_by_text(told.select(*_TEXT, "text"), benchmark, least, coverage).withColumnRenamed("leaks", "__leaks")
    few = (leaks.agg(F.sum(F.size("__leaks"))).first()[0] or 0) <= FEW_LEAKS
    joined = told.join(F.broadcast(leaks) if few else leaks, _TEXT, "left")
    none = F.array().cast(leaks.schema["__leaks"].dataType)
    return joined.select(*(F.col(f"`{c}`") for c in names), F.coalesce("__leaks", none).alias(out))


def op3_string_tiling(spark, sf_dir: str) -> DataFrame:
    """One row for each document and each test item that it contains."""
    from tessera.llm.common import table

    leaks = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*", (F.col("x.covered") / F.col("x.item_words")).alias("coverage"))
