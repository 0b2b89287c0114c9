"""Near-duplicate classes by min-max hashing: both the minimum and the maximum under each permutation go into the signature."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, chunks, durable, free, mix, shingle_hashes, shingle_set, texts_of, word_hashes
from tessera.llm.components import connected_components

WORDS = 5
#: Links need 100 * |A and B| >= PERCENT * |A or B|.
PERCENT = 85
#: A pair at exactly the least similarity misses all bands once in so many.
ONE_MISS_IN = 100_000
#: Values of a signature, for all bands together.
MOST_VALUES = 400
#: Buckets of up to so many members are compared all with all, where their members aren't in one component.
SMALL = 8
#: Members of a bucket of prefixes up to which all are compared in the first round, and members that it draws of a larger one.
ALL_AT_ONCE, FIRST_SHARE = 4096, 64
#: Words of 64 bits of a set's parity sketch.
SKETCH = 16
_SKETCH = [f"sketch{i}" for i in range(SKETCH)]


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and rows for a least similarity of percent / 100: the longest bands, and as many of them as ONE_MISS_IN asks for, that fit MOST_VALUES."""
    least = min(max(percent, 1), 99) / 100
    needed = lambda rows: math.ceil(math.log(1 / ONE_MISS_IN) / math.log1p(-(least**rows)))
    rows = max((r for r in range(1, MOST_VALUES + 1) if least**r > 1e-9 and needed(r) * r <= MOST_VALUES), default=1)
    return needed(rows), rows


#: 44 bands of 9 values, from 198 permutations, for a similarity of 0.85.
BANDS, ROWS = bands_for(PERCENT)

_RNG = np.random.RandomState(4711)
_random64 = lambda n: (_RNG.randint(0, 1 << 32, n, dtype=np.uint64) << np.uint64(32)) | _RNG.randint(0, 1 << 32, n, dtype=np.uint64)
_FLIP, _FACTOR = _random64(1024), _random64(1024) | np.uint64(1)


def signatures(values: np.ndarray, starts: np.ndarray, permutations: int) -> np.ndarray:
    """Minimum and maximum of each set under each permutation: sets x 2 permutations. Set i is values[starts[i]:starts[i + 1]], none empty."""
    out = np.empty((len(starts), 2 * permutations), np.uint64)
    for k in range(permutations):
        h = (values ^ _FLIP[k]) * _FACTOR[k]
        out[:, 2 * k] = np.minimum.reduceat(h, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(h, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each set and band; the band's number is part of it."""
    keys = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * rows + r])
        keys[:, b] = h
    return keys


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text in a row, and how many each text has."""
    n = len(offsets) - 1
    body = data[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    # A text ends a word: each gets a blank after it, by moving text i to the right by i.
    spread = np.full(len(body) + n, 32, np.uint8)
    spread[np.arange(len(body)) + np.repeat(np.arange(n), np.diff(at))] = body
    starts, words = word_hashes(spread)
    owner = np.searchsorted(at[1:] + np.arange(1, n + 1), starts, "right")
    per = np.bincount(owner, minlength=n)
    h = shingle_hashes(words, width)
    keep = owner[: len(h)] == owner[width - 1 :][: len(h)] if len(h) else np.zeros(0, bool)
    h, o = h[keep], owner[: len(keep)][keep]
    few = np.flatnonzero((per > 0) & (per < width))
    if len(few):
        extra = np.array([shingle_set(body[at[i] : at[i + 1]], width)[0] for i in few], np.uint64)
        h, o = np.concatenate((h, extra)), np.concatenate((o, few))
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    if len(h):
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))
        h, o = h[first], o[first]
    return h, np.bincount(o, minlength=n)


def document_sets(docs: DataFrame, width: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (d1, d2), and the keys of its bands (none for an empty set)."""
    permutations = -(-bands * rows // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts_of(batch.column(1))
            for a, b in chunks(offsets):
                h, per = shingle_sets(offsets[a : b + 1], data, width)
                full = np.flatnonzero(per)
                digests = np.zeros((2, b - a), np.uint64)
                keys: list = [[]] * (b - a)
                if len(full):
                    starts = (np.cumsum(per) - per)[full]
                    digests[0, full] = np.add.reduceat(mix(h), starts)
                    digests[1, full] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    made = band_keys(signatures(h, starts, permutations), bands, rows).view(np.int64)
                    for i, k in zip(full.tolist(), made, strict=True):
                        keys[i] = k
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(per, pa.int64()), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, d1 long, d2 long, bands array<long>")


def parity_sketches(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """For each set of hashes in a row, SKETCH words whose bit i says whether an odd number of them falls on i.

    Two sets differ in at least as many members as their sketches differ in bits.
    """
    bits = 64 * SKETCH
    ends = np.concatenate(([0], np.cumsum(per)))
    out = np.empty((len(per), SKETCH), np.int64)
    place = (mix(h) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    for a in range(0, len(per), 512):
        b = min(a + 512, len(per))
        at = place[ends[a] : ends[b]] + np.repeat(np.arange(b - a), per[a:b]) * bits
        odd = (np.bincount(at, minlength=(b - a) * bits) & 1).astype(bool).reshape(b - a, bits)
        out[a:b] = np.packbits(odd, axis=1).view(np.int64)
    return out


def full_sets(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """rep (the doc_id), the array of its shingles, sorted as signed numbers, and its sketch, a column for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts_of(batch.column(1))
            for a, b in chunks(offsets):
                h, per = shingle_sets(offsets[a : b + 1], data, width)
                ends = np.concatenate(([0], np.cumsum(per))).astype(np.int32)
                sketches = map(pa.array, np.ascontiguousarray(parity_sketches(h, per).T))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array((h ^ np.uint64(1 << 63)).view(np.int64))), *sketches], names=["rep", "shingles", *_SKETCH])

    return docs.select("doc_id", "text").mapInArrow(run, f"rep {docs.schema['doc_id'].dataType.simpleString()}, shingles array<long>, " + ", ".join(f"{c} long" for c in _SKETCH))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(u, v), those whose full sets are similar enough."""
    shingles = F.col("shingles").alias("s")
    left = pairs.join(sets.select(F.col("rep").alias("u"), shingles), "u").withColumnRenamed("s", "a")
    both = left.join(sets.select(F.col("rep").alias("v"), shingles), "v")
    counted = both.select("u", "v", F.size("a").cast("long").alias("m"), F.size("s").cast("long").alias("n"), F.size(F.array_intersect("a", "s")).cast("long").alias("common"))
    return counted.where(f"100 * common >= {percent} * (m + n - common)").select("u", "v")


def _prefixes(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """bucket (a shingle), rep, n, m, sketch and keys (all its buckets in order) for the prefix of each set: enough of its rarest shingles that a set of another component that is similar enough shares one.

    Shingles of one component only can't link two; they come first in the order and are left out; m is
    the number of the others, the most that the set can share with one of another component.
    """
    named = sets.join(labels, sets["rep"] == labels["node"], "left").select("rep", F.size("shingles").cast("long").alias("n"), F.coalesce("label", "rep").alias("label"), "shingles")
    flat = named.select("rep", "n", "label", F.explode("shingles").alias("bucket"))
    shared = flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("f"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket", "f")
    ordered = flat.join(shared, "bucket").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("f", "bucket"))).alias("s"))
    least = F.expr(f"(n * {percent} + 99) div 100")
    length = (F.col("n") - least + 1) - (F.col("n") - F.size("s"))
    keys = F.transform(F.slice("s", F.lit(1), F.greatest(length, F.lit(0)).cast("int")), lambda x: x["bucket"])
    prefixes = ordered.where(length > 0).select("rep", "n", F.size("s").cast("long").alias("m"), keys.alias("keys"))
    return prefixes.join(sets.select("rep", *_SKETCH), "rep").withColumn("bucket", F.explode("keys"))


def near_duplicate_classes(docs: DataFrame, percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Sets are the distinct shingles of ``width`` words of the whole text. Documents are linked where their full sets
    satisfy 100 * |A and B| >= percent * |A or B|; component_id is the smallest doc_id reachable over links.
    Bands follow percent.

    1. Documents with one and the same set form a class at once, by a grouping on the set's digest; only its smallest
       doc_id goes on. A hot group of copies is thereby combined before any shuffle.
    2. Buckets: representatives with an equal band key. Each is compared with the bucket's smallest member, a number of
       pairs as large as the bucket.
    3. What these links leave apart: members of different components in a bucket of up to SMALL are compared with each
       other. Larger buckets come about where many documents share a passage but little else. Their members get new,
       exact buckets, by prefixes: of a set of n shingles, ordered with the rarest first, the first
       n - ceil(percent * n / 100) + 1; two sets that are similar enough share one of these. A common passage is at the
       end of that order.
    4. Buckets of prefixes whose members are in different components are compared in rounds, the larger ones (from
       ALL_AT_ONCE members) little by little, as links found early spare comparisons. A round draws a share of
       the members that haven't been compared yet, sixteen times as many as the round before, and compares them with the
       members of other components; a bucket is done when its open members lie in one component. So no link is lost.
       Of these pairs, only those go to the full sets whose parity sketches differ in no more bits than two sets that
       are similar enough differ in members.

    A null or empty text, or one without words, has no shingles, and is a class of its own. A repeated doc_id stands for
    each of its rows: they count as one document if their texts have one set. A row whose doc_id is null has a null
    component and isn't kept. Columns other than doc_id and text are not read.
    """
    bounded_batches(docs.sparkSession)
    named = docs.where("doc_id IS NOT NULL")
    facts = durable(document_sets(docs, width, *bands_for(percent)))
    whole = facts.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = durable(whole.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("m")).select("d1", "d2", "n_shingles", F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands")))
    placed = reps.select(F.explode("bands").alias("bucket"), "rep", F.col("n_shingles").alias("n"))
    buckets = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot")).where("size > 1")
    buckets = durable(buckets)  # a join with an aggregate's output that stands beside it in one stage isn't split where skewed
    members = durable(placed.join(buckets, "bucket").select("bucket", "rep", "n", "pivot"))
    pivots = members.where("rep = pivot").select("bucket", F.col("n").alias("pn"))
    near = F.expr(f"100 * least(n, pn) >= {percent} * greatest(n, pn)")
    tested = durable(members.where("rep > pivot").join(pivots, "bucket").where(near).select(F.col("rep").alias("u"), F.col("pivot").alias("v")).distinct())
    wanted = members.select("rep").distinct()
    sets = durable(full_sets(named.join(wanted, named["doc_id"] == wanted["rep"], "left_semi"), width).dropDuplicates(["rep"]))
    edges = durable(_verified(tested, sets, percent))
    labels = durable(connected_components(edges))
    free(docs.sparkSession)

    def compare(pairs: DataFrame) -> None:
        """Verify pairs(u, v) that haven't been, and bring labels up to date."""
        nonlocal edges, labels, tested
        pairs = durable(pairs.join(tested, ["u", "v"], "left_anti"))
        if pairs.isEmpty():
            return
        found = durable(_verified(pairs, sets, percent))
        tested = tested.union(pairs)
        if not found.isEmpty():
            edges = edges.union(found)
            labels = durable(connected_components(edges))
        free(docs.sparkSession)

    def mixed(open_members: DataFrame) -> DataFrame:
        """Open members with their labels, of buckets where these differ, and the bucket's size."""
        state = open_members.join(labels, open_members["rep"] == labels["node"], "left").withColumn("label", F.coalesce("label", "rep")).drop("node")
        apart = state.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("bucket", "size")
        return durable(state.join(apart, "bucket"))

    def across(state: DataFrame, drawn: Column) -> DataFrame:
        """Pairs of a drawn member and one of another component that can still be similar enough, each in the first bucket that both are in, and once."""
        marked = state.withColumn("drawn", drawn)
        left = marked.where("drawn").select("bucket", F.col("rep").alias("x"), F.col("n").alias("pn"), F.col("m").alias("pm"), F.col("label").alias("xl"), F.col("keys").alias("pkeys"), *(F.col(c).alias(f"p{c}") for c in _SKETCH))
        enough = f"{100 + percent} * least(m, pm) >= {percent} * (n + pn)"
        first = "try_element_at(array_intersect(keys, pkeys), 1) = bucket"
        differ = " + ".join(f"bit_count({c} ^ p{c})" for c in _SKETCH)
        close = f"{100 + percent} * ({differ}) <= {100 - percent} * (n + pn)"
        return marked.join(left, "bucket").where(f"label <> xl AND (NOT drawn OR rep > x) AND {enough} AND {close} AND {first}").select(F.greatest("rep", "x").alias("u"), F.least("rep", "x").alias("v"))

    state = mixed(members.where("rep > pivot").select("bucket", "rep", "n", F.col("n").alias("m")))
    small = state.where(F.col("size") <= SMALL)
    hot = durable(state.where(F.col("size") > SMALL).select("rep").distinct())
    # small buckets only: a pair that shares a large one is found by its prefixes
    shared = small.groupBy("rep").agg(F.array_sort(F.collect_set("bucket")).alias("keys")).join(sets.select("rep", *_SKETCH), "rep")
    compare(across(small.join(shared, "rep"), F.lit(True)))
    open_members, share = durable(_prefixes(sets.join(hot, "rep"), labels, percent)), FIRST_SHARE
    while True:
        state = mixed(open_members)
        if state.isEmpty():
            break
        drawn = (F.col("size") <= max(share, ALL_AT_ONCE)) | (F.pmod(F.xxhash64("rep", F.lit(share)), F.col("size")) < share)
        compare(across(state, drawn))
        open_members = state.where(~drawn).drop("label", "size")
        share *= 16
    final = reps.join(labels, reps["rep"] == labels["node"], "left").select("d1", "d2", F.col("n_shingles").alias("n"), F.coalesce("label", "rep").alias("label"))
    joined = facts.drop("bands").join(final, (facts["d1"] == final["d1"]) & (facts["d2"] == final["d2"]) & (facts["n_shingles"] == final["n"]) & facts["doc_id"].isNotNull(), "left")
    out = joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))


def op4_minmax_hash(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return near_duplicate_classes(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(len(w) - {WORDS - 1}), lambda i: array_to_string(w[i + 1:i + {WORDS}], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.label),
c AS (SELECT node, min(label) AS label FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, label AS component_id, doc_id = label AS kept FROM sets JOIN c ON node = doc_id
"""
