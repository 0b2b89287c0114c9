"""Groups of spelling variants by letter-parity bitmask bands.

A word's mask has a bit for each letter that says whether the word holds it an odd number of times. One edit flips at
most two bits: an inserted or deleted letter one, a replaced letter two or, where both letters share a bit, none. So of
the mask's three bands at least one stays as it is, and words that are one edit apart meet under an equal band.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_VALUE, LOWER, bounded_batches, chunks, durable, mix, range_hash, range_sums, spread_texts, texts_of

#: Shortest words, in code points, and least occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form occurs at least so many times as often as its variant.
FORM_TIMES = 2
#: Runs whose checksum this divides lose a letter (a fixed value, as is the checksum: planted misspellings).
ALTERED = 97
#: Bits of one of the three bands.
BAND_BITS = 21
BANDS = 3
#: Words of a band that one cell compares with as many others; larger bands are cut into blocks, and each two blocks make a cell.
BLOCK = 4096
#: Pairs that are looked at at once.
PAIRS = 1 << 20
#: Words that a worker counts before it hands them on.
COUNTED = 200_000

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
#: Letters as numbers from 1: a-z, then U+00C0 to U+00FF by the second of their two bytes.
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(1, 27)
_LETTER[0x80:0xC0] = np.arange(27, 91)
#: The mask's bit of each letter: letters are dealt to the bands in turn, so that each band gets frequent ones.
_BIT = np.zeros(91, np.uint64)
_BIT[1:] = np.uint64(1) << np.array([k % BANDS * BAND_BITS + k // BANDS % BAND_BITS for k in range(90)], np.uint64)


def checksums(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of what ``before`` (a crc32) stands for, followed by the bytes of each range; all ranges in step."""
    order = np.argsort(starts - ends, kind="stable")  # the longest first: those still open are a prefix
    at, left = starts[order], (ends - starts)[order]
    reg = before[order] ^ np.uint32(0xFFFFFFFF)
    open_ = len(at)
    for k in range(int(left[0]) if len(left) else 0):
        open_ = int(np.searchsorted(-left[:open_], -k, "left"))
        r = reg[:open_]
        reg[:open_] = _CRC[(r ^ body[at[:open_] + k]) & 255] ^ (r >> np.uint32(8))
    out = np.empty(len(at), np.uint32)
    out[order] = reg ^ np.uint32(0xFFFFFFFF)
    return out


def _runs(body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and lengths in code points of the runs of letters in lower-cased UTF-8."""
    lead = body == 0xC3
    after = np.concatenate(([False], lead[:-1])) & (body & 0xC0 == 0x80)
    part = ((body >= 97) & (body <= 122)) | lead | after
    edge = np.diff(np.concatenate(([False], part, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = np.concatenate(([0], np.cumsum(after)))
    return starts, ends, ends - starts - (inner[ends] - inner[starts])


def count_words(docs: DataFrame) -> DataFrame:
    """word and n: how often each word of LEAST_LENGTH code points or more occurs, runs that lose a letter under the rule counted as what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            offsets, data = texts_of(batch.column(1))
            ids = [zlib.crc32(f"{'' if d is None else d}:".encode()) for d in batch.column(0).to_pylist()]
            for a, b in chunks(offsets):
                body, edges = spread_texts(offsets[a : b + 1], data)
                body = LOWER[body]
                starts, ends, size = _runs(body)
                keep = size >= LEAST_LENGTH
                starts, ends, size = starts[keep], ends[keep], size[keep]
                if not len(starts):
                    continue
                owner = np.searchsorted(edges, starts, "right")
                h = mix(range_hash(range_sums(BYTE_VALUE[body]), starts, ends) + (ends - starts).astype(np.uint64))
                order = np.lexsort((h, owner))  # a document's equal runs share one checksum
                first = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])))
                at = order[first]
                times = np.diff(np.concatenate((np.flatnonzero(first), [len(order)])))
                crc = checksums(body, starts[at], ends[at], np.array(ids[a:b], np.uint32)[owner[at]])
                altered = crc % ALTERED == 0
                for i, times_i, c in zip(at[altered].tolist(), times[altered].tolist(), crc[altered].tolist(), strict=True):
                    if size[i] > LEAST_LENGTH:
                        word = body[starts[i] : ends[i]].tobytes().decode()
                        gone = c % len(word)
                        word = (word[:gone] + word[gone + 1 :]).encode()
                        counts[word] = counts.get(word, 0) + times_i
                at, times = at[~altered], times[~altered]
                _, one, which = np.unique(h[at], return_index=True, return_inverse=True)
                sums = np.bincount(which, times, len(one)).astype(np.int64).tolist()
                text = body.tobytes()
                for s, e, n in zip(starts[at[one]].tolist(), ends[at[one]].tolist(), sums, strict=True):
                    word = text[s:e]
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > COUNTED:
                    yield out()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' letters as numbers, in a row, and where each word begins (and the last one ends)."""
    body = data[offsets[0] : offsets[-1]]
    keep = body != 0xC3
    before = np.concatenate(([0], np.cumsum(keep)))
    return _LETTER[body[keep]], before[offsets - offsets[0]]


def masks(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The parity mask of each word; none is empty."""
    return np.bitwise_xor.reduceat(_BIT[codes], starts[:-1]) if len(starts) > 1 else np.zeros(0, np.uint64)


def one_edit(codes: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of words (by number; b as long as a or one letter longer), whether exactly one letter is inserted or replaced."""
    out = np.zeros(len(a), bool)
    size = np.diff(starts)
    codes = np.concatenate((codes, np.zeros(2, np.uint8)))
    longest = size[b]
    order = np.argsort(longest, kind="stable")
    lo = 0
    while lo < len(order):
        hi = min(len(order), lo + max(1, PAIRS // max(1, int(longest[order[lo]]))))
        while hi > lo + 1 and (hi - lo) * int(longest[order[hi - 1]]) > 2 * PAIRS:
            hi = lo + max(1, (hi - lo) // 2)
        own = order[lo:hi]
        width = int(longest[own[-1]])
        i, j = a[own], b[own]
        k = np.arange(width)
        inside = k < size[i][:, None]
        x = codes[np.minimum(starts[i][:, None] + k, len(codes) - 1)]
        here = inside & (x != codes[np.minimum(starts[j][:, None] + k, len(codes) - 1)])
        ahead = inside & (x != codes[np.minimum(starts[j][:, None] + k + 1, len(codes) - 1)])
        first = np.where(here.any(1), here.argmax(1), width)  # up to here both agree, and from the last of ahead on they do one letter apart
        last = np.where(ahead.any(1), width - 1 - ahead[:, ::-1].argmax(1), -1)
        out[own] = np.where(size[i] == size[j], here.sum(1) == 1, last < first)
        lo = hi
    return out


def halves(codes: np.ndarray, starts: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a first and a last part of each word, together as long as the shorter of the words it is compared with: one edit leaves one of them as it is."""
    sums = range_sums(BYTE_VALUE[codes])
    first = shorter // 2
    return range_hash(sums, starts[:-1], starts[:-1] + first), range_hash(sums, starts[1:] - (shorter - first), starts[1:])


def _candidates(mask: np.ndarray, head: np.ndarray, tail: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: np.ndarray, band: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, partner) whose masks differ in at most most[row] bits and which share a half, each under the first band that is equal; row i has the partners lo[i] to hi[i]."""
    low = np.uint64((1 << BAND_BITS) - 1)

    def first_band(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, ok = mask[i] ^ mask[j], np.ones(len(i), bool)
        for k in range(BANDS):
            equal = (x >> np.uint64(k * BAND_BITS)) & low == 0
            ok &= np.where(band[i] > k, ~equal, (band[i] != k) | equal)
        return ok

    rows = np.flatnonzero(hi > lo)
    wide = (hi - lo)[rows] >= 64
    few = most.astype(np.uint8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    tall = rows[wide]
    at = 0
    while at < len(tall):  # rows whose partners end at one place are compared with all of them at once
        first = tall[at]
        end, low_ = hi[first], lo[first]
        to = min(len(tall), at + max(1, (1 << 16) // int(end - low_)))
        other = np.flatnonzero(hi[tall[at:to]] != end)
        to = at + int(other[0]) if len(other) else to
        i = tall[at:to][:, None]
        own = slice(low_, end)
        near = np.bitwise_count(mask[own] ^ mask[i]) <= few[i]
        near &= (head[own] == head[i]) | (tail[own] == tail[i])
        hit = np.flatnonzero(near)
        i, j = tall[at + hit // (end - low_)], low_ + hit % (end - low_)
        ok = j >= lo[i]
        found.append((i[ok], j[ok]))
        held += len(hit)
        if held > PAIRS >> 3:
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            ok = first_band(i, j)
            yield i[ok], j[ok]
            found, held = [], 0
        at = to
    if found:
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        ok = first_band(i, j)
        yield i[ok], j[ok]
    rows = rows[~wide]
    count = (hi - lo)[rows]
    ends = np.cumsum(count)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = count[at:to]
        i = np.repeat(rows[at:to], n)
        j = np.repeat(lo[rows[at:to]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        ok = (np.bitwise_count(mask[i] ^ mask[j]) <= most[i]) & ((head[i] == head[j]) | (tail[i] == tail[j]))
        i, j = i[ok], j[ok]
        ok = first_band(i, j)
        yield i[ok], j[ok]
        at = to


def _compare(cells: pa.Table) -> Iterator[pa.RecordBatch]:
    """word, n, near, near_n for the near words of whole cells, in the order of key, tile and side."""
    key, tile, side, mask, n = (cells[c].to_numpy() for c in ("key", "tile", "side", "mask", "n"))
    mask = mask.view(np.uint64)
    word = cells["word"].combine_chunks()
    codes, starts = letters(*texts_of(word))
    size = np.diff(starts)
    fresh = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))))
    ends = np.concatenate((fresh[1:], [len(key)]))
    of = np.repeat(np.arange(len(fresh)), ends - fresh)
    left = np.bincount(of, side == 0, len(fresh)).astype(np.int64)
    alone = left == ends - fresh  # words of one block with each other
    place = np.arange(len(key))
    lo = np.where(alone[of], place + 1, (fresh + left)[of])
    hi = np.where(side == 0, ends[of], 0)
    apart = (tile >> 62) & 1  # of words of two lengths
    most = np.where(apart == 1, 1, 2)
    band = (key >> BAND_BITS) & 3
    for i, j in _candidates(mask, *halves(codes, starts, size - apart * (side == 0)), lo, hi, most, band):
        if not len(i):
            continue
        short, long = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
        ok = one_edit(codes, starts, short, long)
        i, j = i[ok], j[ok]
        if len(i):
            yield pa.RecordBatch.from_arrays([word.take(pa.array(i)), pa.array(n[i]), word.take(pa.array(j)), pa.array(n[j])], names=["word", "n", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of words(word, n) that are exactly one edit apart, once.

    A word goes to a key for each of its bands: the band's value and the word's length; there it is compared with words of
    its own length and of one letter less. A key of more than BLOCK words is cut into blocks by the words' hashes, and each
    two blocks make a cell of their own, so no task holds more than two blocks, however many words share a band.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts = letters(*texts_of(batch.column(0)))
            mask, size = masks(codes, starts), np.diff(starts)
            for k in range(BANDS):
                value = (mask >> np.uint64(k * BAND_BITS)) & np.uint64((1 << BAND_BITS) - 1)
                key = (size << (BAND_BITS + 2)) | (k << BAND_BITS) | value.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(1), pa.array(mask.view(np.int64))], names=["key", "word", "n", "mask"])

    longer = 1 << (BAND_BITS + 2)
    keyed = words.select("word", "n").mapInArrow(keys, "key long, word string, n long, mask long")
    blocks = durable(keyed.groupBy("key").agg(F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}").alias("blocks"), F.count(F.lit(1)).alias("size")))
    of = lambda shift, name: blocks.select((F.col("key") + shift).alias("key"), F.col("blocks").alias(name))
    around = durable(blocks.join(of(longer, "shorter"), "key", "left").join(of(-longer, "longer"), "key", "left").where("size > 1 OR shorter IS NOT NULL OR longer IS NOT NULL"))
    tile = lambda kind, x, y: F.lit(kind << 62) + F.shiftleft(x.cast("long"), 31) + y.cast("long")
    mine = F.col("block")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    cell = lambda key, t, side: F.struct(key.alias("key"), t.alias("tile"), side.cast("int").alias("side"))
    same = F.when(F.col("size") > 1, F.transform(upto("blocks"), lambda j: cell(F.col("key"), tile(0, F.least(mine, j), F.greatest(mine, j)), F.when(mine > j, 1).otherwise(0))))
    above = F.transform(upto("shorter"), lambda j: cell(F.col("key"), tile(1, mine, j), F.lit(0)))
    below = F.transform(upto("longer"), lambda j: cell(F.col("key") + longer, tile(1, j, mine), F.lit(1)))
    none = F.expr("cast(array() as array<struct<key:bigint,tile:bigint,side:int>>)")
    placed = keyed.join(around, "key").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
    cells = placed.select("word", "n", "mask", F.explode(F.concat(*(F.coalesce(c, none) for c in (same, above, below)))).alias("c")).select("c.*", "word", "n", "mask")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            if table.num_rows < BLOCK:
                continue
            key, tile = table["key"].to_numpy(), table["tile"].to_numpy()
            open_ = int(np.flatnonzero((key != key[-1]) | (tile != tile[-1]))[-1]) + 1 if (key[0], tile[0]) != (key[-1], tile[-1]) else 0
            if open_:  # the last cell may go on in the next batch
                yield from _compare(table.slice(0, open_))
                held = table.slice(open_).to_batches()
        if held:
            yield from _compare(pa.Table.from_batches(held))

    return cells.repartition("key", "tile").sortWithinPartitions("key", "tile", "side").mapInArrow(compare, "word string, n long, near string, near_n long")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of docs(doc_id, text).

    Words are runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, with A-Z lower-cased, of LEAST_LENGTH code points and
    LEAST_COUNT occurrences or more. A run loses one code point where ALTERED divides the crc32 of its document's id, a
    colon and the run. Two words are near if one code point is inserted, deleted or replaced. A word's form is the near
    word that occurs most (the smallest in the order of code points, if several do), where it occurs FORM_TIMES as often
    at least; the root is where forms lead to, the word itself if it has none.

    Null texts have no words, a null doc_id counts as an empty one, repeated rows count each. Empty tables give no rows.
    Columns other than doc_id and text aren't read.
    """
    bounded_batches(docs.sparkSession)
    words = durable(count_words(docs).where(F.col("n") >= LEAST_COUNT))
    pairs = durable(near_words(words))
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("b"))
    enough = -F.col("b.n") >= FORM_TIMES * F.col("n")
    told = durable(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("b.form")).alias("form"), F.when(enough, -F.col("b.n")).alias("form_n")))
    roots = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # counts at least double along a chain, so chains are short, and each round doubles the step
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = durable(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = not roots.where("moved").isEmpty()
        roots = roots.drop("moved")
        if not moved:
            break
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_parity_variants(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return spelling_variants(table(spark, sf_dir, "documents"))


_ACCENTS = "".join(map(chr, range(0xC0, 0x100)))
_PLAIN = "".join(map(chr, range(33, 97))).replace("'", "''")
OP13_SQL = f"""
WITH RECURSIVE pairs AS (SELECT doc_id, w, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z{chr(0xC0)}-{chr(0xFF)}]+')) AS w FROM documents) GROUP BY ALL),
bytes AS (SELECT *, hex(coalesce(doc_id::VARCHAR, '') || ':' || w) AS x FROM pairs WHERE length(w) >= {LEAST_LENGTH}),
steps AS (SELECT doc_id, w, times, [4294967295::BIGINT] || flatten(list_transform(range(len(x) // 2), lambda i: [('0x' || x[2 * i + 1:2 * i + 2])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS s FROM bytes),
crc AS (SELECT doc_id, w, times, xor(list_reduce(s, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h FROM steps),
told AS (SELECT CASE WHEN h % {ALTERED} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, times FROM crc),
words AS (SELECT word, sum(times)::BIGINT AS n FROM told WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
less AS (SELECT word, unnest(list_distinct([word] || list_transform(range(length(word)), lambda i: left(word, i::INT) || substr(word, i::INT + 2)))) AS part FROM words),
met AS (SELECT DISTINCT a.word, b.word AS near FROM less a JOIN less b USING (part) WHERE a.word <> b.word),
near AS (SELECT word, near FROM met WHERE levenshtein(translate(word, '{_ACCENTS}', '{_PLAIN}'), translate(near, '{_ACCENTS}', '{_PLAIN}')) = 1),
best AS (SELECT a.word, count(*) AS n_near, min({{'n': -b.n, 'w': near}}) AS b FROM near a JOIN words b ON b.word = near GROUP BY a.word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= {FORM_TIMES} * n THEN b.w END AS form, CASE WHEN -b.n >= {FORM_TIMES} * n THEN -b.n END AS form_n FROM words LEFT JOIN best USING (word)),
way AS (SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM forms UNION ALL SELECT w.word, coalesce(f.form, w.root), f.form IS NULL FROM way w JOIN forms f ON f.word = w.root WHERE NOT w.done)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM way WHERE done) USING (word)
"""
