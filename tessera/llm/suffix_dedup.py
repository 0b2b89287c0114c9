"""Removal of repeated 100-byte strings with per-shard suffix arrays.

A suffix array over all texts would sort every byte of the corpus, so anchors first say where repeats can be at all.
Among the 20-byte strings that begin in a 100-byte window, the one with the least hash is the window's anchor, and at
least 40 bytes of the window lie on one side of it; the hash of these 60 bytes is the window's key. Equal windows have
equal keys, so only windows whose key occurs twice in the corpus can repeat. A run of windows with one key is an
occurrence. Occurrences whose bytes are equal as a whole are settled by an aggregate; those that share a key in
different surroundings go to a shard. A shard's suffix array is made by Larsson-Sadakane refinement, and Kasai's common
prefixes of 100 and more are its classes of equal windows, of which the first stays. Shards are of about SHARD_BYTES;
the occurrences of a key that would take more than a small part of one are dealt over all shards, and their classes
merged over shards by binary search in sorted window hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BASE_INVERSE, BYTE_VALUE, CHUNK_BYTES, bounded_batches, chunks, durable, free, mix, powers, range_hash, range_sums, texts_of

#: Length of the repeated strings, and of the anchors within them.
LENGTH, ANCHOR = 100, 20
#: Bytes of a shard, for which a worker needs some 80 times as much, and bytes under one key from which these are dealt over all shards.
SHARD_BYTES, DEALT_BYTES = 1 << 20, 1 << 12
#: Windows of dealt pieces that one task merges.
MERGED_ROWS = 500_000

_BYTE_VALUE_2 = mix(BYTE_VALUE)
#: Bits of a packed minimum that hold the place within a chunk.
_PLACE, _MOST = np.uint64((1 << 22) - 1), np.uint64((1 << 64) - 1)


def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each start, where the leftmost least value of the next ``width`` lies, by the values' upper 42 bits.

    Positions stand in the lower 22 bits; blocks of ``width`` are scanned forwards and backwards, and a window's minimum is
    that of the tail of one block and the head of the next.
    """
    n = len(h)
    blocks = -(-n // width)
    key = np.full(blocks * width, _MOST, np.uint64)
    key[:n] = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
    key = key.reshape(blocks, width)
    heads = np.minimum.accumulate(key, axis=1).ravel()
    tails = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tails[: n - width + 1], heads[width - 1 : n]) & _PLACE).astype(np.int32)


def occurrences(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """text, first window start, number of windows, key, hash of the bytes, for each run of windows with one anchor on one side.

    The key is the hash of the anchor and of the half window that all windows of the run have beside it.
    """
    half = (length - anchor) // 2
    parts = []
    for a, b in chunks(offsets):
        first, last = int(offsets[a]), int(offsets[b])
        for low in range(first, max(last - length + 1, first), CHUNK_BYTES):  # one pass but for a very long text
            high = min(low + CHUNK_BYTES, last - length + 1)
            body = data[low : high + length - 1]
            if len(body) < length:
                continue
            sums = range_sums(BYTE_VALUE[body])
            grams = mix((sums[anchor:] - sums[:-anchor]) * powers(BASE_INVERSE, len(body) - anchor + 1))
            at = _window_minima(grams, length - anchor + 1)
            s = np.arange(len(at), dtype=np.int32)
            side = at - s >= half
            text = np.repeat(np.arange(a, b, dtype=np.int32), np.diff(np.clip(offsets[a : b + 1] - low, 0, len(at))))
            inside = s + (low + length) <= offsets[1:][text]
            new = (at[1:] != at[:-1]) | (side[1:] != side[:-1]) | (text[1:] != text[:-1])
            begins = np.flatnonzero(inside & np.concatenate(([True], new | ~inside[:-1])))
            if not len(begins):
                continue
            ends = np.flatnonzero(inside & np.concatenate((new | ~inside[1:], [True]))) + 1
            where, left, text = at[begins].astype(np.int64), side[begins], text[begins].astype(np.int64)
            block = where - np.where(left, half, 0)
            key = mix(range_hash(sums, block, where + np.where(left, anchor, length - half)) + left.astype(np.uint64))
            whole = mix(range_hash(sums, begins, ends + length - 1) + (((where - begins) << 16) + (ends - begins)).astype(np.uint64))
            parts.append((text, begins + low - offsets[text], ends - begins, key, whole))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def seen_before(text: np.ndarray, key: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Whether the same text has the same run earlier. Runs are in the order of text and place."""
    mark = mix(key ^ (whole * np.uint64(0x9E3779B97F4A7C15) + text.astype(np.uint64)))
    order = np.argsort(mark, kind="stable")
    equal = mark[order[1:]] == mark[order[:-1]]
    out = np.zeros(len(text), bool)
    out[order[1:][equal]] = True
    return out


def suffix_array(body: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, each up to its own end (ends[i] > i); equal ones in order of position.

    Larsson-Sadakane: suffixes sorted by their first h bytes are sorted by 2h through the ranks h bytes on, and only
    groups that aren't single yet are touched again.
    """
    n = len(body)
    place = np.arange(n, dtype=np.int32)
    key = np.zeros(n, np.int64)
    for j in range(min(7, n)):
        digit = np.zeros(n, np.int64)
        digit[: n - j] = body[j:]
        digit += 1
        digit[place + j >= ends] = 0
        key *= 257
        key += digit
    for _ in range(n, 7):
        key *= 257
    sa = np.argsort(key, kind="stable").astype(np.int32)
    key = key[sa]
    fresh = np.concatenate(([True], key[1:] != key[:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(fresh, place, 0)) if n else 0
    h, longest = 7, int((ends - place).max()) if n else 0
    while h < longest:
        head = rank[sa]
        same = head[1:] == head[:-1]
        several = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        if not len(several):
            break
        i, head = sa[several], head[several]
        on = i + h < ends[i]
        key = head.astype(np.int64) * (n + 1) + np.where(on, rank[np.where(on, i + h, 0)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, i = key[order], i[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        sa[several] = i
        rank[i] = np.maximum.accumulate(np.where(fresh, several, 0))
        h *= 2
    return sa


def common_prefixes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place in the suffix array, the length that it shares with the place before. Kasai's walk, in step over all pieces.

    starts are the pieces' first positions; ends[i] is the end of the piece that holds i.
    """
    inverse = np.empty(len(sa), np.int32)
    inverse[sa] = np.arange(len(sa), dtype=np.int32)
    out = np.zeros(len(sa), np.int32)
    i, h = starts.astype(np.int32), np.zeros(len(starts), np.int32)
    stop = ends[starts] if len(starts) else starts
    while len(i):
        q = inverse[i]
        j = sa[np.maximum(q - 1, 0)]
        most = np.where(q > 0, np.minimum(stop - i, ends[j] - j), 0)
        h = np.minimum(h, most)
        live = np.flatnonzero(h < most)
        while len(live):
            live = live[body[i[live] + h[live]] == body[j[live] + h[live]]]
            h[live] += 1
            live = live[h[live] < most[live]]
        out[q] = h
        i = i + 1
        go = i < stop
        i, h, stop = i[go], np.maximum(h[go] - 1, 0), stop[go]
    return out


def _intervals(piece: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """piece, first and end of the byte ranges under windows that begin at ``start``; consecutive windows of a piece make one."""
    order = np.lexsort((start, piece))
    piece, start = piece[order], start[order]
    fresh = np.concatenate(([True], (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1))) if len(piece) else np.zeros(0, bool)
    last = np.concatenate((fresh[1:], [True])) if len(piece) else fresh
    return piece[fresh], start[fresh], start[last] + length


def shard_repeats(doc: np.ndarray, begin: np.ndarray, offsets: np.ndarray, body: np.ndarray, dealt: np.ndarray, length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of a shard's pieces (document, place in it, bytes): ranges (doc, start, end) under windows that also begin earlier,
    and, of dealt pieces, the first window of each class as (hash, second hash, doc, start)."""
    size = np.diff(offsets)
    body = body[offsets[0] : offsets[-1]]
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    ends = (starts + size).astype(np.int32)[owner]
    sa = suffix_array(body, ends)
    shared = common_prefixes(body, starts, ends, sa)
    first = np.lexsort((begin, doc))
    order = np.empty(len(first), np.int64)
    order[first] = np.arange(len(first))
    whole = ends[sa] - sa >= length
    fresh = (shared < length) | ~whole
    sa, fresh = sa[whole], fresh[whole]
    if not len(sa):
        return [np.zeros(0, np.int64)] * 3, [np.zeros(0, np.int64)] * 4
    fresh[0] = True
    key = (order[owner[sa]] << 20) | (sa - starts[owner[sa]])
    heads = np.flatnonzero(fresh)
    least = np.minimum.reduceat(key, heads)
    again = sa[key != np.repeat(least, np.diff(np.concatenate((heads, [len(sa)]))))]
    piece, a, b = _intervals(owner[again], begin[owner[again]] + again - starts[owner[again]], length)
    firsts = np.flatnonzero(key == np.repeat(least, np.diff(np.concatenate((heads, [len(sa)])))))
    at = sa[firsts]
    at = at[dealt[owner[at]]]
    x, y = range_hash(range_sums(BYTE_VALUE[body]), at, at + length), range_hash(range_sums(_BYTE_VALUE_2[body]), at, at + length)
    return [doc[piece], a, b], [mix(x).view(np.int64), mix(y).view(np.int64), doc[owner[at]], begin[owner[at]] + at - starts[owner[at]]]


def repeated_ranges(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc, start, end: byte ranges of windows that also begin earlier; ranges may overlap. docs(doc long, text), each doc once."""
    spark = docs.sparkSession

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, _, _, key, whole = occurrences(*texts_of(batch.column(1)), length, anchor)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(pa.array(text))], names=["key", "whole", "doc"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, start, count, key, whole = occurrences(*texts_of(batch.column(1)), length, anchor)
            again = seen_before(text, key, whole)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array((start << 16) | count), pa.array(again)],
                names=["key", "whole", "doc", "run", "again"],
            )

    texts = docs.select("doc", "text")
    several = F.min("whole") != F.max("whole")
    repeated = durable(texts.mapInArrow(keys, "key long, whole long, doc long").groupBy("key").agg(F.count(F.lit(1)).alias("n"), several.alias("mixed"), F.min("doc").alias("first")).where("n > 1").drop("n"))
    free(spark)
    every = texts.mapInArrow(runs, "key long, whole long, doc long, run long, again boolean")
    later = F.col("again") | (~F.col("mixed") & (F.col("doc") > F.col("first")))
    found = durable(every.join(repeated, "key").where(later | F.col("mixed")).select("key", "whole", "doc", "run", later.alias("later")))
    del every, repeated
    free(spark)
    start, count = F.shiftrightunsigned("run", 16), F.col("run").bitwiseAND(65535)
    span = [F.col("doc"), start.alias("start"), (start + count + length - 1).alias("end")]
    mixed = found.where("NOT later").drop("later")
    firsts = mixed.groupBy("key", "whole").agg(F.min("doc").alias("first"))
    kinds = durable(mixed.join(firsts, ["key", "whole"]).select("key", "doc", "run", (F.col("doc") > F.col("first")).alias("later")))
    copies = [found.where("later").select(span), kinds.where("later").select(span)]
    pieces = kinds.where("NOT later").select("key", "doc", "run", (count + length - 1).alias("size"))
    by_key = durable(pieces.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "bytes"))
    del mixed, firsts
    shards = max(1, -(-(by_key.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))
    dealt = F.col("bytes") > min(DEALT_BYTES, SHARD_BYTES // 4)
    shard = F.pmod(F.when(dealt, F.xxhash64("key", "doc", "run")).otherwise(F.xxhash64("key")), F.lit(shards)).cast("int")
    wanted = pieces.join(by_key, "key").groupBy("doc").agg(F.collect_list(F.struct(shard.alias("shard"), "run", dealt.alias("dealt"))).alias("w"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts_of(batch.column(1))
            lists = batch.column(2)
            at, fields = lists.offsets.to_numpy(), lists.values
            text = np.repeat(np.arange(batch.num_rows), np.diff(at))
            rows = slice(int(at[0]), int(at[-1]))
            run = fields.field("run").to_numpy()[rows]
            begin, size = run >> 16, (run & 65535) + length - 1
            for lo in range(0, len(run), 8192):
                part = slice(lo, lo + 8192)
                n, a = size[part], offsets[text[part]] + begin[part]
                ends = np.concatenate(([0], np.cumsum(n)))
                taken = data[np.repeat(a - ends[:-1], n) + np.arange(ends[-1])]
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(taken)])
                yield pa.RecordBatch.from_arrays(
                    [fields.field("shard").slice(rows.start + lo, len(n)), batch.column(0).take(pa.array(text[part])), pa.array(begin[part]), binary, fields.field("dealt").slice(rows.start + lo, len(n))],
                    names=["shard", "doc", "start", "bytes", "dealt"],
                )

    def solve(table: pa.Table) -> pa.Table:
        bodies = texts_of(table["bytes"])
        ranges, classes = shard_repeats(table["doc"].to_numpy(), table["start"].to_numpy(), *bodies, table["dealt"].to_numpy(), length)
        n, m = len(ranges[0]), len(classes[0])
        none_n, none_m = np.zeros(n, np.int64), np.zeros(m, np.int64)
        columns = {"doc": (ranges[0], classes[2]), "start": (ranges[1], classes[3]), "end": (ranges[2], classes[3] + length), "first": (none_n, none_m + 1), "x": (none_n, classes[0]), "y": (none_n, classes[1])}
        return pa.table({k: pa.array(np.concatenate(v).astype(np.int64)) for k, v in columns.items()})

    bodies = docs.join(wanted, "doc").select("doc", "text", "w").mapInArrow(cut, "shard int, doc long, start long, bytes binary, dealt boolean")
    solved = durable(bodies.groupBy("shard").applyInArrow(solve, "doc long, start long, end long, first long, x long, y long"))
    del bodies, wanted, pieces, by_key
    free(spark)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if tables:
            t = pa.Table.from_batches(tables)
            x, y = t["x"].to_numpy(), t["y"].to_numpy()
            pair = np.rec.fromarrays([x, y])
            head = np.searchsorted(x, x, "left")  # most hashes are alone: the first of its class by binary search
            same = (x[head] == x) & (y[head] == y)
            later = (head != np.arange(len(x))) & same
            for i in np.flatnonzero(~same):  # two windows with one first hash
                later[i] = bool(np.any(pair[head[i] : i] == pair[i]))
            yield from t.select(["doc", "start", "end"]).filter(pa.array(later)).to_batches()

    classes = solved.where("first = 1").select("doc", "start", "end", "x", "y")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), classes.count() // MERGED_ROWS)
    merged = classes.repartitionByRange(n, "x").sortWithinPartitions("x", "y", "doc", "start").mapInArrow(merge, "doc long, start long, end long")
    return reduce(DataFrame.union, [*copies, solved.where("first = 0").select("doc", "start", "end"), merged])


def numbered(docs: DataFrame) -> DataFrame:
    """doc (a number for each row, in the order of doc_id), doc_id, text and copies, with equal rows as one that counts them.

    Where all doc_ids are integers, set and different, they are the numbers. Otherwise rows go by doc_id, nulls first, and
    then by two hashes of their texts; the narrow table of these is sorted and numbered, a partition after the other.
    """
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    repeats = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if whole and repeats.isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("doc"), "doc_id", "text", F.lit(1).cast("long").alias("copies"))
    told = docs.select("doc_id", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), F.col("text")).alias("y"), "text")
    order = ["doc_id", "x", "y"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = durable(told.groupBy(order).agg(F.count(F.lit(1)).alias("copies")).repartitionByRange(n, *order).sortWithinPartitions(*order))
    kinds = kinds.withColumn("place", F.monotonically_increasing_id())
    part, place = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, base = 0, [F.lit(-1), F.lit(0).cast("long")]
    for row in kinds.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a number for each partition
        base += [F.lit(row["part"]), F.lit(before).cast("long")]
        before += row["n"]
    numbers = kinds.select(*(F.col(c).alias(f"n_{c}") for c in order), "copies", (F.element_at(F.create_map(*base), part.cast("int")) + place).alias("doc"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in order))
    rows = durable(told.join(numbers, same).select("doc", "doc_id", "text", "copies"))
    return rows.where("copies = 1").union(rows.where("copies > 1").dropDuplicates(["doc"]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes if asked for) of each row.

    Texts are UTF-8 bytes, a null is empty; strings never cross texts. A byte goes if a string of ``length`` bytes over
    it also begins earlier: in a smaller doc_id, or at an earlier place of the same. All is judged on the input.
    Each row is a document. A null doc_id comes before all others, rows that share a doc_id go by hashes of their
    texts, and of equal rows one is the first. Texts shorter than ``length`` stay. Bytes after a cut character may
    be no valid UTF-8 text, so the kept part is binary. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    named = numbered(docs)
    lists = repeated_ranges(named.select("doc", "text"), length).groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    joined = named.join(lists, "doc", "left").select("doc_id", "text", "ranges", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts_of(batch.column(1))
            lists = batch.column(2)
            rows = []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                cut = lists[i].values
                if cut is None or not len(cut):
                    rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text.tobytes() if keep_text else None))
                    continue
                a, b = cut.field("start").to_numpy(), cut.field("end").to_numpy()
                depth = np.zeros(len(text) + 1, np.int32)
                np.add.at(depth, a, 1)
                np.add.at(depth, b, -1)
                gone = np.cumsum(depth)[:-1] > 0
                kept = text[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(c, k) for c, k, _ in zip(columns, kinds, names, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, batch.column(3)], names=["doc_id", *names, "copies"])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 if keep_text else 4]
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text + ", copies long")
    gone = (F.col("copy") > 1) & (F.col("n_bytes") >= length)
    after = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "kept": F.lit(b"")}
    every = first.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return every.select("doc_id", *(F.when(gone, after[c]).otherwise(F.col(c)).alias(c) if c in after else F.col(c) for c in names))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return remove_repeats(table(spark, sf_dir, "documents"))
