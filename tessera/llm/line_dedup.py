"""Removal of repeated lines through a sharded minimal perfect hash.

The distinct hashes of lines that several documents hold are dealt into shards by their leading bits. A shard is a minimal
perfect hash and, at its slots, a fingerprint, the number of documents and the first of them. Documents hash their lines
and probe these arrays; no line is joined with another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_VALUE, IS_SPACE, LOWER, bounded_batches, chunks, durable, mix, range_hash, range_sums, texts_of

#: Shortest key of a line, in code points, that counts, and documents that must hold it.
LEAST_LENGTH, LEAST_DOCUMENTS = 10, 2
#: Lines of a shard, and the most shards there are (beyond, shards grow).
SHARD_LINES, MOST_SHARDS = 1 << 16, 1 << 16
#: Bytes of arrays up to which the index travels to the documents; beyond, hashes of lines travel to the shards.
FEW_BYTES = 32 << 20
#: Probes of a shard that one task answers.
PROBES = 1 << 20
#: Place in the order of documents of rows without a doc_id.
LAST = (1 << 63) - 1

_BYTE_VALUE_2 = mix(BYTE_VALUE)
_SPREAD = 0x9E3779B97F4A7C15


class PerfectSlots:
    """A minimal perfect hash over distinct pairs of 64-bit hashes.

    On each level every key that is left points at a bit; bits that one key alone points at are set, and the others' keys
    go on to the next level. A key's slot is the rank of its bit. Levels have two bits a key, so it takes about four bits.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits  # sizes in words of 64 bits
        self.first = np.cumsum([0, *sizes])
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    @staticmethod
    def _at(x: np.ndarray, y: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mix(x ^ mix(y + np.uint64(_SPREAD * (level + 1) % (1 << 64)))) % np.uint64(64 * words)).astype(np.int64)

    @classmethod
    def build(cls, x: np.ndarray, y: np.ndarray) -> PerfectSlots:
        sizes, bits, left = [], [np.zeros(0, np.uint64)], np.arange(len(x))
        while len(left):
            words = max(1, -(-2 * len(left) // 64))
            at = cls._at(x[left], y[left], len(sizes), words)
            alone = np.bincount(at, minlength=64 * words) == 1
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(words)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(bits))

    def find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The only slot that each key can have; -1 where it can have none."""
        out, left = np.full(len(x), -1, np.int64), np.arange(len(x))
        for level, words in enumerate(self.sizes):
            if not len(left):
                break
            at = self._at(x[left], y[left], level, words) + 64 * self.first[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (self.bits[word] >> bit) & np.uint64(1) == 1
            w, b = word[here], bit[here]
            out[left[here]] = self.before[w] + np.bitwise_count(self.bits[w] & ((np.uint64(1) << b) - np.uint64(1)))
            left = left[~here]
        return out


@dataclass
class Shard:
    """A shard's arrays by slot."""

    slots: PerfectSlots
    fingerprint: np.ndarray
    count: np.ndarray
    first: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray, y: np.ndarray, count: np.ndarray, first: np.ndarray) -> Shard:
        slots = PerfectSlots.build(x, y)
        order = np.argsort(slots.find(x, y))
        return cls(slots, y[order], count[order], first[order])

    def pack(self) -> list:
        return [self.slots.sizes, *(a.tobytes() for a in (self.slots.bits, self.fingerprint, self.count, self.first))]

    @classmethod
    def unpack(cls, row: list) -> Shard:
        return cls(PerfectSlots(row[0], np.frombuffer(row[1], np.uint64)), np.frombuffer(row[2], np.uint64), np.frombuffer(row[3], np.int64), np.frombuffer(row[4], np.int64))

    def probe(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold each line, and the first of them; 0 and LAST for lines that aren't indexed."""
        at = self.slots.find(x, y)
        known = np.flatnonzero(at >= 0)
        known = known[self.fingerprint[at[known]] == y[known]]
        count, first = np.zeros(len(x), np.int64), np.full(len(x), LAST, np.int64)
        count[known], first[known] = self.count[at[known]], self.first[at[known]]
        return count, first


def split_lines(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts in a row: text, start and end (in data) of each line, whether its key is long enough, and two hashes of the key."""
    low, high = int(offsets[0]), int(offsets[-1])
    body = data[low:high]
    at = offsets - low
    breaks = np.flatnonzero(body == 10)
    inside = np.searchsorted(at, breaks, "right") - 1
    n = np.bincount(inside, minlength=len(at) - 1) + 1
    text = np.repeat(np.arange(len(at) - 1), n)
    starts, ends = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
    head = np.cumsum(n) - n
    starts[head], ends[head + n - 1] = at[:-1], at[1:]
    later = np.ones(len(text), bool)
    later[head] = False
    starts[later] = breaks + 1
    later = np.ones(len(text), bool)
    later[head + n - 1] = False
    ends[later] = breaks
    solid = np.flatnonzero(~IS_SPACE[body])
    i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = j > i
    padded = np.concatenate((solid, [0]))
    a, b = np.where(some, padded[i], 0), np.where(some, padded[np.maximum(j - 1, 0)] + 1, 0)
    points = np.concatenate(([0], np.cumsum(body & 0xC0 != 0x80)))
    counts = points[b] - points[a] >= LEAST_LENGTH
    lower = LOWER[body]
    size = (b - a).astype(np.uint64)
    x, y = (mix(range_hash(range_sums(values[lower]), a, b) + size) for values in (BYTE_VALUE, _BYTE_VALUE_2))
    return text, starts + low, ends + low, counts, x, y


def line_counts(docs: DataFrame) -> DataFrame:
    """x, y, count, low, high: each distinct long enough line of docs(doc, text) with the number of rows and the least and greatest doc that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts_of(batch.column(1))
            docs_ = batch.column(0).to_numpy()
            for a, b in chunks(offsets):
                text, _, _, counts, x, y = split_lines(offsets[a : b + 1], data)
                text, x, y = text[counts], x[counts], y[counts]
                if not len(x):
                    continue
                order = np.lexsort((text, y, x))
                text, x, y = text[order], x[order], y[order]
                fresh = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
                own = fresh | np.concatenate(([True], text[1:] != text[:-1]))
                heads = np.flatnonzero(fresh)
                doc = docs_[a + text]
                arrays = [x[heads].view(np.int64), y[heads].view(np.int64), np.add.reduceat(own.astype(np.int64), heads), np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], names=["x", "y", "count", "low", "high"])

    made = docs.select("doc", "text").mapInArrow(run, "x long, y long, count long, low long, high long")
    return made.groupBy("x", "y").agg(F.sum("count").alias("count"), F.min("low").alias("low"), F.max("high").alias("high"))


def _bits(lines: int) -> int:
    """Leading bits of a hash that tell its shard."""
    return min(MOST_SHARDS, max(1, -(-lines // SHARD_LINES)) * 2 - 1).bit_length() - 1


def _shard_of(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(x), np.int32)


_ARRAYS = "sizes array<int>, bits binary, fingerprint binary, count binary, first binary"


def line_index(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, int]:
    """The shards (shard, probes, sizes, bits, fingerprint, count, first) over lines that ``least`` documents hold, and the leading bits by which lines are dealt to them."""
    lines = durable(line_counts(docs).where(f"low < high AND count >= {least}"))
    bits = _bits(lines.count())
    shard = F.shiftrightunsigned("x", 64 - bits).cast("int") if bits else F.lit(0)

    def build(table: pa.Table) -> pa.Table:
        x, y = (table[c].to_numpy().view(np.uint64) for c in ("x", "y"))
        made = Shard.build(x, y, table["count"].to_numpy(), table["low"].to_numpy()).pack()
        kinds = (pa.list_(pa.int32()), *[pa.binary()] * 4)
        arrays = [pa.array([v], k) for v, k in zip(made, kinds, strict=True)]
        number = [pa.array([table["shard"][0].as_py()], pa.int32()), pa.array([int(table["count"].to_numpy().sum())], pa.int64())]
        return pa.table([*number, *arrays], names=["shard", "probes", "sizes", "bits", "fingerprint", "count", "first"])

    rows = lines.select(shard.alias("shard"), "x", "y", "count", "low")
    return durable(rows.groupBy("shard").applyInArrow(build, f"shard int, probes long, {_ARRAYS}")), bits


def _result(batch: pa.RecordBatch, a: int, offsets: np.ndarray, data: np.ndarray, lines: tuple[np.ndarray, ...], gone: np.ndarray, keep_text: bool) -> pa.RecordBatch:
    """Rows a and on of a batch whose first column is returned, without the lines that are gone."""
    text, starts, ends = lines
    rows = len(offsets) - 1
    total, dropped = np.bincount(text, minlength=rows), np.bincount(text, gone, rows).astype(np.int64)
    at = np.cumsum(total) - total
    digests, kept = [], []
    for i in range(rows):
        if dropped[i]:
            own = slice(at[i], at[i] + total[i])
            stay = ~gone[own]
            rest = b"\n".join([data[s:e].tobytes() for s, e in zip(starts[own][stay].tolist(), ends[own][stay].tolist(), strict=True)])
        else:
            rest = data[offsets[i] : offsets[i + 1]].tobytes()
        digests.append(hashlib.sha256(rest).hexdigest())
        if keep_text:
            kept.append(rest.decode("utf-8", "replace"))
    columns = [batch.column(0).slice(a, rows), pa.array(total.astype(np.int64)), pa.array(dropped), pa.array(digests, pa.string())]
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    return pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * keep_text, names=names + ["kept"] * keep_text)


def _dropped_lines(told: DataFrame, index: DataFrame, bits: int) -> DataFrame:
    """doc and the hashes of its lines that an earlier document has: hashes are dealt to the shards, hot shards over several tasks, and stream past the arrays."""
    spark = told.sparkSession
    pieces = np.ones(1 << bits, np.int64)
    for row in index.select("shard", "probes").collect():  # at most MOST_SHARDS
        pieces[row["shard"]] = -(-row["probes"] // PROBES)
    shared = spark.sparkContext.broadcast(pieces)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts_of(batch.column(1))
            docs_ = batch.column(0).to_numpy()
            for a, b in chunks(offsets):
                text, _, _, counts, x, y = split_lines(offsets[a : b + 1], data)
                doc, x, y = docs_[a + text[counts]], x[counts], y[counts]
                shard = _shard_of(x, bits)
                piece = (mix(doc.astype(np.uint64)) % shared.value[shard].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(piece), *(pa.array(v.view(np.int64)) for v in (x, y, doc))], names=["shard", "piece", "x", "y", "doc"])

    probes = told.select("doc", "text").mapInArrow(hashes, "shard int, piece int, x long, y long, doc long").distinct()
    copies = F.expr(f"sequence(0, cast(greatest(1, (probes + {PROBES - 1}) div {PROBES}) as int) - 1)")
    arrays = index.withColumn("piece", F.explode(copies)).drop("probes")
    rows = arrays.unionByName(probes, allowMissingColumns=True).repartition("shard", "piece").sortWithinPartitions("shard", "piece", F.col("sizes").isNull())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, arrays = None, None
        for batch in batches:
            shard, piece = batch["shard"].to_numpy(), batch["piece"].to_numpy()
            x, y, doc = (batch[c].fill_null(0).to_numpy() for c in ("x", "y", "doc"))
            heads = np.flatnonzero(batch["sizes"].is_valid().to_numpy(zero_copy_only=False))
            cuts = np.unique(np.concatenate(([0], np.flatnonzero((shard[1:] != shard[:-1]) | (piece[1:] != piece[:-1])) + 1, heads, heads + 1, [batch.num_rows])))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo in heads:
                    of, arrays = (shard[lo], piece[lo]), Shard.unpack([batch[c][lo].as_py() for c in ("sizes", "bits", "fingerprint", "count", "first")])
                elif of == (shard[lo], piece[lo]):
                    _, first = arrays.probe(x[lo:hi].view(np.uint64), y[lo:hi].view(np.uint64))
                    gone = lo + np.flatnonzero(first < doc[lo:hi])
                    if len(gone):
                        yield pa.RecordBatch.from_arrays([pa.array(v[gone]) for v in (doc, x, y)], names=["doc", "x", "y"])

    return rows.mapInArrow(answer, "doc long, x long, y long")


def drop_repeated_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS, keep_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (and the text that is kept, if asked for) of each row of docs(doc_id, text).

    A text's lines lie between line feeds; a line's key has ASCII white space stripped and A-Z lower-cased. Keys of
    LEAST_LENGTH code points or more that ``least`` documents hold lose their lines, all but those in the document with the
    smallest doc_id. What stays is joined by line feeds; nothing else changes.

    A null or empty text is one empty line. Rows that share a doc_id are one document: a line that only they hold stays, and
    where it stays, it stays in each of them; for ``least`` above 2 they count each. Rows whose doc_id is null are one document
    after all others. doc_id must be an integer. Keys are told apart by 128 bits of hash. Other columns aren't read.

    An index of up to FEW_BYTES travels to the documents, which then need no shuffle; for a larger one the hashes of
    lines travel to the shards, and what is to be dropped comes back by doc_id.
    """
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("doc_id must be an integer")
    spark = docs.sparkSession
    bounded_batches(spark)
    told = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"))
    index, bits = line_index(told, least)
    size = index.agg(F.sum(F.length("bits") + F.length("fingerprint") + F.length("count") + F.length("first"))).first()[0] or 0
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * keep_text
    if size <= FEW_BYTES:
        shared = spark.sparkContext.broadcast({r["shard"]: [list(r["sizes"]), *map(bytes, r[3:])] for r in index.collect()})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards = {k: Shard.unpack(v) for k, v in shared.value.items()}
            for batch in batches:
                offsets, data = texts_of(batch.column(1))
                doc = batch.column(2).to_numpy()
                for a, b in chunks(offsets):
                    text, starts, ends, counts, x, y = split_lines(offsets[a : b + 1], data)
                    gone, shard = np.zeros(len(text), bool), _shard_of(x, bits)
                    for k, arrays in shards.items():
                        at = np.flatnonzero(counts & (shard == k))
                        gone[at] = arrays.probe(x[at], y[at])[1] < doc[a + text[at]]
                    yield _result(batch, a, offsets[a : b + 1], data, (text, starts, ends), gone, keep_text)

        return told.mapInArrow(probe, schema)
    lists = _dropped_lines(told, index, bits).groupBy("doc").agg(F.collect_list(F.struct("x", "y")).alias("gone"))
    joined = told.join(lists, "doc", "left").select("doc_id", "text", "gone.x", "gone.y")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts_of(batch.column(1))
            for a, b in chunks(offsets):
                text, starts, ends, counts, x, y = split_lines(offsets[a : b + 1], data)
                gone = np.zeros(len(text), bool)
                for i in range(b - a):
                    lists = [batch.column(c)[a + i].values for c in (2, 3)]
                    if lists[0] is not None and len(lists[0]):
                        own = slice(*np.searchsorted(text, (i, i + 1)))
                        wanted = np.rec.fromarrays([v.to_numpy().view(np.uint64) for v in lists])
                        gone[own] = counts[own] & np.isin(np.rec.fromarrays([x[own], y[own]]), wanted)
                yield _result(batch, a, offsets[a : b + 1], data, (text, starts, ends), gone, keep_text)

    return joined.mapInArrow(drop, schema)


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return drop_repeated_lines(table(spark, sf_dir, "documents"))


_SPACE = "[\\x20\\x09-\\x0D]"
OP11_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, i, l[i + 1] AS line, translate(regexp_replace(l[i + 1], '^{_SPACE}+|{_SPACE}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split, unnest(range(len(l))) AS x(i)),
held AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= {LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}),
told AS (SELECT doc_id, i, line, coalesce(first < doc_id, false) AS gone FROM lines LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY doc_id
"""
