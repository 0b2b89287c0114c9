"""Duplicated blocks: winnowed fingerprints of token runs, an equi-join on them, and exact extension of each match."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import FNV_OFFSET, FNV_PRIME, TOKEN
from tessera.operators.hot_keys import HOT_ROWS, PIECE_ROWS, join_hot
from tessera.operators.languages import PLAIN, UNKNOWN_COMMENTS
from tessera.session import bounded_batches, kept

# Bases of the two rolling hashes, and places of a fingerprint that are kept.
BASE_1, BASE_2 = 0x01000193, 0x5BD1E995
MOST_OCCURRENCES = 64
#: Words whose hashes a worker remembers.
WORDS_KNOWN = 1 << 17
#: Classes under a fingerprint from which they meet in several tasks, and classes of a piece; copies that are written out together.
MEET_ROWS, MEET_PIECE, COPIES = 2_000, 1_000, 256


def window_sizes(threshold: int) -> tuple[int, int]:
    """Tokens in a k-gram and k-grams in a window, so that any shared run of ``threshold`` tokens has a common fingerprint."""
    k = max(5, min(20, threshold // 2))
    return k, max(1, threshold - k + 1)


def fnv1a(word: str) -> int:
    h = FNV_OFFSET
    for c in np.frombuffer(word.encode("utf-16-le"), np.uint16).tolist():
        h = ((h ^ c) * FNV_PRIME) & 0xFFFFFFFF
    return h


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i below n, modulo 2^32."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        steps = [np.full(max(n, 1 << 12), x, np.uint32) for x in (base, pow(base, -1, 1 << 32))]
        for x in steps:
            x[0] = 1
        have = _POWERS[base] = tuple(np.cumprod(x, dtype=np.uint32) for x in steps)
    return have[0][:n], have[1][:n]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def kgram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """h1 * 2^21 + (h2 >> 11) for each run of k tokens, both polynomials modulo 2^32: each from two prefix sums."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out, own = [], ids.astype(np.uint32)
    for base in (BASE_1, BASE_2):
        up, down = _powers(base, len(ids))
        sums = np.concatenate((np.zeros(1, np.uint32), np.cumsum(own * down, dtype=np.uint32)))
        out.append(((sums[k:] - sums[:-k]) * up[k - 1 :]).astype(np.uint64))
    return (out[0] * np.uint64(1 << 21) + (out[1] >> np.uint64(11))).astype(np.int64)


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the rightmost least hash of each window of w, without repeats; a shorter list gives one."""
    return winnow_lists(hashes, np.array([len(hashes)]), w)[0]


def winnow_lists(hashes: np.ndarray, sizes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of winnow() in each of the lists that lie in ``hashes`` one after the other, and the number of the list of each.

    Least hashes of windows are made from those of halves, so that memory is some words a hash, whatever w.
    """
    sizes = np.asarray(sizes, np.int64)
    ends = np.cumsum(sizes)
    starts, n, at = ends - sizes, len(hashes), np.arange(len(hashes))
    found = np.zeros(0, np.int64)
    if n >= w:
        least, place, span = hashes, at, 1
        while span < w:
            step = min(span, w - span)
            later = least[step:] <= least[:-step]
            least, place = np.where(later, least[step:], least[:-step]), np.where(later, place[step:], place[:-step])
            span += step
        place = place[at[: n - w + 1] + w <= np.repeat(ends, sizes)[: n - w + 1]]
        found = place[np.diff(place, prepend=-1) > 0]
    short = np.flatnonzero((sizes > 0) & (sizes < w))
    if len(short):
        some = np.flatnonzero(sizes > 0)
        low = np.repeat(np.minimum.reduceat(hashes, starts[some]), sizes[some])
        last = np.maximum.reduceat(np.where(hashes == low, at, -1), starts[some])
        found = np.sort(np.concatenate((found, last[sizes[some] < w])))
    lists = np.searchsorted(ends, found, "right")
    return found - starts[lists], lists


_LINE_END = -1


class _Known(dict):
    """The hashes of words seen so far; the end of a line counts as -1."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_KNOWN:
            self.clear()
        h = self[word] = _LINE_END if word == "\n" else fnv1a(word)
        return h


def token_arrays(files: DataFrame) -> DataFrame:
    """path, ids and lines: the tokens of a file's code lines as 32-bit hashes, and the line of each.

    Rows are independent. A null text has no tokens.
    """
    pattern = re.compile(f"\n|{TOKEN}", re.ASCII)  # no token crosses a line's end
    prefixes = {k: tuple(c) for k, (_, c, _) in PLAIN.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            ids, lines = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                skip = prefixes.get(re.sub("^(tier2|notebook):", "", key or ""), tuple(UNKNOWN_COMMENTS))
                code = [(i, line) for i, line in enumerate(re.split("\r?\n", text or "")) if (t := line.strip()) and not t.startswith(skip)]
                words = pattern.findall("\n".join(line for _, line in code))
                own = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                ends = own == _LINE_END
                ids.append(own[~ends])
                lines.append(np.array([i for i, _ in code], np.int32)[np.cumsum(ends)[~ends]])
            at = pa.array(np.cumsum([len(x) for x in ids]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (ids, lines))], names=["path", "ids", "lines"])

    bounded_batches(files.sparkSession)
    return files.select("path", "language_key", "text").mapInArrow(run, "path string, ids array<long>, lines array<int>")


def fingerprints(tokens: DataFrame, threshold: int = 100) -> DataFrame:
    """path, pos and hash of each file's winnowed fingerprints; tokens(path, ids)."""
    k, w = window_sizes(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            hashes = kgram_hashes(lists.flatten().to_numpy(zero_copy_only=False), k)  # of all files, then without those across two
            inside = np.arange(len(hashes)) + k <= np.repeat(ends, sizes)[: len(hashes)]
            hashes, grams = hashes[inside], np.maximum(sizes - k + 1, 0)
            pos, files = winnow_lists(hashes, grams, w)
            found = hashes[(np.cumsum(grams) - grams)[files] + pos]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(files)), pa.array(pos.astype(np.int32)), pa.array(found)], names=["path", "pos", "hash"])

    bounded_batches(tokens.sparkSession)
    return tokens.select("path", "ids").mapInArrow(run, "path string, pos int, hash long")


def cap_occurrences(prints: DataFrame, most: int = MOST_OCCURRENCES) -> DataFrame:
    """The first places of each fingerprint by path and position. The limit is taken in each task before the shuffle, so a hot fingerprint is cut down where it is read."""
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("path", "pos"))
    return prints.withColumn("__n", rank).where(F.col("__n") <= most).drop("__n")


def seeds(prints: DataFrame, most: int = MOST_OCCURRENCES) -> DataFrame:
    """path, pos, partner, partner_pos: each fingerprint with the kept places of an equal one elsewhere.

    A fingerprint that very many files have, as boilerplate does, is joined over several tasks.
    """
    prints = kept(prints)  # of narrow rows; looked at for hot ones, for places and for the join
    places = cap_occurrences(prints, most).select("hash", F.col("path").alias("partner"), F.col("pos").alias("partner_pos"))
    return join_hot(prints, places, "hash", "path", "pos", least=HOT_ROWS, piece=PIECE_ROWS).where("path <> partner OR pos <> partner_pos").select("path", "pos", "partner", "partner_pos")


def places_by_path(prints: DataFrame, most: int = MOST_OCCURRENCES) -> tuple[DataFrame, DataFrame]:
    """How often each file has each fingerprint, (hash, path, n), and how many of these places are kept, (hash, partner, m); files without a kept one are left out of the latter.

    The first ``most`` places lie in the first ``most`` files, so as many rows are cut in each task before the shuffle.
    """
    own = kept(prints.where("hash IS NOT NULL").groupBy("hash", "path").agg(F.count(F.lit(1)).alias("n")))
    by_path = Window.partitionBy("hash").orderBy("path")
    first = own.withColumn("__k", F.row_number().over(by_path)).where(F.col("__k") <= most)
    left = most - F.coalesce(F.sum("n").over(by_path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own, first.withColumn("m", F.least("n", left)).where("m > 0").select("hash", F.col("path").alias("partner"), "m")


def meetings(own: DataFrame, places: DataFrame) -> DataFrame:
    """hash, path, n, partner and m wherever two files, or a file and itself, meet under a fingerprint: one row, however often either has it. Of places_by_path()."""
    return join_hot(own, places, "hash", "path", least=HOT_ROWS, piece=PIECE_ROWS)


def clone_pairs(prints: DataFrame, most: int | None = MOST_OCCURRENCES) -> DataFrame:
    """Pairs of paths that share a fingerprint, and how many: each place of the one with the kept places of the other; with ``most`` None, with all of them."""
    if most is None:
        return every_pair(prints)
    return meetings(*places_by_path(prints, most)).where("path < partner").groupBy("path", "partner").agg(F.sum(F.col("n") * F.col("m")).alias("shared"))


def every_pair(prints: DataFrame) -> DataFrame:
    """path, partner, shared: all pairs of paths that share a fingerprint, and how many places of theirs meet.

    Files with the same fingerprints, each as often, are one class, which goes by its first path. Classes meet under a
    fingerprint, and only the pairs of classes are summed; those with copies are then written out by blocks of both sides.
    So copies cost no more than the rows that they return.
    """
    rows = prints.where("path IS NOT NULL AND hash IS NOT NULL").repartition("path").groupBy("path", "hash").agg(F.count(F.lit(1)).alias("n"))
    bags = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("hash", "n"))).alias("bag"))
    files = kept(bags.select("path", F.unhex(F.sha2(F.col("bag").cast("string"), 256)).alias("kind"), F.col("bag.hash").alias("hashes"), F.col("bag.n").alias("counts")))
    parts = F.expr(f"cast(if(count(1) > 1, (count(1) + {COPIES - 1}) div {COPIES}, 0) as int)")  # blocks of copies; 0 where there is one file
    classes = kept(files.groupBy("kind").agg(F.min("path").alias("path"), parts.alias("parts"), F.first("hashes").alias("hashes"), F.first("counts").alias("counts")))
    own = classes.select("path", "parts", "counts", F.posexplode("hashes").alias("i", "hash")).select("hash", "path", "parts", F.expr("counts[i]").alias("n"))
    single, many = F.col("parts") == 0, F.col("parts") > 0
    other = lambda some: some.select("hash", F.col("path").alias("partner"), F.col("parts").alias("partner_parts"), F.col("n").alias("m"))
    shared = F.sum(F.col("n") * F.col("m")).alias("shared")
    plain = join_hot(own.where(single), other(own.where(single)), "hash", "path", least=MEET_ROWS, piece=MEET_PIECE).where("path < partner").groupBy("path", "partner").agg(shared)

    # of pairs with a class of copies, that class is the partner; it meets itself, too
    met = join_hot(own, other(own.where(many)), "hash", "path", least=MEET_ROWS, piece=MEET_PIECE).where("parts = 0 OR path <= partner")
    met = met.groupBy("path", "parts", "partner", "partner_parts").agg(shared)
    told = files.select("path", "kind").join(classes.where(many).select("kind", F.col("path").alias("first"), "parts"), "kind")
    blocks = kept(told.groupBy("first", F.expr("cast(pmod(xxhash64(path), parts) as int)").alias("part")).agg(F.collect_list("path").alias("copies")))
    side = lambda first, part, copies: blocks.select(F.col("first").alias(first), F.col("part").alias(part), F.col("copies").alias(copies))
    cells = met.withColumn("part", F.explode(F.expr("sequence(0, greatest(parts - 1, 0))"))).withColumn("partner_part", F.explode(F.expr("sequence(0, partner_parts - 1)")))
    cells = cells.where("path <> partner OR part <= partner_part")
    filled = cells.join(side("path", "part", "a"), ["path", "part"], "left").join(side("partner", "partner_part", "b"), ["partner", "partner_part"])
    written = filled.withColumn("x", F.explode(F.when(single, F.array("path")).otherwise(F.col("a")))).withColumn("y", F.explode("b")).where("path <> partner OR part <> partner_part OR x < y")
    return plain.union(written.select(F.least("x", "y").alias("path"), F.greatest("x", "y").alias("partner"), "shared"))


def affected_paths(prints: DataFrame, changed: DataFrame) -> DataFrame:
    """Paths whose blocks may change with those in changed(path): they, and all that share a fingerprint with them."""
    prints = kept(prints)  # used twice, made once
    hashes = prints.join(changed, "path", "left_semi").select("hash").distinct()
    return prints.join(hashes, "hash", "left_semi").select("path").union(changed.select("path")).distinct()


def _extend(a: np.ndarray, b: np.ndarray, i: int, j: int, k: int) -> tuple[int, int, int] | None:
    """Start, end and partner's start of the longest equal run around a[i:i+k] and b[j:j+k]; None if these differ."""
    if not np.array_equal(a[i : i + k], b[j : j + k]):
        return None
    n = min(i, j)
    differ = np.flatnonzero(a[i - n : i][::-1] != b[j - n : j][::-1])
    back = int(differ[0]) if len(differ) else n
    m = min(len(a) - i, len(b) - j)
    differ = np.flatnonzero(a[i : i + m] != b[j : j + m])
    return i - back, i + (int(differ[0]) if len(differ) else m), j - back


def _packed(tokens: DataFrame, threshold: int) -> DataFrame:
    """tokens(path, ids, lines) as 32-bit words in ``ids``, the lines that have tokens in ``line`` and the tokens up to the end of each in ``upto``, and the file's fingerprints in ``pos`` and ``hash``."""
    k, w = window_sizes(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ids, lines in zip(batch.column(1), batch.column(2), strict=True):
                own = np.asarray(ids.values if ids.is_valid else [], np.int64)
                at = np.asarray(lines.values if lines.is_valid else [], np.int32)[: len(own)]
                ends = np.append(np.flatnonzero(np.diff(at)), len(at) - 1) if len(at) else np.zeros(0, np.int64)
                hashes = kgram_hashes(own, k)
                pos = winnow(hashes, w)
                rows.append((own.astype("<u4").tobytes(), at[ends], ends + 1, pos, hashes[pos]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["path", "ids", "line", "upto", "pos", "hash"])

    bounded_batches(tokens.sparkSession)
    return tokens.select("path", "ids", "lines").mapInArrow(run, "path string, ids binary, line array<int>, upto array<int>, pos array<int>, hash array<long>")


class _Side:
    """A file of a pair: its tokens, lines and fingerprints, and of each of these the places that are kept."""

    def __init__(self, path: str, ids: pa.Scalar, line: pa.Scalar, upto: pa.Scalar, pos: pa.Scalar, hashes: pa.Scalar, cut: pa.Scalar):
        self.path, self.ids = path, np.frombuffer(ids.as_buffer(), "<u4")
        self.line, self.upto = np.asarray(line.values), np.asarray(upto.values)
        self.pos, self.hashes = np.asarray(pos.values).tolist(), np.asarray(hashes.values).tolist()
        self.cut = {c["hash"]: c["m"] for c in cut.as_py()} if cut.is_valid else {}

    def line_of(self, token: int) -> int:
        return int(self.line[np.searchsorted(self.upto, token, "right")])

    def places(self, wanted: set[int]) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for p, h in zip(self.pos, self.hashes, strict=True):
            if h in wanted:
                out.setdefault(h, []).append(p)
        return {h: at[: self.cut.get(h, len(at))] for h, at in out.items()}


def _matches(a: _Side, b: _Side, k: int, threshold: int) -> Iterator[tuple]:
    """path, pos, partner, partner_pos, s, e and partner_line: for each place of a the first of its matches in b, by partner_pos."""
    there, known = b.places(set(a.hashes)), {}
    for pos, h in zip(a.pos, a.hashes, strict=True):
        for other in there.get(h, ()):
            if a.path == b.path and other == pos:
                continue
            found = known.get(other - pos)  # seeds on one diagonal mostly lie in one match
            if found is None or not found[0] <= pos <= found[1] - k:
                found = known[other - pos] = _extend(a.ids, b.ids, pos, other, k)
            if found is None or found[1] - found[0] < threshold:
                continue
            start, end, at = found
            if a.path == b.path and at < end and start < at + end - start:
                continue
            yield a.path, pos, b.path, other, start, end, b.line_of(at)
            break


def clone_blocks(tokens: DataFrame, threshold: int = 100) -> DataFrame:
    """path, start_line, end_line, tokens, partner_path and partner_line of each file's duplicated blocks.

    tokens(path, ids, lines) as token_arrays() gives them; paths are distinct. Matches are extended pair by pair of
    files, then each file takes its own, from the first fingerprint on: one inside a block that is already found is
    passed over, and the first partner by path and position that gives a block of ``threshold`` tokens is taken. Blocks
    that touch are merged and keep the first partner. Copies within a file must not overlap.

    What is shuffled is each pair of files once, with the tokens of one of them; its places meet again in the task.
    """
    k, _ = window_sizes(threshold)
    files = kept(_packed(tokens, threshold))
    own, places = places_by_path(files.select("path", F.explode("hash").alias("hash")))
    met = meetings(own, places).where("path <> partner OR n > 1")
    pairs = met.select(F.least("path", "partner").alias("path"), F.greatest("path", "partner").alias("partner")).distinct()
    frequent = own.groupBy("hash").agg(F.sum("n").alias("all")).where(F.col("all") > MOST_OCCURRENCES).select("hash")
    held = own.join(frequent, "hash", "left_semi").join(places.withColumnRenamed("partner", "path"), ["hash", "path"], "left").where("m IS NULL OR m < n")
    cut = held.groupBy("path").agg(F.collect_list(F.struct("hash", F.coalesce("m", F.lit(0)).cast("int").alias("m"))).alias("cut"))
    files = files.join(cut, "path", "left")
    sides = ["ids", "line", "upto", "pos", "hash", "cut"]
    one = files.select("path", *(F.col(c).alias(f"a_{c}") for c in sides))
    two = files.select(F.col("path").alias("partner"), *(F.col(c).alias(f"b_{c}") for c in sides))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, partner, *both in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                a, b = _Side(path, *both[:6]), _Side(partner, *both[6:])
                rows += _matches(a, b, k, threshold)
                if path != partner:
                    rows += _matches(b, a, k, threshold)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "pos", "partner", "partner_pos", "s", "e", "partner_line"])

    met_files = pairs.join(one, "path").join(two, "partner").select("path", "partner", *(f"a_{c}" for c in sides), *(f"b_{c}" for c in sides))
    matches = met_files.mapInArrow(extend, "path string, pos int, partner string, partner_pos int, s int, e int, partner_line int")
    line = lambda token: F.element_at("line", F.size(F.filter("upto", lambda x: x <= token)) + 1)
    return covering_blocks(matches).join(files.select("path", "line", "upto"), "path").select(
        "path", line(F.col("s")).alias("start_line"), line(F.col("e") - 1).alias("end_line"), (F.col("e") - F.col("s")).alias("tokens"),
        F.col("partner").alias("partner_path"), "partner_line",
    )


def covering_blocks(matches: DataFrame) -> DataFrame:
    """path, s, e, partner, partner_line: the blocks that a file takes of its matches(path, pos, partner, partner_pos, s, e, partner_line).

    In the order of pos, every match reaches from before its pos to its end, so one is passed over if its pos lies
    before the furthest end that was taken so far. Blocks taken are then islands over their ends, by start.
    """
    order = F.sort_array(F.collect_list(F.struct("pos", "partner", "partner_pos", "s", "e", "partner_line")))
    block = lambda x: F.struct(x["s"].alias("s"), x["pos"].alias("pos"), x["e"].alias("e"), x["partner"].alias("partner"), x["partner_line"].alias("partner_line"))
    none = F.expr("cast(array() as array<struct<s:int,pos:int,e:int,partner:string,partner_line:int>>)")
    take = lambda acc, x: F.when(x["pos"] >= acc["reach"], F.struct(F.greatest(acc["reach"], x["e"]).alias("reach"), F.concat(acc["taken"], F.array(block(x))).alias("taken"))).otherwise(acc)
    taken = F.aggregate(order, F.struct(F.lit(0).alias("reach"), none.alias("taken")), take, lambda acc: acc["taken"])
    rows = matches.groupBy("path").agg(F.array_sort(taken).alias("taken")).select("path", F.posexplode("taken").alias("n", "x")).select("path", "n", "x.*")
    by_start = Window.partitionBy("path").orderBy("n")
    before = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("s") <= F.col("before"), 0).otherwise(1)).over(by_start)
    grouped = rows.withColumn("before", before).withColumn("island", island).groupBy("path", "island")
    return grouped.agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by(F.struct("partner", "partner_line"), "n").alias("p")).select("path", "s", "e", "p.partner", "p.partner_line")


def with_blocks(analysis: DataFrame, blocks: DataFrame) -> DataFrame:
    """analysis with its blocks as an array; empty where there are none."""
    lists = blocks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "tokens", "partner_path", "partner_line"))).alias("blocks"))
    joined = analysis.join(lists, "path", "left")
    return joined.withColumn("blocks", F.coalesce("blocks", F.expr("cast(array() as array<struct<start_line:int,end_line:int,tokens:int,partner_path:string,partner_line:int>>)")))
