"""Ranked lexical search over a clustered index.

Recursive graph bisection puts documents that share terms next to each other: a set of documents is halved, and documents
change sides in pairs while that lowers the bits which the halves' postings would take. The upper levels are fitted on a
bounded sample, and every document goes down them by its own terms; the lower levels bisect blocks of neighbours. Runs
of the order are clusters. For each cluster and query the greatest share that each term can add gives a bound; clusters
are visited from the greatest bound on, until no bound reaches the score of the last place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_VALUE, LOWER, bounded_batches, chunks, durable, mix, range_hash, range_sums, spread_texts, texts_of

#: Results of a query.
TOP = 50
#: Documents of a cluster at most, and postings from which it ends earlier.
CLUSTER, CLUSTER_POSTINGS = 128, 1 << 20
#: Documents of a block that is bisected in one piece down to clusters.
ARRANGED = 2048
#: Documents on which the upper levels are fitted (about so many are drawn by hash, never twice as many), the most terms that such a one has, their levels, and the most weights of all their nodes.
SAMPLE, SAMPLE_TERMS, LEVELS, MOST_WEIGHTS = 8192, 1000, 6, 1 << 22
#: Rounds in which a bisection lets documents change sides.
SWAPS = 12
#: Terms of the queries that are answered at once; more queries are taken in blocks, one after the other.
QUERY_TERMS = 1 << 18
#: Clusters of each query in the first round of visits; each round takes GROWTH times as many as the one before.
FIRST_VISITS, GROWTH = 16, 8
#: Columns of the matrices that score a cluster.
COLUMNS, QUERIES = 4096, 256

#: ASCII letters and digits and all other characters beyond ASCII make terms.
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[97:123] = _TERM[128:] = True


def term_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each term of the texts in a row, A-Z lower-cased, and which text it is in."""
    body, edges = spread_texts(offsets, data)
    body = LOWER[body]
    edge = np.diff(np.concatenate(([False], _TERM[body], [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = mix(range_hash(range_sums(BYTE_VALUE[body]), starts, ends) + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(edges, starts, "right")


def query_terms(queries: DataFrame) -> DataFrame:
    """iid (a number of the row), item_id and the distinct terms of each of queries(item_id, text) that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts_of(batch.column(2))
            for a, b in chunks(offsets):
                h, owner = term_hashes(offsets[a : b + 1], data)
                terms = [np.unique(h[owner == i]).view(np.int64) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array(terms, pa.list_(pa.int64()))], names=["iid", "item_id", "terms"])

    rows = queries.select(F.monotonically_increasing_id().alias("iid"), "item_id", "text")
    made = rows.mapInArrow(run, f"iid long, item_id {queries.schema['item_id'].dataType.simpleString()}, terms array<long>")
    return durable(made.where(F.size("terms") > 0))


class Queries:
    """A block of queries: their distinct terms, sorted, and each query's terms as numbers in these."""

    def __init__(self, rows: list):
        self.iids = np.array([r["iid"] for r in rows], np.int64)
        terms = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
        self.vocabulary, flat = np.unique(np.concatenate(terms), return_inverse=True)
        self.flat = flat.astype(np.int32)
        self.ends = np.cumsum([0, *map(len, terms)])
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each term, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1).astype(np.int32)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def postings(docs: DataFrame, queries) -> DataFrame:
    """doc_id, n (terms of the whole text), and the numbers and counts of the queries' terms in it, of each document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        for batch in batches:
            offsets, data = texts_of(batch.column(1))
            for a, b in chunks(offsets):
                h, owner = term_hashes(offsets[a : b + 1], data)
                n = np.bincount(owner, minlength=b - a)
                number = own.numbers(h)
                hit = number >= 0
                key, count = np.unique((owner[hit] << 32) | number[hit], return_counts=True)
                ends = np.searchsorted(key >> 32, np.arange(b - a + 1))
                some = pa.array(n > 0)
                rows = [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), _lists(key & 0xFFFFFFFF, ends), _lists(count, ends)]
                yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "n", "terms", "counts"]).filter(some)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, counts array<int>")


def document_frequencies(held: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of the queries' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    found = held.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


def bisect(doc: np.ndarray, term: np.ndarray, n: int, rounds: int = SWAPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of n documents go to the right half, and the postings that each term has in either half.

    A posting is a pair of doc and term. The cost of a term with d postings in a half of m documents is d log2(m / (d + 1)).
    In each round the documents of both sides that gain most by a change trade places, as long as a pair gains.
    """
    v = int(term.max()) + 1 if len(term) else 0
    right = np.arange(n) >= n // 2
    every = np.bincount(term, minlength=v)
    halves = (n // 2, n - n // 2)

    def cost(d: np.ndarray, m: int) -> np.ndarray:
        d = np.maximum(d, 0)
        return d * np.log2(m / (d + 1))

    for _ in range(rounds):
        side = right[doc]
        there = np.bincount(term[side], minlength=v)
        here = every - there
        now = cost(here, halves[0]) + cost(there, halves[1])
        go = now - cost(here - 1, halves[0]) - cost(there + 1, halves[1])
        come = now - cost(here + 1, halves[0]) - cost(there - 1, halves[1])
        gain = np.bincount(doc, np.where(side, come[term], go[term]), n)
        left, other = np.flatnonzero(~right), np.flatnonzero(right)
        left, other = left[np.argsort(-gain[left], kind="stable")], other[np.argsort(-gain[other], kind="stable")]
        k = min(len(left), len(other))
        traded = int((gain[left[:k]] + gain[other[:k]] > 1e-9).sum())
        if not traded:
            break
        right[left[:traded]], right[other[:traded]] = True, False
    there = np.bincount(term[right[doc]], minlength=v)
    return right, every - there, there


def arrange(ends: np.ndarray, terms: np.ndarray, least: int = CLUSTER) -> np.ndarray:
    """The order of documents (document i has terms[ends[i]:ends[i + 1]]) by bisection down to ``least``."""
    n = len(ends) - 1
    out, open_ = [], [np.arange(n)]
    sizes = np.diff(ends)
    while open_:
        own = open_.pop()
        if len(own) <= least:
            out.append(own)
            continue
        doc = np.repeat(np.arange(len(own)), sizes[own])
        at = np.repeat(ends[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(len(doc))
        _, term = np.unique(terms[at], return_inverse=True)
        right, _, _ = bisect(doc, term, len(own))
        open_ += [own[right], own[~right]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Tree:
    """The upper levels: at each node a weight for each term and the sum of weights from which a document goes right."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, size: int):
        self.levels = max(0, min(LEVELS, int(np.log2(max(1, MOST_WEIGHTS // max(1, size))))))
        self.weights, self.cuts = np.zeros(((1 << self.levels) - 1, size), np.float32), np.zeros((1 << self.levels) - 1)
        sizes = np.diff(ends)
        own = {0: np.arange(len(ends) - 1)}
        for node in range(len(self.cuts)):
            docs = own.pop(node, np.zeros(0, np.int64))
            if len(docs) < 2 * CLUSTER // 4:
                continue  # no weights: all go right
            doc = np.repeat(np.arange(len(docs)), sizes[docs])
            at = np.repeat(ends[docs] - (np.cumsum(sizes[docs]) - sizes[docs]), sizes[docs]) + np.arange(len(doc))
            used, term = np.unique(terms[at], return_inverse=True)
            right, here, there = bisect(doc, term, len(docs))
            weight = np.log2((there + 1) / max(1, right.sum())) - np.log2((here + 1) / max(1, (~right).sum()))
            self.weights[node, used] = weight
            sums = np.bincount(doc, self.weights[node][terms[at]], len(docs))
            self.cuts[node] = np.median(sums)
            right = sums >= self.cuts[node]
            own[2 * node + 1], own[2 * node + 2] = docs[~right], docs[right]

    def route(self, ends: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each document, and by how much it went that way at the last node."""
        n = len(ends) - 1
        doc = np.repeat(np.arange(n), np.diff(ends))
        leaf, margin = np.zeros(n, np.int64), np.zeros(n)
        for _ in range(self.levels):
            margin = np.bincount(doc, self.weights[leaf[doc], terms], n) - self.cuts[leaf]
            leaf = 2 * leaf + 1 + (margin >= 0)
        return leaf.astype(np.int32), margin


def clusters_of(held: DataFrame, size: int, documents: int, words: int) -> DataFrame:
    """The clustered index of held (see postings): cluster, doc_ids, ends, terms and shares, a row for each cluster.

    A share is what a term adds to a document's score for a weight of one.
    """
    some = held.where(F.size("terms") > 0)
    share = int((1 << 30) * min(1.0, SAMPLE / max(1, documents)))
    drawn = some.where((F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << 30)) < share) & (F.size("terms") <= SAMPLE_TERMS))
    sample = drawn.select("terms").limit(2 * SAMPLE).toArrow()["terms"].combine_chunks()
    if isinstance(sample, pa.ChunkedArray):
        sample = sample.chunk(0) if sample.num_chunks else pa.array([], pa.list_(pa.int32()))
    ends = np.concatenate(([0], np.cumsum([len(x) for x in sample]))).astype(np.int64)
    tree = held.sparkSession.sparkContext.broadcast(Tree(ends, sample.flatten().to_numpy(), size))
    kind = held.schema["doc_id"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(2).offsets.to_numpy()
            leaf, margin = tree.value.route(offsets.astype(np.int64) - offsets[0], batch.column(2).flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(margin), *batch.columns], names=["leaf", "margin", "doc_id", "n", "terms", "counts"])

    routed = some.mapInArrow(route, f"leaf int, margin double, doc_id {kind}, n long, terms array<int>, counts array<int>")
    order = ["leaf", "margin", "doc_id"]
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), documents // 50_000)
    placed = routed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cluster(table: pa.Table) -> Iterator[pa.RecordBatch]:
        terms, counts = table["terms"].combine_chunks(), table["counts"].combine_chunks()
        sizes = np.diff(terms.offsets.to_numpy()).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        flat, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
        m = 50 + (50 * table["n"].to_numpy() * documents) // words
        shares = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, sizes))
        ids = table["doc_id"].combine_chunks()
        todo = arrange(ends, flat)
        while len(todo):
            total = np.cumsum(sizes[todo[:CLUSTER]])
            own = todo[: max(1, int(np.searchsorted(total, CLUSTER_POSTINGS, "right")))]
            todo = todo[len(own) :]
            at = np.repeat(ends[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(int(sizes[own].sum()))
            edges = np.concatenate(([0], np.cumsum(sizes[own])))
            one = np.array([0, len(own)], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(one), ids.take(pa.array(own))), pa.array([edges.astype(np.int32)], pa.list_(pa.int32())), pa.array([flat[at]], pa.list_(pa.int32())), pa.array([shares[at].astype(np.int32)], pa.list_(pa.int32()))],
                names=["doc_ids", "ends", "terms", "shares"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_, rows, postings_ = [], 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, CLUSTER):
                piece = batch.slice(lo, CLUSTER)
                held_.append(piece)
                rows += piece.num_rows
                postings_ += len(piece.column(4).flatten())
                if rows >= ARRANGED or postings_ >= CLUSTER_POSTINGS:
                    yield from cluster(pa.Table.from_batches(held_))
                    held_, rows, postings_ = [], 0, 0
        if rows:
            yield from cluster(pa.Table.from_batches(held_))

    made = placed.mapInArrow(cut, f"doc_ids array<{kind}>, ends array<int>, terms array<int>, shares array<int>")
    return durable(made.withColumn("cluster", F.monotonically_increasing_id()))


def cluster_bounds(clusters: DataFrame, queries) -> DataFrame:
    """cluster, iid and the most that a document of the cluster can score, where that is above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        weights, owner = own.weights[own.flat], np.repeat(np.arange(len(own.iids)), np.diff(own.ends))
        for batch in batches:
            for i, number in enumerate(batch.column(0).to_pylist()):
                most = np.zeros(len(own.vocabulary), np.int64)
                np.maximum.at(most, batch.column(1)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy())
                bound = np.zeros(len(own.iids), np.int64)
                np.add.at(bound, owner, weights * most[own.flat])
                at = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int64)), pa.array(own.iids[at]), pa.array(bound[at])], names=["cluster", "iid", "bound"])

    return durable(clusters.select("cluster", "terms", "shares").mapInArrow(run, "cluster long, iid long, bound long"))


def cluster_scores(ends: np.ndarray, terms: np.ndarray, shares: np.ndarray, queries: Queries, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of queries, and the score of each document of a cluster (rows) for each of these (columns)."""
    n = len(ends) - 1
    used, column = np.unique(terms, return_inverse=True)
    doc = np.repeat(np.arange(n), np.diff(ends))
    place = np.full(len(queries.vocabulary), -1, np.int64)
    place[used] = np.arange(len(used))
    longest = int(np.diff(queries.ends).max())
    exact = np.float64 if longest * int(queries.weights.max(initial=1)) * 1_000_000 < 1 << 53 else np.int64  # whole numbers up to 2^53 are exact in doubles
    for lo in range(0, len(wanted), QUERIES):
        own = wanted[lo : lo + QUERIES]
        sizes = np.diff(queries.ends)[own]
        at = np.repeat(queries.ends[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        term, query = queries.flat[at], np.repeat(np.arange(len(own)), sizes)
        row = place[term]
        term, query, row = term[row >= 0], query[row >= 0], row[row >= 0]
        out = np.zeros((n, len(own)), exact)
        for first in range(0, len(used), COLUMNS):
            a, b = (column >= first) & (column < first + COLUMNS), (row >= first) & (row < first + COLUMNS)
            width = min(COLUMNS, len(used) - first)
            x, w = np.zeros((n, width), exact), np.zeros((width, len(own)), exact)
            x[doc[a], column[a] - first] = shares[a]
            w[row[b] - first, query[b]] = queries.weights[term[b]]
            out += x @ w
        yield own, out.astype(np.int64)


def _best(rows: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("iid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, items: DataFrame, top: int) -> DataFrame | None:
    """iid, rank, doc_id and score for the queries of one block; None if nothing can be found."""
    context = docs.sparkSession.sparkContext
    rows = items.select("iid", "terms").collect()  # some QUERY_TERMS terms, or one query with more
    if not rows:
        return None
    own = Queries(rows)
    held = durable(postings(docs, context.broadcast(own)))
    whole = held.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    if not whole["n"]:
        return None
    df = document_frequencies(held, len(own.vocabulary))
    own.weights = np.floor(1000 * np.log((2 * whole["n"] + 2) / (2 * df + 1))).astype(np.int64)
    queries = context.broadcast(own)
    clusters = clusters_of(held, len(own.vocabulary), whole["n"], whole["l"])
    open_ = cluster_bounds(clusters, queries)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        number = {int(x): i for i, x in enumerate(q.iids)}
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ends, terms, shares = (batch.column(c)[i].values for c in range(4))
                visits = batch.column(4)[i].values
                wanted = np.array([number[x] for x in visits.field("iid").to_pylist()], np.int64)
                reach = dict(zip(wanted.tolist(), visits.field("least").to_pylist(), strict=True))
                for these, scores in cluster_scores(ends.to_numpy(), terms.to_numpy(), shares.to_numpy(), q, wanted):
                    found = []
                    for c, query in enumerate(these.tolist()):
                        column = scores[:, c]
                        at = np.flatnonzero(column >= reach[query])
                        if len(at) > top:  # documents that tie for the last place stay: doc_id decides later
                            at = at[column[at] >= np.partition(column[at], -top)[-top]]
                        found.append((np.full(len(at), q.iids[query]), at, column[at]))
                    iid, at, value = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(iid), ids.take(pa.array(at)), pa.array(value)], names=["iid", "doc_id", "score"])

    best, visits = None, FIRST_VISITS
    least = items.select("iid", F.lit(1).cast("long").alias("least"))
    while not open_.isEmpty():
        order = F.row_number().over(Window.partitionBy("iid").orderBy(F.desc("bound"), "cluster"))
        now = durable(open_.withColumn("k", order).where(F.col("k") <= visits).drop("k"))
        lists = now.join(least, "iid").groupBy("cluster").agg(F.collect_list(F.struct("iid", "least")).alias("visits"))
        found = clusters.join(lists, "cluster").select("doc_ids", "ends", "terms", "shares", "visits").mapInArrow(score, f"iid long, doc_id {kind}, score long")
        best = durable(_best(found if best is None else best.drop("rank").union(found), top))
        last = best.groupBy("iid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
        least = durable(items.select("iid").join(last, "iid", "left").select("iid", F.when(F.col("n") >= top, F.col("s")).otherwise(1).cast("long").alias("least")))
        # a bound that equals the last place's score may stand for an equal score with a smaller doc_id
        open_ = durable(open_.join(now.select("cluster", "iid"), ["cluster", "iid"], "left_anti").join(least, "iid").where("bound >= least").select("cluster", "iid", "bound"))
        visits *= GROWTH
    return best


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score: the ``top`` best documents of docs(doc_id, text) for each of queries(item_id, text).

    Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII in the whole text, with A-Z
    lower-cased, told apart by 64-bit hashes. A document's score is the sum of w * ((1000000000 * tf) div (1000 * tf + 20 * m))
    over the query's distinct terms, in whole numbers; w is floor(1000 ln((2 N + 2) / (2 df + 1))) and m is
    50 + (50 n N) div L. Only scores above 0 count; equal ones go by doc_id, nulls last.

    Null and empty texts, and such without a term, are no documents for N and L, and find nothing as queries. Each row of
    docs is a document, and each row of queries a query of its own. Empty tables give no rows. Other columns aren't read.
    The upper levels of the order are fitted on about SAMPLE documents; all are indexed, and results don't depend on the order.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = query_terms(queries)
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // QUERY_TERMS)
    block = F.pmod(F.xxhash64("iid"), F.lit(max(1, blocks)))
    found = [r for b in range(blocks) if (r := _search_block(docs, items.where(block == b), top)) is not None]
    kind = queries.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    if not found:
        return spark.createDataFrame([], f"item_id {kind[0]}, rank int, doc_id {kind[1]}, score long")
    return reduce(DataFrame.union, found).join(items.select("iid", "item_id"), "iid").select("item_id", "rank", "doc_id", "score")


def op12_clustered_search(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOW}, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"
OP12_SQL = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
a AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM d),
m AS (SELECT doc_id, 50 + (50 * n * nn) // l AS m FROM d, a),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w FROM df, a),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {TOP}
"""
