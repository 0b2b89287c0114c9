"""Byte-level BPE with a two-tier lookup: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

The usual pattern of pre-tokens is one over runs of letters, digits, white space and the rest, so boundaries of all texts of
a batch are found at once from the classes of their bytes; other patterns go through a regex.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import BYTE_VALUE, IS_SPACE, bounded_batches, chunks, mix, range_hash, range_sums, texts_of

#: Bytes of text that are encoded at once; a longer text is cut where white space begins, which is always a boundary.
PIECE_BYTES = 1 << 19
#: Encodings of pre-tokens outside the vocabulary that a worker remembers: twice as many, the older half goes first.
MEMORY = 200_000
#: Fixed value: the pattern whose boundaries boundaries() finds.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _SPACE = 1, 3


def char_classes() -> np.ndarray:
    """1 for letters, 2 for digits, 3 for white space and 0 for the rest, of each code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(len(every), np.uint8)
    for k, kind in ((_LETTER, r"\p{L}+"), (2, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(kind, every):
            out[m.start() : m.end()] = k
    return np.concatenate((out[:0xD800], np.zeros(0x800, np.uint8), out[0xD800:]))


def byte_classes(body: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 is a part of."""
    out = classes[:256][body]
    lead = np.flatnonzero(body >= 0xC0)
    if len(lead):
        padded = np.concatenate((body, np.zeros(3, np.uint8)))
        b0, b1, b2, b3 = (padded[lead + j].astype(np.int32) for j in range(4))
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        point = np.where(size == 2, (b0 & 31) << 6 | b1 & 63, np.where(size == 3, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
        k = classes[np.minimum(point, 0x10FFFF)]
        out[lead] = k
        for j in (1, 2, 3):
            long = size > j
            out[np.minimum(lead[long] + j, len(out) - 1)] = k[long]
    return out


def boundaries(body: np.ndarray, texts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens by RUNS begin in the texts that lie in a row in ``body``, text i from texts[i] on.

    A pre-token is a run of one class, with a blank before it that ends a run of white space. Of a longer run of white
    space the rest is one by itself; one that ends a text stays whole. After an apostrophe that stands alone and has no
    such blank, the ending s, t, m, d, re, ve or ll is cut off from the letters that follow.
    """
    n = len(body)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(body, classes)
    first = np.zeros(n + 1, bool)
    first[texts] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    a, b = runs[:-1], runs[1:]
    inner = (kind[a] == _SPACE) & ~first[b]
    a, b = a[inner], b[inner]
    last = b - 1
    while (part := body[last] & 0xC0 == 0x80).any():
        last = last - part
    start[last] = True
    start[b[body[last] == 32]] = False
    q = np.flatnonzero((body == 39) & start[:n])
    ahead = np.concatenate((body, np.zeros(3, np.uint8)))
    letter = np.concatenate((kind == _LETTER, np.zeros(3, bool))) & ~np.concatenate((first[:n], np.ones(3, bool)))
    one = letter[q + 1] & np.isin(ahead[q + 1], np.frombuffer(b"stmd", np.uint8))
    x, y = ahead[q + 1], ahead[q + 2]
    two = letter[q + 1] & letter[q + 2] & (((y == 101) & ((x == 114) | (x == 118))) | ((x == 108) & (y == 108)))
    start = np.concatenate((start, np.zeros(3, bool)))
    for at, size in ((q[one], 2), (q[two], 3)):
        start[at + 1] = False
        rest = at + size
        start[rest[letter[rest]]] = True
    return np.flatnonzero(start[:n])


class PerfectHash:
    """A minimal perfect hash over distinct byte strings, by hash and displace.

    Buckets of about two keys are placed from the largest down, each with the first displacement that hits free slots
    only; buckets of one key take any free slot, which is stored in place of a displacement. As many slots as keys.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.keys = len(keys), keys
        self.buckets = max(1, self.n // 2)
        h = self.hashes(np.cumsum([0, *map(len, keys)]), np.frombuffer(b"".join(keys), np.uint8))
        if len(np.unique(h)) < self.n:
            raise ValueError("two keys have one 64-bit hash")
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot = np.full(self.n, -1, np.int64)
        free = np.ones(self.n, bool)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order, size = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(size) - size
        trials = np.arange(1, 65)
        for b in np.argsort(-size, kind="stable")[: int((size > 1).sum())].tolist():
            members = order[first[b] : first[b] + size[b]]
            d = trials
            while True:
                at = np.sort(self._slots(h[members][None, :], d[:, None]), axis=1)
                fits = free[at].all(1) & (np.diff(at, axis=1) > 0).all(1)
                if fits.any():
                    break
                d = d + len(trials)
            shift = int(d[fits.argmax()])
            at = self._slots(h[members], shift)
            free[at], self.shift[b], self.slot[at] = False, shift, members
        alone = np.flatnonzero(size == 1)
        at = np.flatnonzero(free)[: len(alone)]
        self.shift[alone], self.slot[at] = -at - 1, order[first[alone]]

    @staticmethod
    def hashes(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        offsets = np.asarray(offsets, np.int64)
        sums = range_sums(BYTE_VALUE[data]) if len(data) else np.zeros(1, np.uint64)
        return mix(range_hash(sums, offsets[:-1], offsets[1:]) + np.diff(offsets).astype(np.uint64))

    def _slots(self, h: np.ndarray, d) -> np.ndarray:
        return (mix(h + np.uint64(0x9E3779B97F4A7C15) * np.asarray(d, np.uint64)) % np.uint64(self.n)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """For the hash of each string the only key that it can be; the caller compares."""
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.slot[np.where(d < 0, -d - 1, self._slots(h, np.maximum(d, 0)))]


def merge_bytes(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """BPE of one pre-token: always join the leftmost pair of lowest rank. ``pairs`` has the rank of each two bytes, or -1.

    Parts form a linked list over the bytes; pairs wait in a heap as rank * n + start. A pair that has changed since it
    was put there no longer has that rank in ``pair`` and is passed over. A part's rank is its id.
    """
    n, get = len(piece), ranks.get
    pair = [pairs[x << 8 | y] for x, y in zip(piece, piece[1:])]  # noqa: RUF007
    pair.append(-1)
    heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
    if not heap:
        return [ranks[piece[i : i + 1]] for i in range(n)]
    after, before, ids = list(range(1, n + 2)), list(range(-1, n)), [-1] * n
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i = top % n
        rank = pair[i]
        if rank * n + i != top:
            continue
        ids[i] = rank
        gone = after[i]
        end = after[gone]
        pair[gone], after[i] = -1, end
        if end < n:
            before[end] = i
            pair[i] = r = get(piece[i : after[end]], -1)
            if r >= 0:
                push(heap, r * n + i)
        else:
            pair[i] = -1
        left = before[i]
        if left >= 0:
            pair[left] = r = get(piece[left:end], -1)
            if r >= 0:
                push(heap, r * n + left)
    out, i = [], 0
    while i < n:
        out.append(ids[i] if ids[i] >= 0 else ranks[piece[i : i + 1]])
        i = after[i]
    return out


class Tokenizer:
    """Encoder and decoder of one vocabulary file in tiktoken's format (base64 of the bytes, a space, the rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
        self.pattern, self.keys = pattern, [k for k, _ in pairs]
        self.rank = np.array([r for _, r in pairs], np.int64)
        self.first = PerfectHash(self.keys)
        size = int(self.rank.max()) + 1
        place = np.full(size, -1, np.int64)
        place[self.rank] = np.arange(len(pairs))
        length = np.array([len(k) for k in self.keys], np.int64)
        self._flat = np.frombuffer(b"".join(self.keys), np.uint8)
        starts = np.cumsum(length) - length
        self._key_length, self._key_start = length, starts
        self.classes = char_classes() if pattern == RUNS else None
        self._length = np.where(place >= 0, length[place], 0)
        self._start = np.where(place >= 0, starts[place], 0)
        self._ready()

    def _ready(self) -> None:
        self.ranks = dict(zip(self.keys, self.rank.tolist(), strict=True))
        self.pairs = [-1] * 65536
        for key, rank in self.ranks.items():
            if len(key) == 2:
                self.pairs[key[0] << 8 | key[1]] = rank
        self.split = regex.compile(self.pattern)
        self.seen: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("ranks", "pairs", "split", "seen", "older")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pre-tokens in a row, where each begins (and the end), and how many each text has."""
        if self.classes is not None:
            ends = np.cumsum([0, *map(len, texts)])
            body = np.frombuffer(b"".join(texts), np.uint8)
            starts = boundaries(body, ends[:-1], self.classes)
            return body, np.append(starts, len(body)), np.diff(np.searchsorted(starts, ends))
        found = [self.split.findall(t.decode("utf-8", "replace")) for t in texts]
        flat = [p.encode() for text in found for p in text]
        return np.frombuffer(b"".join(flat), np.uint8), np.cumsum([0, *map(len, flat)]), np.array([len(x) for x in found], np.int64)

    def _new(self, piece: bytes) -> bytes:
        """Ids of a pre-token that isn't among those seen lately, as 32-bit numbers; it is from now on."""
        got = self.older.get(piece)
        if got is None:
            got = np.array(merge_bytes(piece, self.ranks, self.pairs), np.uint32).tobytes()
        if len(piece) <= 64:
            if len(self.seen) >= MEMORY:
                self.older, self.seen = self.seen, {}
            self.seen[piece] = got
        return got

    def ids(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in a row, and how many each has; pre-token i is body[offsets[i]:offsets[i + 1]]."""
        size = np.diff(offsets)
        if not len(size):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        h = self.first.hashes(offsets, body)
        guess = self.first.find(h)
        long = np.flatnonzero(self._key_length[guess] == size)
        equal = body[_spread(offsets[:-1][long], size[long])] == self._flat[_spread(self._key_start[guess[long]], size[long])]
        known = np.zeros(len(size), bool)
        if len(long):
            known[long] = np.logical_and.reduceat(equal, np.cumsum(size[long]) - size[long])
        other = np.flatnonzero(~known)
        _, one, which = np.unique(h[other], return_index=True, return_inverse=True)
        same = other[one][which]
        if (size[other] != size[same]).any() or (body[_spread(offsets[:-1][other], size[other])] != body[_spread(offsets[:-1][same], size[same])]).any():
            one = which = np.arange(len(other))  # two pre-tokens have one hash: each by itself
        raw = body.tobytes()
        a, b = offsets[:-1][other[one]].tolist(), offsets[1:][other[one]].tolist()
        made = [self.seen.get(piece := raw[x:y]) or self._new(piece) for x, y in zip(a, b, strict=True)]
        n = np.fromiter(map(len, made), np.int64, len(made)) // 4
        flat = np.frombuffer(b"".join(made), np.uint32)
        count = np.ones(len(size), np.int64)
        count[other] = n[which]
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        out[at[known]] = self.rank[guess[known]]
        out[_spread(at[other], count[other])] = flat[_spread((np.cumsum(n) - n)[which], n[which])]
        return out, count

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and how many each has."""
        n = self._length[ids]
        return self._flat[_spread(self._start[ids], n)], n

    def encode_text(self, text: str) -> np.ndarray:
        return self.ids(*self.pieces([text.encode()])[:2])[0]


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each run, in a row."""
    ends = np.cumsum(n)
    return np.repeat(starts - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def segments(text: bytes, most: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in parts of about ``most`` bytes, each but the first from a white space on that follows something else."""
    data = np.frombuffer(text, np.uint8)
    space = IS_SPACE[data]
    cuts = np.flatnonzero(space[1:] & (data[:-1] > 32) & (data[:-1] < 127)) + 1
    at = 0
    while len(text) - at > most:
        first, beyond = np.searchsorted(cuts, [at, at + most], "right")
        if first == len(cuts):
            break
        to = int(cuts[max(first, beyond - 1)])
        yield text[at:to]
        at = to
    yield text[at:]


def encode_documents(docs: DataFrame, tokenizer: Tokenizer, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    Special tokens are ordinary text. A null text is empty: no tokens, and the hash of no bytes. doc_id is passed
    through, nulls and repeats included; other columns aren't read; an empty table gives one. Rows are independent, so
    nothing is shuffled. The vocabulary travels with the job; its size is fixed by the file. A very long text is encoded
    part by part, so memory holds one part of it (its ids too if keep_ids). With a pattern of its own a text is one part.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.value
        for batch in batches:
            offsets, data = texts_of(batch.column(1))
            for a, b in chunks(offsets, PIECE_BYTES):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
                if len(texts) == 1 and len(texts[0]) > PIECE_BYTES and tok.classes is not None:
                    x, y, parts, total = hashlib.sha256(), hashlib.sha256(), [np.zeros(0, np.uint32)], 0
                    for part in segments(texts[0]):
                        ids, _ = tok.ids(*tok.pieces([part])[:2])
                        x.update(ids.astype("<u4").tobytes())
                        y.update(tok.decode(ids)[0].tobytes())
                        total += len(ids)
                        if keep_ids:
                            parts.append(ids)
                    n, ids_sha, decoded_sha, kept, ends = [total], [x.hexdigest()], [y.hexdigest()], np.concatenate(parts), [0, total]
                else:
                    body, at, per_text = tok.pieces(texts)
                    kept, per_piece = tok.ids(body, at)
                    decoded, per_id = tok.decode(kept)
                    ends = np.concatenate(([0], np.cumsum(per_piece)))[np.cumsum([0, *per_text.tolist()])]
                    byte_ends = np.concatenate(([0], np.cumsum(per_id)))[ends].tolist()
                    ends = ends.tolist()
                    raw, out = memoryview(kept.astype("<u4").tobytes()), memoryview(decoded.tobytes())
                    n = [y - x for x, y in pairwise(ends)]
                    ids_sha = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in pairwise(ends)]
                    decoded_sha = [hashlib.sha256(out[x:y]).hexdigest() for x, y in pairwise(byte_ends)]
                cols = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(kept.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def public_tokenizer(path: str | None = None, pattern: str | None = None) -> Tokenizer:
    """The byte-level vocabulary among the public files, or the one at ``path``."""
    import public_tokenizers

    return Tokenizer(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizer())
