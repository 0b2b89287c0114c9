"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, the first
permuted twice, the second once; a text's vector bundles (adds) those of its trigrams, and a language's prototype those
of all its training texts. A text gets the language whose prototype, less the mean of all prototypes' directions, has
the highest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, chunks, texts_of

DIMENSIONS = 1024
#: 0 is anything but a letter; 1-26 are a-z; all other letters share the rest.
SYMBOLS = 64
#: More labels than this are no list of languages; prototypes are collected only below it.
MOST_LANGUAGES = 5000
UNKNOWN = "und"

_symbol: np.ndarray | None = None


def symbols() -> np.ndarray:
    """The symbol of every code point."""
    global _symbol
    if _symbol is None:
        out = np.zeros(0x110000, np.uint8)
        letters = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()])
        mixed = (letters.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        out[letters] = 27 + (mixed % np.uint64(SYMBOLS - 27)).astype(np.uint8)
        out[97:123] = np.arange(1, 27)
        _symbol = out
    return _symbol


def letter_vectors(dimensions: int) -> np.ndarray:
    return np.random.RandomState(1009).randint(0, 2, (SYMBOLS, dimensions)).astype(np.int8) * 2 - 1


def trigram_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    letters = letter_vectors(dimensions)
    once, twice = np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
    return (twice[codes >> 12] * once[(codes >> 6) & 63] * letters[codes & 63]).astype(np.float32)


def text_trigrams(text: bytes) -> tuple[np.ndarray, bool]:
    """Codes of the trigrams over letters, where runs of anything else are one blank, and whether there is a letter at all."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbols()[points].astype(np.int32)
    if not s.any():
        return np.zeros(0, np.int32), False
    s = np.concatenate(([0], s, [0])).astype(np.int32)
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    return (s[:-2] << 12) | (s[1:-1] << 6) | s[2:], True


def bundles(offsets: np.ndarray, data: np.ndarray, dimensions: int, groups: np.ndarray | None = None, n_groups: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A bundled vector for each text (or for each group of texts), and which texts have letters."""
    n = len(offsets) - 1
    codes, owner, lettered = [], [], np.zeros(n, bool)
    for i in range(n):
        c, lettered[i] = text_trigrams(data[offsets[i] : offsets[i + 1]].tobytes())
        g = i if groups is None else groups[i]
        if len(c) and g >= 0:
            codes.append(c)
            owner.append(np.full(len(c), g, np.int64))
    rows = n if groups is None else n_groups
    if not codes:
        return np.zeros((rows, dimensions)), lettered
    key, count = np.unique((np.concatenate(owner) << 18) | np.concatenate(codes), return_counts=True)
    used, column = np.unique(key & (1 << 18) - 1, return_inverse=True)
    out = np.zeros((rows, dimensions))
    row = key >> 18
    for a in range(0, len(used), 4096):  # blocks of trigrams bound the dense counts
        part = (column >= a) & (column < a + 4096)
        dense = np.zeros((rows, min(4096, len(used) - a)), np.float32)
        dense[row[part], column[part] - a] = count[part]
        out += dense @ trigram_vectors(used[a : a + 4096], dimensions)
    return out, lettered


def prototypes(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their bundled vectors, of all rows for which ``training`` holds and that have a language.

    Each task adds up one vector for each language it sees, so what is shuffled and collected is languages x dimensions,
    whatever the number of rows. Sums are whole numbers: the order of rows and lost tasks change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            offsets, data = texts_of(batch.column(0))
            coded = batch.column(1).dictionary_encode()
            names, group = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                sums, _ = bundles(offsets[a : b + 1], data, dimensions, group[a:b], len(names))
                for name, v in zip(names, np.rint(sums).astype(np.int64), strict=True):
                    total[name] = total[name] + v if name in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.list_(pa.int64()))], names=["lang", "v"])

    bounded_batches(docs.sparkSession)
    parts = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, F.col(lang).cast("string").alias("lang")).mapInArrow(run, "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    found = sums.select("lang", "v.x").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels")
    found.sort(key=lambda r: r["lang"])
    return [r["lang"] for r in found], np.array([r["x"] for r in found], np.float64).reshape(len(found), dimensions)


def identify(docs: DataFrame, names: list[str], vectors: np.ndarray, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (the cosine with the language's prototype, at least 0).

    ``und`` with score 0 for a null text, one without letters, or where there are no prototypes. All other columns are
    passed through; those named lang_pred and score are replaced. Ties go to the language first by name. Only texts are
    looked at, and only they go to Python. Nothing is shuffled; prototypes travel with the job, and their number has been checked.
    """
    dimensions = vectors.shape[1] if len(names) else DIMENSIONS
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12) if len(names) else np.zeros((0, dimensions))
    shift = unit - unit.mean(0) if len(names) > 1 else unit
    pointed = shift / np.maximum(np.linalg.norm(shift, axis=1, keepdims=True), 1e-12)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        offsets, data = texts_of(texts)
        pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        for a, b in chunks(offsets) if len(names) else ():
            v, lettered = bundles(offsets[a : b + 1], data, dimensions)
            length = np.maximum(np.linalg.norm(v, axis=1), 1e-12)
            best = ((v @ pointed.T) / length[:, None] if len(names) > 1 else v @ unit.T).argmax(1)
            pred[a:b][lettered] = np.array(names, object)[best[lettered]]
            score[a:b] = np.where(lettered, ((v * unit[best]).sum(1) / length).clip(0, 1), 0.0)
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score)], names=["lang_pred", "score"])

    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    bounded_batches(docs.sparkSession)
    told = docs.select(*(F.col(f"`{c}`") for c in keep), predict(F.col(f"`{text}`")).alias("__predicted"))
    return told.select(*(F.col(f"`{c}`") for c in keep), "__predicted.lang_pred", "__predicted.score")


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id doesn't."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op6_hyperdimensional_lang(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    docs = table(spark, sf_dir, "documents")
    names, vectors = prototypes(docs, ~is_held_out())
    return identify(docs.select("doc_id", is_held_out().alias("held_out"), "text"), names, vectors).select("doc_id", "held_out", "lang_pred", "score")
