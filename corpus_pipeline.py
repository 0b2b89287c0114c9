"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() applies them to documents.
A stage reads nothing of docs but the columns it names, and all but the last give back docs' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import encode_documents, public_tokenizer
from tessera.llm.common import durable, table
from tessera.llm.language_id import UNKNOWN, identify, is_held_out, prototypes
from tessera.llm.minhash import near_duplicate_classes
from tessera.llm.secret_scan import redact_secrets
from tessera.llm.string_tiling import find_leaks

#: Near copies share at least so many percent of their shingles of five words.
NEAR_PERCENT = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; null texts and texts without letters go. Where no row has a language to learn from, all texts with letters stay."""
    names, vectors = prototypes(docs, ~is_held_out())
    if not names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return identify(docs, names, vectors).where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate class.

    Rows that repeat a doc_id and its text are one document, of which the first row by all columns stays. Where a doc_id has
    different texts, each of them is a document, in the order of doc_id and the text's hash. Rows without a doc_id can't be
    told apart and stay.
    """
    named = docs.where("doc_id IS NOT NULL")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = near_duplicate_classes(named, NEAR_PERCENT).where("kept").select("doc_id")
        return named.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)
    text = F.xxhash64("text")
    told = durable(named.groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low <> high").select("doc_id"))
    key = F.col("doc_id") if told.isEmpty() else F.struct("doc_id", text.alias("text"))
    keyed = named.select(key.alias("__key"), *docs.columns)
    kept = near_duplicate_classes(keyed.select(F.col("__key").alias("doc_id"), "text"), NEAR_PERCENT).where("kept").select(F.col("doc_id").alias("__key")).distinct()
    first = keyed.join(kept, "__key", "left_semi").groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return first.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts; n_chars follows the text."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and checksums."""
    return encode_documents(docs, public_tokenizer(), keep_ids=True)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_leaks),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: Language profiles and BPE are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
