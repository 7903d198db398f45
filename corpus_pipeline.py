"""Corpus pipeline: five stages from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and reread as the next one's docs; all but the last keep
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import exact_dedup, langid, ngram_join, packing, pii
from riskweave.llm.frames import fresh_name, keep_rows, table, written
from riskweave.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, and those that no
    language's model codes better than random bytes, go."""
    return langid.keep_identified(docs, langid.fit_on(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    key = fresh_name(docs, "digest")
    found = exact_dedup.exact_dedup(docs)
    # A repeated row counts as often as it occurs; its group keeps one.
    kept = found.where(found["doc_id"].eqNullSafe(found["keep_id"])).select("doc_id", found["digest"].alias("key"))
    return keep_rows(exact_dedup.with_digest(docs, key), key, kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked texts the one with the smallest doc_id."""
    key = fresh_name(docs, "set_id")
    found = ngram_join.similar_classes(docs)
    kept = found.where("first and set_id is not null").select("doc_id", found["set_id"].alias("key"))
    return keep_rows(ngram_join.with_set_id(docs, key), key, kept)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked by tags; n_chars follows the text."""
    return pii.mask(docs, pii.train_on(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("packing", packed),
]

# Models and the token packing are not SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
