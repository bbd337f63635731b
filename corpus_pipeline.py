"""The corpus pipeline: each stage works on what the stage before it kept, written as Parquet and read again.

Language and quality are worked out beside each row, so these stages shuffle no texts; near duplicates leave one
document of each class; personal data is replaced in place; packing returns the batches.

Defined cases: rows that share an id are one document and come out of the third stage once, with the text of the
smallest hash; rows without an id are judged by their text and never near duplicates; further columns of documents,
whatever their names, are carried along; a null text
has no language and goes at the first stage; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import lang_id, near_dup, packing, pii, quality_cnn
from sourcelens.llm.common import free_name, quoted, table, written

LEAST_POSTERIOR = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no language with half of the posterior."""
    name = free_name(docs, "found")
    found = lang_id.with_language(docs, public_tokenizers.path("piece_bpe_32k.model"), name)
    good = (F.col(f"{name}.lang_pred") != lang_id.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_POSTERIOR)
    return found.where(good).select(*map(quoted, docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier doesn't accept."""
    name = free_name(docs, "found")
    found = quality_cnn.with_quality(docs, table(spark, sf_dir, "labels"), name)
    return found.where(F.col(f"{name}.predicted") == 1).select(*map(quoted, docs.columns))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of near duplicates."""
    return near_dup.keep_one(docs, near_dup.near_duplicates(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets in the text."""
    name = free_name(docs, "found")
    found = pii.with_surrogates(docs, name=name)
    text = F.col(f"{name}.text")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[new.get(c, quoted(c)).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents of like length."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("near duplicates", near_dup_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: Learned models, alignment and a dynamic program have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
