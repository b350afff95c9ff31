"""The corpus pipeline: documents through language ID, near-dedup, secret masking, mixing and BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import bpe, langid, minhash, mixing, secrets
from logweave.llm.common import discard, table, written

#: Documents whose language scores less are rejected, like those without any letter.
LEAST_LANGUAGE_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language; keeps all others as they are.

    Null and empty texts and those without a letter have none; rows that are there twice are judged alike, an empty
    table stays empty."""
    return langid.keep_identified(docs, langid.fit(docs), LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the least id; rows that share an id
    without being near copies stay, and so do rows without an id."""
    return minhash.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; keeps every document, null and empty texts as they are."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source comes near its target; a null source is a source, and equal
    rows are one unit with a count. Texts without a word weigh nothing and may be left out or stay."""
    return mixing.repeat_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and digests of them and of what they decode to; a null text is an empty one."""
    return bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", mask_secrets), ("mixing", mix), ("bpe", encode)]

#: SQL can express neither the language model nor the merges; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and reread by the next."""
    docs, used = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*used)
        used = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
