"""A corpus pipeline of five stages over documents: language ID, near-dedup, decontamination, secrets, tokenising."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import bpe, decontamination, language, minhash, secrets
from seqloom.llm.queries import table, vocabulary
from seqloom.llm.shared import shared_dir


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID places, with the language it finds in ``lang``; those without a letter, and those of which no language holds 30 % of the letters, go."""
    return language.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least doc_id."""
    return minhash.keep_first(docs, threshold_percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; all documents stay."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with the digest of their decoded text; the language that the first stage found and the source come along."""
    return bpe.tokenized(docs, vocabulary(), ("lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("secrets", mask_secrets),
    ("tokenize", tokenize),
]

#: Language ID and tokenising are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}_{name}")
    return docs
