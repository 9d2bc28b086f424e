"""A training corpus from raw documents: language, near-duplicates, personal data, mixture, packing.

Each stage works on all rows the one before kept, written as Parquet and read again. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm import langid, mixing, nearcopies, packing, pii
from panelscope.llm.common import stored
from panelscope.llm.queries import documents, tokenizer_path

#: Pieces of words a worker remembers, twice: a tenth of what packing takes by itself, as executors hold on to the heap of the stages before.
REMEMBERED = 50_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in."""
    return langid.accepted(docs, langid.learn(docs, F.lit(True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of five-word shingles of at least 0.8): the one with the smallest id."""
    return nearcopies.first_of_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and ``n_chars`` of the new text."""
    masked = pii.mask_documents(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix_documents(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids."""
    return packing.pack_documents(docs, tokenizer_path(), added_tokens=True, remembered=REMEMBERED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", windows),
]

#: The stages learn, draw and tokenise, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
