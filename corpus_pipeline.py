"""Training-data pipeline over documents: language, exact and near copies, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of docs; the mixture repeats rows that it takes more than once, so that a
doc_id and piece may come several times out of the last stage.

Cases: a null text is an empty one: language ID rejects it; a row with a null doc_id
is never dropped; rows that share a doc_id share its verdict, and repeated rows stay
or go together; other columns pass through all stages but the last; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import exact_dedup, language_id, mixing, near_dedup, packing
from framelake.llm.common import documents, shared_folder, without


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without enough text or without a clear language."""
    model = language_id.TextModel.learn(docs, "lang", "doc_id", "text")
    found = language_id.identify(language_id.document_rows(docs), model)
    return without(docs, found.where(~F.col("accepted")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return without(docs, exact_dedup.exact_dedup(docs).where(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the smallest doc_id stays."""
    return without(docs, near_dedup.near_dedup(docs).where(~F.col("kept")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages' models, signatures and tokens are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
