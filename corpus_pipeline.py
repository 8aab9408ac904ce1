"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.llm import bpe, exact, language, mixing, near
from kinsift.storage import materialize


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language; the model is fitted on the labelled documents that are not held out."""
    return language.keep(docs, language.fit(docs.filter(~language.held_out())))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, the one with the largest id."""
    return exact.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near (five-word Jaccard of 0.8 or more) and linked, the one with the smallest id stays."""
    return near.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two times."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): token ids as little-endian unsigned 32-bit integers, a row for each copy."""
    return bpe.encode(docs).select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("language", by_language),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mix", mixed),
    ("tokens", tokens),
]

#: Language ID and near dedup are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
