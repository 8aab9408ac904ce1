"""Exact dedup by skew-safe combining, in DataFrame operations only.

Copies are combined three times, each time grouped by digest *and* full text, so that a digest
collision never merges different texts: within a task before any shuffle (Spark's partial
aggregation), over salted digest groups, and over the salts' winners. A text with any number of
copies sends one row per task into the first shuffle and one row per salt into the second.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.llm.text import renamed, restored
from kinsift.operators.skew import attach
from kinsift.storage import materialize

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def winners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(_digest, _text, keep_id, group_size), one row per distinct text."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_digest", digest(F.col("_text"))).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_id"), F.count("*").alias("_n"))
    return salted.groupBy("_digest", "_text").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row with its group: all columns of docs, then keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The largest id of a group stays. Null ids
    lose to any other; a group of null ids keeps its null rows. Rows that repeat both id and text
    cannot be told apart: all carry kept = true here, and deduplicate() returns one of them. Further
    columns pass through; columns named like the results are replaced. An empty table gives no rows.
    """
    given, results = [doc_id, text], ("keep_id", "group_size", "kept", "text_sha256")
    docs, names = renamed(docs.drop(*(c for c in results if c not in given)))
    doc_id, text = names[doc_id], names[text]
    whole = F.coalesce(F.col(text), F.lit(""))
    found = materialize(winners(docs, doc_id, text, salts, digest).drop("_text"), "texts")
    total, texts, digests = found.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.count("*"), F.count_distinct("_digest")).first()
    rows = docs.withColumn("_digest", digest(whole)).withColumn("text_sha256", sha256(whole))  # before the join, which then needs no text
    if texts == digests:
        out = attach(rows, found, "_digest", F.col(doc_id), "group_size", ["keep_id", "group_size"], total)
    else:  # different texts share a digest: their rows find their group by content
        shared = found.groupBy("_digest").count().filter("count > 1").select("_digest")
        out = attach(rows.join(shared, "_digest", "left_anti").select(rows.columns), found.join(shared, "_digest", "left_anti"), "_digest", F.col(doc_id), "group_size", ["keep_id", "group_size"], total)
        clash = rows.join(shared, "_digest", "left_semi").select(rows.columns)
        out = out.unionByName(clash.join(winners(clash.drop("_digest"), doc_id, text, salts, digest).drop("_digest"), whole == F.col("_text")).select(out.columns))
    return out.select(*restored(names), "keep_id", "group_size", F.col(doc_id).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each distinct text: the one with the largest id.

    All columns pass through, whatever their names. Only rows whose id occurs more than once are
    compared again, by id and content. An empty table gives no rows.
    """
    docs, names = renamed(docs)
    doc_id, text = names[doc_id], names[text]
    kept = report(docs, doc_id, text).filter("kept").select(*docs.columns)
    again = docs.groupBy(F.col(doc_id).alias("_again")).count().filter("count > 1").select("_again")
    if not again.isEmpty():
        same = F.col(doc_id).eqNullSafe(F.col("_again"))
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([doc_id, text]))
    return kept.select(restored(names))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return report(docs).drop("text")


OP10_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window g as (partition by coalesce(text, ''))
"""
