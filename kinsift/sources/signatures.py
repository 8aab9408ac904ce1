"""The signature table: what earlier scans learned about each file, valid while path, size and mtime agree.

Snapshots are Parquet directories; an update writes a new one. A changed file's row is replaced
whole, so no signature of older content survives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = ["path", "size", "mtime_ns"]


def lookup(files: DataFrame, signatures: DataFrame) -> DataFrame:
    """files with the columns of their signature and ``hit``; a row of another version is no hit."""
    found = signatures.withColumn("hit", F.lit(True))
    return files.join(found, VERSION, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def states(files: DataFrame, signatures: DataFrame) -> DataFrame:
    """files with ``state``: hit, changed (known under another size or mtime) or new."""
    known = signatures.select("path", F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"))
    rows = files.join(known, "path", "left")
    same = (F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime"))
    return rows.withColumn("state", F.when(F.col("_size").isNull(), "new").when(same, "hit").otherwise("changed")).drop("_size", "_mtime")


def upsert(signatures: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next snapshot: fresh rows, and the old rows of all other paths."""
    return signatures.join(fresh.select("path"), "path", "left_anti").select(signatures.columns).unionByName(fresh.select(signatures.columns))


def touch(signatures: DataFrame, files: DataFrame, seen) -> DataFrame:
    """signatures with ``seen`` set for every path that a scan met."""
    met = files.select("path").distinct().withColumn("_met", F.lit(True))
    return signatures.join(met, "path", "left").withColumn("seen", F.when(F.col("_met"), seen).otherwise(F.col("seen"))).select(signatures.columns)


def prune(signatures: DataFrame, now, days: int = 90) -> DataFrame:
    """signatures seen within the last ``days``; now and seen are timestamps."""
    return signatures.filter(F.col("seen") >= now - F.make_interval(days=F.lit(days)))


def vanished(signatures: DataFrame, files: DataFrame) -> DataFrame:
    """Signatures of paths that a scan no longer met."""
    return signatures.join(files.select("path").distinct(), "path", "left_anti")


def clear(signatures: DataFrame) -> DataFrame:
    return signatures.limit(0)


def info(signatures: DataFrame, looked_up: DataFrame | None = None) -> DataFrame:
    """One row: rows of the table and, after a lookup, hits and misses."""
    rows = signatures.agg(F.count("*").alias("rows"))
    if looked_up is None:
        return rows
    return looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).withColumn("rows", F.lit(rows.first()[0]))


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of a snapshot's files, from their listing alone."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def save(signatures: DataFrame, folder: str, version: int) -> str:
    """Writes a snapshot beside the earlier ones; readers keep theirs until they open the new one."""
    path = f"{folder.rstrip('/')}/v{version:06d}"
    signatures.write.mode("errorifexists").parquet(path)
    return path
