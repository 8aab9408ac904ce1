"""Incremental re-scan: catalogue rows arrive as a stream, only new and changed files are signed.

Each micro-batch looks up its files in the signature table, computes signatures for the misses alone, and
adds a generation with these and with hits not seen for long; a batch that is run again after a
failure writes the same generation, so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinsift.sources.signature_table import SignatureTable


def rescan(files: DataFrame, table: SignatureTable, sign: Callable[[DataFrame], DataFrame], checkpoint: str, seen: Column | None = None) -> StreamingQuery:
    """Starts a query over a stream of (path, size, mtime_ns, ...) that keeps the table up to date.

    sign turns missed files into rows of the table, but for ``seen``, which is the given time or the current.
    Batch n reads the generations up to n and writes generation n + 1. If a path comes twice in a batch, its
    latest version counts.
    """

    def batch(rows: DataFrame, number: int) -> None:
        latest = rows.groupBy("path").agg({"mtime_ns": "max"}).withColumnRenamed("max(mtime_ns)", "mtime_ns")
        rows = rows.join(latest, ["path", "mtime_ns"]).dropDuplicates(["path"])
        own = replace(table, spark=rows.sparkSession)
        found = own.lookup(rows, number + 1)
        missed = found.filter("not hit").select(*rows.columns)
        own.upsert(found, sign(missed), number + 1, F.current_timestamp() if seen is None else seen)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
