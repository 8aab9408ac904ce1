"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group is hot when it holds at least 1/HOT_SHARE of all rows, so there are at most HOT_SHARE hot groups.
HOT_SHARE = 2000

#: Rows up to which a small table whose size was counted is broadcast.
BROADCAST_ROWS = 50_000


def attach(rows: DataFrame, groups: DataFrame, key: str, row_id: Column, size: str, values: list[str], total: int) -> DataFrame:
    """Left join of rows to groups on one key, with the hot groups broadcast.

    groups has one row a key. At most HOT_SHARE groups can have ``size >= total / HOT_SHARE``; they
    are broadcast, which this bound keeps small at any scale. Rows of hot groups then go through the
    shuffled join under a key of their own (a hash of row_id), which finds nothing that is used, so
    no task gets a whole hot group and rows is read once.
    """
    least = max(2, -(-total // HOT_SHARE))
    hot = groups.filter(F.col(size) >= least).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = groups.filter(F.col(size) < least).select(F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold"))
    kind = dict(rows.dtypes)[key]
    spread = F.xxhash64(row_id)
    spread = spread if kind == "bigint" else F.concat(F.lit("row "), spread.cast("string")).cast(kind)
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    out = out.withColumn("_route", F.when(F.col("_hot_key").isNotNull(), spread).otherwise(F.col(key)))
    out = out.join(cold, F.col("_route") == F.col("_cold_key"), "left")
    got = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *[got[v].alias(v) for v in values])


def growing(side: DataFrame) -> DataFrame:
    """A join side with a row per file or group. It is never broadcast: the size of its compressed files, by which Spark would
    choose to, is a fraction of what the driver would hold."""
    return side.hint("merge")


def join_small(rows: DataFrame, small: DataFrame, on: str, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Null-safe join to a table that is usually small: broadcast up to ``limit`` counted rows, else
    shuffled, where adaptive execution splits hot keys."""
    right = small.withColumnRenamed(on, "_on")
    if small.limit(limit + 1).count() <= limit:
        right = F.broadcast(right)
    return rows.join(right, rows[on].eqNullSafe(F.col("_on")), how).drop("_on")
