"""Shuffling documents into shards through a hypergeometric communication matrix (Sanders, 1998).

How many rows each partition sends to each shard is drawn first, exactly as a uniform shuffle with
the given shard sizes would have it. Then every partition permutes its rows and deals them by its
row of the matrix, the rows are exchanged, and every shard permutes what it got. Partitions are
hash classes of the id rather than physical ones, so a retried task sees the same rows, and a shard
permutes in pieces, so no task holds a whole shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinsift.llm.text import renamed, restored
from kinsift.storage import materialize

SHARDS, SEED, ROWS = 40, 11, 4096

#: The matrix that the driver draws and broadcasts has at most this many rows. Beyond, each row stands for several hash
#: classes, and tasks draw how it is dealt to them, so that a class has about ROWS rows at any size.
MOST_PARTITIONS = 4096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn without replacement; also beyond the 1e9 that numpy's own sampler allows.

    Large cases use rejection from a table mountain (Stadlober's ratio of uniforms), exact up to rounding.
    """
    if max(good, bad) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mean = n * (good / total)
    scale = math.sqrt(mean * (bad / total) * ((total - n) / max(1, total - 1)) + 0.5) * 1.7155277699214135 + 0.8989161620588988
    lg = lambda k: sum(map(math.lgamma, (k + 1, good - k + 1, n - k + 1, bad - n + k + 1)))
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    top = lg(mode)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + scale * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= top - lg(k):
            return k


def matrix(rows: list[int], columns: list[int], seed: int | list[int]) -> list[list[int]]:
    """A random matrix with these row and column sums, as a uniform permutation would give it."""
    rng, left, out = np.random.default_rng(seed), list(columns), []
    for n in rows:
        line, rest = [], sum(left)
        for j, m in enumerate(left):
            rest -= m
            k = hypergeometric(rng, m, rest, n) if n else 0
            line.append(k)
            n -= k
            left[j] -= k
        out.append(line)
    return out


def dealt_below(classes: pd.DataFrame, seed: int) -> pd.DataFrame:
    """The rows of the matrix for the hash classes of one row above, whose columns they share: a draw of the same law."""
    classes = classes.sort_values("_part")
    drawn = matrix(classes["count"].tolist(), list(classes["_line"].iloc[0]), [seed, int(classes["_above"].iloc[0])])
    return pd.DataFrame({"_row": classes["_part"], "_ends": [np.cumsum(line).tolist() for line in drawn]})


def shuffle(docs: DataFrame, doc_id: str = "doc_id", shards: int = SHARDS, seed: int = SEED, rows: int = ROWS) -> DataFrame:
    """docs with shard (int) and slot (long): a uniform shuffle, shard sizes at most one apart.

    slot counts each shard from 0 without gaps. Depends on the rows, their number, shards and seed. Rows
    that repeat an id, or have none, are spread by their content; rows that are equal throughout fall into
    one hash class and take its places in any order, which gives the same rows. Columns of docs named shard
    or slot are replaced, all others pass through. An empty table gives no rows.
    """
    docs, names = renamed(docs.drop("shard", "slot"))
    key = F.col(names[doc_id])
    total = docs.count()
    most = MOST_PARTITIONS
    classes = max(1, math.ceil(total / rows))
    above = min(most, classes)
    parts = above * math.ceil(classes / above)
    # rows of one id (or of none) are told apart by their content, so that no id is a class of its own
    content = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes])  # maps have no hash
    placed = docs.withColumn("_at", F.xxhash64(F.lit(seed), key, content))
    placed = placed.withColumn("_part", F.pmod("_at", F.lit(parts)))
    counts = dict(placed.groupBy((F.col("_part") % above).cast("int").alias("_above")).count().collect())  # at most MOST_PARTITIONS rows
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    drawn = matrix([counts.get(p, 0) for p in range(above)], sizes, seed)
    if parts == above:
        lines = [(p, np.cumsum(line).tolist()) for p, line in enumerate(drawn)]
        table = F.broadcast(docs.sparkSession.createDataFrame(lines, "_row bigint, _ends array<bigint>"))
    else:
        lines = docs.sparkSession.createDataFrame(list(enumerate(drawn)), "_above bigint, _line array<bigint>")
        held = placed.groupBy("_part").count().withColumn("_above", F.col("_part") % above).join(F.broadcast(lines), "_above")
        table = materialize(held.groupBy("_above").applyInPandas(lambda classes: dealt_below(classes, seed), "_row bigint, _ends array<bigint>"), "matrix")
    # permute locally and deal by the partition's row of the matrix
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed + 1), "_at"), "_at")
    dealt = placed.withColumn("_turn", F.row_number().over(local)).join(table, F.col("_part") == F.col("_row"))
    dealt = dealt.withColumn("_shard", F.size(F.filter("_ends", lambda e: e < F.col("_turn"))).cast("int"))
    # exchange, and permute again: a random piece, then a random order within the piece
    pieces = max(1, math.ceil(total / shards / rows))
    dealt = dealt.withColumn("_piece", F.pmod(F.xxhash64(F.lit(seed + 2), "_at", "_turn"), F.lit(pieces)).cast("int"))
    dealt = materialize(dealt.drop("_part", "_row", "_ends"), "dealt")
    held = dealt.groupBy("_shard", "_piece").agg(F.count("*").alias("_n"))
    before = held.select(F.col("_shard").alias("_s"), F.col("_piece").alias("_p"), (F.sum("_n").over(Window.partitionBy("_shard").orderBy("_piece")) - F.col("_n")).alias("_before"))
    again = Window.partitionBy("_shard", "_piece").orderBy(F.xxhash64(F.lit(seed + 3), "_at"), "_at", "_turn")
    out = dealt.withColumn("_place", F.row_number().over(again)).join(before, (F.col("_shard") == F.col("_s")) & (F.col("_piece") == F.col("_p")))
    return out.select(*restored(names), F.col("_shard").alias("shard"), (F.col("_before") + F.col("_place") - 1).alias("slot"))


def op4_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are dealt; size and text_crc32 are those of the text that arrived in the slot."""
    dealt = shuffle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = ((F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return dealt.select("doc_id", *digests, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
