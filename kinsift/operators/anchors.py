"""Anchored clusters of close values: the smallest value and all up to its limit, then the next beyond, and so on.

The scan is a chain, but it composes. Distinct values are dealt to ranges. In a range, the last anchor
depends only on the anchor that comes in from the ranges before, which leaves its first anchor among the
values of one window. These fall into runs whose chains end alike. The runs of FAN neighbouring ranges
compose to those of a block, blocks to those of larger blocks, in a tree of shuffled steps; then the anchors
that come in go down the tree, and every range labels its values. A task sees the values of one range, or
the runs of FAN blocks, which are those of a block's first window.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.storage import materialize


#: Neighbours that one task composes; the tree's depth is the logarithm of the ranges to this base.
FAN = 16

Anchor = tuple[float, float] | None
RUNS = "runs array<struct<k: double, v: double, last_k: double, last_v: double>>"
BLOCK = f"id bigint, {RUNS}, min_k double, min_v double, max_k double, max_v double"


def limit_of(window: float | None, ratio: float | None) -> Callable:
    """The largest value that an anchor takes."""
    if (window is None) == (ratio is None):
        raise ValueError("give a window or a ratio")
    return (lambda a: a + window) if ratio is None else (lambda a: a * (1 + ratio))


def successors(keys: np.ndarray, values: np.ndarray, limit: Callable) -> np.ndarray:
    """For each value as an anchor, the place of the next one; the number of values if there is none. Sorted by key and value."""
    out = np.empty(len(values), np.int64)
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = a + np.searchsorted(values[a:b], limit(values[a:b]), side="right")
    return out


def last_anchors(following: np.ndarray) -> np.ndarray:
    """The last anchor of the chain that begins at each place, by doubling jumps."""
    n, jumps = len(following), [np.append(following, len(following))]
    while (jumps[-1] < n).any():
        jumps.append(jumps[-1][jumps[-1]])
    at = np.arange(n)
    for jump in reversed(jumps):
        at = np.where(jump[at] < n, jump[at], at)
    return at


def labels(keys: np.ndarray, values: np.ndarray, came: tuple[float, float] | None, limit: Callable) -> np.ndarray:
    """The anchor of each value of a range, given the anchor that comes in."""
    n, at, out = len(values), 0, np.empty(len(values))
    if came is not None:
        first = np.searchsorted(keys, came[0], side="left")
        last = np.searchsorted(keys, came[0], side="right")
        at = int(first + np.searchsorted(values[first:last], limit(came[1]), side="right"))
        out[:at] = came[1]
    following = successors(keys, values, limit)
    while at < n:
        out[at : following[at]] = values[at]
        at = int(following[at])
    return out


def leaving(tops: list[tuple], lasts: list[tuple], came: Anchor, limit: Callable) -> Anchor:
    """The anchor that leaves a block which ``came`` comes into: the last of the first run that reaches beyond it."""
    at = 0 if came is None else bisect_right(tops, (came[0], limit(came[1])))
    return lasts[at] if at < len(tops) else came


def unpacked(runs: list[dict]) -> tuple[list[tuple], list[tuple]]:
    return [(r["k"], r["v"]) for r in runs], [(r["last_k"], r["last_v"]) for r in runs]


def composed(blocks: pd.DataFrame, limit: Callable, fan: int) -> pd.DataFrame:
    """One block of neighbouring ones: where each run of the first ends after the last. The runs of a later one count
    only while all before lies in one window, so that an anchor may reach beyond it."""
    tops, lasts, low, high = [], [], None, None
    blocks = blocks.sort_values("id")
    for runs, *ends in zip(blocks["runs"], blocks["min_k"], blocks["min_v"], blocks["max_k"], blocks["max_v"], strict=True):
        own_tops, own_lasts = unpacked(runs)
        lasts = [leaving(own_tops, own_lasts, last, limit) for last in lasts]
        if high is None or high <= (low[0], limit(low[1])):
            tops, lasts = tops + own_tops, lasts + own_lasts
        low, high = low or tuple(ends[:2]), tuple(ends[2:])
    runs = [dict(zip(("k", "v", "last_k", "last_v"), (*t, *x), strict=True)) for t, x in zip(tops, lasts, strict=True)]
    return pd.DataFrame({"id": [blocks["id"].iloc[0] // fan], "runs": [runs], "min_k": [low[0]], "min_v": [low[1]], "max_k": [high[0]], "max_v": [high[1]]})


def spread(blocks: pd.DataFrame, limit: Callable) -> pd.DataFrame:
    """What comes into each of neighbouring blocks, given what comes into the first."""
    blocks = blocks.sort_values("id")
    came = blocks["came_k"].iloc[0], blocks["came_v"].iloc[0]
    came, out = None if pd.isna(came[0]) else came, []
    for number, runs in zip(blocks["id"], blocks["runs"], strict=True):
        out.append((number, *(came or (None, None))))
        came = leaving(*unpacked(runs), came, limit)
    return pd.DataFrame(out, columns=["id", "came_k", "came_v"])


def run_tops(following: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each place is the last of a run of equal chain ends, among the places up to the second anchor of the chain
    from the first: an anchor from before the range can have no other as the next."""
    first = min(int(following[0]), len(last) - 1)
    tops = np.append(last[1:] != last[:-1], True)
    tops[first] = True
    tops[first + 1 :] = False
    return tops


def blocks_of(table: DataFrame) -> DataFrame:
    """Each range's runs, by their largest value, from its values with the last anchor of the chain from each."""
    run = F.when(F.col("top"), F.struct("k", "v", "last_k", "last_v"))
    at = F.struct("k", "v")
    blocks = table.groupBy(F.col("part").cast("bigint").alias("id")).agg(F.array_sort(F.collect_list(run)).alias("runs"), F.min(at).alias("low"), F.max(at).alias("high"))
    return blocks.select("id", "runs", F.col("low.k").alias("min_k"), F.col("low.v").alias("min_v"), F.col("high.k").alias("max_k"), F.col("high.v").alias("max_v"))


def incoming(blocks: DataFrame, limit: Callable, fan: int) -> DataFrame:
    """(id, came_k, came_v): the anchor that comes into each range, null for the first."""
    levels = [materialize(blocks, "blocks")]
    top = levels[0].agg(F.max("id")).first()[0] or 0
    while top >= fan:
        above = levels[-1].groupBy(F.expr(f"id div {fan}")).applyInPandas(lambda b: composed(b, limit, fan), BLOCK)
        levels.append(materialize(above, "blocks"))
        top //= fan
    none = F.lit(None).cast("double")
    came = levels[-1].select(F.lit(0).cast("bigint").alias("up"), none.alias("came_k"), none.alias("came_v")).limit(1)
    for level in reversed(levels):
        below = level.join(came, F.expr(f"id div {fan}") == F.col("up"))
        came = below.groupBy("up").applyInPandas(lambda b: spread(b, limit), "id bigint, came_k double, came_v double").withColumnRenamed("id", "up")
    return came.withColumnRenamed("up", "id")


def anchor_clusters(rows: DataFrame, value: str, name: str, window: float | None = None, ratio: float | None = None, key: str | None = None) -> DataFrame:
    """rows with column ``name``: the anchor of the cluster of each row's value, within ``key`` if given.

    Limits are inclusive; equal values are never apart; null values and null keys have no anchor.
    """
    limit = limit_of(window, ratio)
    k, v = F.col(key).cast("double") if key else F.lit(0.0), F.col(value).cast("double")
    values = rows.select(k.alias("k"), v.alias("v")).filter("k is not null and v is not null").distinct()

    def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            whole = pd.concat(parts, ignore_index=True)
            keys, own = whole["k"].to_numpy(), whole["v"].to_numpy()
            following = successors(keys, own, limit)
            last = last_anchors(following)
            yield whole.assign(part=TaskContext.get().partitionId(), last_k=keys[last], last_v=own[last], top=run_tops(following, last))

    ranges = values.repartitionByRange("k", "v").sortWithinPartitions("k", "v")
    table = materialize(ranges.mapInPandas(chains, "k double, v double, part int, last_k double, last_v double, top boolean"), "chains")
    came = incoming(blocks_of(table), limit, FAN).withColumnRenamed("id", "part")

    def label(whole: pd.DataFrame) -> pd.DataFrame:
        whole = whole.sort_values(["k", "v"])
        first = whole["came_k"].iloc[0], whole["came_v"].iloc[0]
        return pd.DataFrame({"_k": whole["k"], "_v": whole["v"], name: labels(whole["k"].to_numpy(), whole["v"].to_numpy(), None if pd.isna(first[0]) else first, limit)})

    found = table.select("part", "k", "v").join(came, "part").groupBy("part").applyInPandas(label, f"_k double, _v double, `{name}` double")
    return rows.join(materialize(found, "labels"), (k == F.col("_k")) & (v == F.col("_v")), "left").drop("_k", "_v")
