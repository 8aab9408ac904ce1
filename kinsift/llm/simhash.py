"""SimHash near-dedup by multi-index hashing (Norouzi et al., 2012).

A fingerprint's 64 bits are cut into segments; a table holds every fingerprint under the value of
each of its segments. Two fingerprints at distance d differ in at most floor(d / segments) bits of
some segment, so each fingerprint enumerates small Hamming balls within its segments, fetches what
the table holds under the probed values, and verifies the complete distance.

An entry of the table that very many fingerprints share (a large group of near copies) would fetch
the pairs of its group. What meets such an entry is compared through midpoints instead: two
fingerprints at distance two or less share one that is within one bit of both, at most 65 share any,
and each links to the smallest there, which keeps every component whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.llm.text import LOWER, map_texts
from kinsift.operators.components import connected_components
from kinsift.operators.skew import attach, join_small
from kinsift.storage import materialize

SHINGLE, SEED, DISTANCE, SEGMENTS = 3, 42, 2, 2

#: Fingerprints that an entry of the table may hold before it is compared through midpoints.
CROWD = 64


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(sums: np.ndarray, n: int) -> int:
    """The bits that over half of n hashes have, as a signed 64-bit integer."""
    return int(np.packbits(2 * sums > n, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED, step: int = 1 << 15) -> int:
    """SimHash of the word shingles, repeats included, as a signed 64-bit integer; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    total, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for start in range(0, n, step):  # very long texts: a bounded number of shingles at a time
        part = words[start : min(start + step, n) + shingle - 1]
        each = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        total += bit_sums(np.array([xxhash.xxh64_intdigest(s, seed) for s in each], "<u8"))
    return majority(total, n)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; null texts count as empty."""

    def rows(pairs: Iterator[tuple]) -> Iterator[tuple]:
        for i, x in pairs:
            yield i, fingerprint(x, shingle, seed)

    return map_texts(docs, doc_id, text, "doc_id bigint, fp bigint", rows)


def segment(fp: Column, number: int, segments: int) -> Column:
    """The bits of one segment, at their places; the last segment takes what is left of the 64."""
    low, high = 64 // segments * number, 64 if number == segments - 1 else 64 // segments * (number + 1)
    mask = (1 << high) - (1 << low)
    return fp.bitwiseAND(F.lit(mask - (mask >> 63 << 64)))


def ball(value: Column, number: int, segments: int, radius: int) -> Column:
    """The values within ``radius`` of a segment's value that a smaller or equal number of set bits tells from it.

    Of two values one bit apart, one has the bit set: it probes the other, which need not probe it.
    """
    low, high = 64 // segments * number, 64 if number == segments - 1 else 64 // segments * (number + 1)
    flips = F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda i: value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    return F.concat(F.array(value), F.filter(flips, lambda x: x != value)) if radius else F.array(value)


def radii(distance: int, segments: int) -> list[int]:
    """The radius of the ball to enumerate in each segment: floor(distance / segments) in the first few, one less (-1: none) in the others."""
    least, more = divmod(distance, segments)
    return [least if k <= more else least - 1 for k in range(segments)]


def links(distinct: DataFrame, fp: str = "fp", distance: int = DISTANCE, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(a, b) of distinct non-null fingerprints: pairs at ``distance`` or less, a < b, that join what is linked: every such
    pair of ordinary entries, and in crowded ones each to the smallest at a midpoint."""
    if distance > 2 or max(radii(distance, segments)) > 1:
        raise ValueError("balls and midpoints have a radius of one: links beyond distance 2 would be lost")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    reach = [(k, r) for k, r in enumerate(radii(distance, segments)) if r >= 0]
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.select(F.col(fp).alias("a")).repartition(parts, "a")
    value = [segment(F.col("a"), k, segments) for k in range(segments)]
    entry = lambda k, v: F.xxhash64(F.lit(k), v)  # noqa: E731  # entries that share a hash are told apart by the distance
    table = spread.select(F.col("a").alias("b"), F.explode(F.array(*[entry(k, value[k]) for k, _ in reach])).alias("at"))
    probed = [F.transform(ball(value[k], k, segments, r), partial(entry, k)) for k, r in reach]
    probes = spread.select("a", F.explode(F.concat(*probed)).alias("at"))
    crowds = materialize(table.groupBy("at").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("at"), "crowds")
    # a crowded entry's rows meet no table row: the table has none for it
    calm = join_small(table, crowds, "at", "left_anti")
    fetched = probes.join(calm, "at").filter((F.col("a") != F.col("b")) & near)
    found = fetched.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not crowds.isEmpty():
        crowded = join_small(probes, crowds, "at", "left_semi").select(F.col("a").alias("fp")).distinct()
        flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
        middles = crowded.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("middle")).groupBy("middle").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
        found = found.union(middles.filter(F.size("all") > 1).select("a", F.explode("all").alias("b")).filter((F.col("a") < F.col("b")) & near))
    return found.distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Fingerprints link at two or fewer differing bits; component_id is the smallest id reachable,
    the row's own included. Equal fingerprints are one node, so copies add no links. Texts without
    words have fingerprint zero and link like any other. Repeated rows stay repeated; an id that
    carries several texts counts once for each; null ids are never the smallest (a component of
    null ids only has a null id). An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, doc_id, text, shingle, seed), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    found = connected_components(links(nodes.select("fp")), "a", "b")
    linked = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    table = materialize(linked.join(ids, "component").select("fp", "n", "component_id"), "components")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = attach(fps, table, "fp", F.col("doc_id"), "n", ["component_id"], total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
