"""Clusters of one title's files by artists and duration: the first file takes every later one that fits, then the next free one.

So a file is an anchor when no anchor before it fits, and else it goes to the first that does. A title is decided in order, by
what its anchors are; they are found by artist and duration, not by comparing all pairs. Titles of more than UNIT files are split by
artists that no set links. What is still larger goes in rounds: the first UNIT files are decided, the others, in pieces and
over all cores, go to those anchors where they fit, and the next round begins with what is left.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from math import floor, isfinite

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsift.operators.components import connected_components
from kinsift.operators.skew import growing
from kinsift.plans.config import FEAT_SECONDS
from kinsift.storage import materialize

#: Files that one task decides in order.
UNIT = 50_000

#: Seconds of a cell of durations: files of one set of artists in one cell always fit, so that a set has one anchor a cell.
CELL = 2

Anchor = tuple[int, frozenset, float, int]


def fit(a: frozenset, x: float, b: frozenset, y: float) -> bool:
    """Whether one set of artists holds the other and the durations agree; one of 0 is unknown."""
    return (a <= b or b <= a) and (not x or not y or abs(x - y) <= FEAT_SECONDS)


class Anchors:
    """Anchors (number, artists, seconds, file_id) in order, by artist and cell.

    ``by_all`` has an anchor below each of its artists, for sets that it holds; ``by_one`` below one of them, for sets that hold it: the
    one with the fewest, so that an artist of many sets is no long list.
    """

    def __init__(self):
        self.size = 0
        self.by_all, self.by_one = (defaultdict(lambda: defaultdict(list)) for _ in range(2))

    @staticmethod
    def cell(seconds: float) -> int | str:
        return "unknown" if not seconds else floor(seconds / CELL) if isfinite(seconds) else "odd"

    def add(self, artists: frozenset, seconds: float, file_id: int) -> None:
        anchor = self.size, artists, seconds, file_id
        self.size += 1
        one = min(artists, key=lambda a: len(self.by_one[a]["all"]))
        for cells in (*(self.by_all[a] for a in artists), self.by_one[one]):
            cells["all"].append(anchor)
            cells[self.cell(seconds)].append(anchor)

    def first(self, artists: frozenset, seconds: float) -> int | None:
        """The file_id of the first anchor that fits."""
        at = self.cell(seconds)
        names = ("all",) if at == "unknown" else ("unknown",) if at == "odd" else ("unknown", *range(at - 2, at + 3))
        holders = [self.by_all[a] for a in artists if a in self.by_all]
        found = [min(holders, key=lambda cells: len(cells["all"]))] if len(holders) == len(artists) else []
        found += [self.by_one[a] for a in artists if a in self.by_one]
        best: Anchor | None = None
        for cells in found:
            for name in names:
                for anchor in cells.get(name, ()):
                    if best and anchor[0] > best[0]:
                        break
                    if fit(anchor[1], anchor[2], artists, seconds):
                        best = anchor
                        break
        return best and best[3]


def _anchored(group: list[str], known: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``anchor`` to rows that come group by group and in order. Where ``known`` names a column, anchors are the rows that have it, which
    come first, and a file that none of them fits has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors = None, Anchors()
        for batch in batches:
            out, given = [], batch[known].to_pylist() if known else [False] * len(batch)
            for key, is_anchor, i, artists, seconds in zip(zip(*(batch[g].to_pylist() for g in group), strict=True), given, *(batch[n].to_pylist() for n in ("file_id", "artist_set", "duration")), strict=True):
                if key != now:
                    now, anchors = key, Anchors()
                artists, seconds = frozenset(artists), seconds or 0.0
                found = i if is_anchor else anchors.first(artists, seconds)
                if is_anchor or (found is None and not known):
                    anchors.add(artists, seconds, i)
                    found = i
                out.append(found)
            yield batch.append_column("anchor", pa.array(out, pa.int64()))

    return run


def _in_order(rows: DataFrame, group: list[str], known: str | None = None) -> DataFrame:
    """rows with ``anchor``; each group in one task, sorted as it comes."""
    order = [*group, *([F.col(known).desc()] if known else []), "path", "file_id"]
    dealt = rows.repartition(*group).sortWithinPartitions(*order)
    return dealt.mapInArrow(_anchored(group, known), _schema(rows))


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in [*rows.dtypes, ("anchor", "bigint")])


def _split(rows: DataFrame) -> DataFrame:
    """rows with ``part``: equal for files of one title whose artists are linked by sets of two and more. No others fit each other."""
    node = lambda a: F.xxhash64("key", a)
    sets = rows.select("key", "artist_set").distinct()
    links = sets.select(node(F.col("artist_set")[0]).alias("a"), "key", F.explode(F.slice("artist_set", F.lit(2), F.size("artist_set"))).alias("artist")).select("a", node(F.col("artist")).alias("b"))
    found = materialize(connected_components(links, "a", "b"), "parts")
    rows = rows.withColumn("node", node(F.col("artist_set")[0])).join(growing(found), "node", "left")
    return rows.withColumn("part", F.coalesce("component", "node")).drop("node", "component")


def _rounds(rows: DataFrame, count: int, unit: int) -> Iterator[DataFrame]:
    """(key, file_id, anchor) of parts of more than ``unit`` files, of which there are ``count`` rows in all.

    Files are dealt to ranges of part and path once. A round takes whole ranges, so each takes at least about ``unit`` files of every part
    out, and all that its anchors fit.
    """
    part = ["key", "part"]
    order = [*part, "path", "file_id"]
    left = materialize(rows.repartitionByRange(-(-4 * count // unit), *order).withColumn("piece", F.spark_partition_id()), "pieces")
    while not left.isEmpty():
        sizes = left.groupBy(*part, "piece").agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(*part).orderBy("piece")) - F.col("_n")
        turn = materialize(sizes.select(*part, "piece", (before < unit).alias("now")), "turn")  # a few rows per ``unit`` files
        now, later = (left.join(F.broadcast(turn.filter(F.col("now") == on).drop("now")), [*part, "piece"]) for on in (True, False))
        decided = materialize(_in_order(now.select(*rows.columns), part), "decided")
        yield decided.select("key", "file_id", "anchor")
        anchors = decided.filter("anchor = file_id").drop("anchor").join(F.broadcast(turn.filter("not now").drop("now")), part)
        both = later.withColumn("known", F.lit(False)).unionByName(anchors.withColumn("known", F.lit(True)))
        met = materialize(_in_order(both, [*part, "piece"], "known").filter("not known").drop("known"), "met")
        yield met.filter("anchor is not null").select("key", "file_id", "anchor")
        left = met.filter("anchor is null").drop("anchor")


def anchored(rows: DataFrame, unit: int | None = None) -> DataFrame:
    """(key, file_id, anchor) of files (key, path, file_id, artist_set, duration) with their title as key: the file that takes each, which may
    be itself. Sets of artists are not empty."""
    unit = unit or UNIT
    titles = materialize(rows.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > unit).select("key"), "titles")
    if titles.isEmpty():
        return _in_order(rows, ["key"]).select("key", "file_id", "anchor")
    few = F.broadcast(titles)  # at most one per ``unit`` files
    small = _in_order(rows.join(few, "key", "left_anti"), ["key"]).select("key", "file_id", "anchor")
    parts = materialize(_split(rows.join(few, "key", "left_semi")), "split")
    sizes = materialize(parts.groupBy("key", "part").agg(F.count("*").alias("_n")).filter(F.col("_n") > unit), "sizes")
    large = F.broadcast(sizes.drop("_n"))
    found = small.union(_in_order(parts.join(large, ["key", "part"], "left_anti"), ["key", "part"]).select("key", "file_id", "anchor"))
    count = sizes.agg(F.sum("_n")).first()[0]
    if count:
        for more in _rounds(parts.join(large, ["key", "part"], "left_semi"), count, unit):
            found = found.union(more)
    return found
