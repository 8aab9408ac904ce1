"""Selection policies: which files of the groups are marked for deletion.

Members carry gid, path and best; a selection is a boolean column ``marked``. All policies are
column expressions or aggregates per group joined back, so a group of any size is no one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def auto_select(members: DataFrame, groups: DataFrame, least: int = 70) -> DataFrame:
    """Marks all but the best of every group of at least this confidence."""
    rows = members.join(groups.select("gid", "confidence"), "gid")
    return rows.withColumn("marked", (F.col("confidence") >= least) & ~F.col("best"))


def auto_counts(groups: DataFrame, least: int = 70) -> DataFrame:
    """(auto, skipped): groups that auto_select takes and leaves."""
    return groups.agg(F.count_if(F.col("confidence") >= least).alias("auto"), F.count_if(F.col("confidence") < least).alias("skipped"))


def guarded(members: DataFrame, requests: DataFrame) -> DataFrame:
    """members with ``marked`` after requests (path, turn), without ever marking the last file of a group.

    A request that would leave its group without a survivor is refused: where all unmarked files of a
    group are asked for, the last request in turn. A file's first request counts.
    """
    asked = requests.groupBy("path").agg(F.min("turn").alias("turn"))
    rows = members.join(asked, "path", "left").withColumn("_new", F.col("turn").isNotNull() & ~F.col("marked"))
    seen = rows.groupBy("gid").agg(F.count_if(~F.col("marked") & ~F.col("_new")).alias("_left"), F.max(F.when(F.col("_new"), F.struct("turn", "path"))).alias("_last"))
    rows = rows.join(seen, "gid")
    refused = (F.col("_left") == 0) & (F.col("path") == F.col("_last.path"))
    return rows.withColumn("refused", F.col("_new") & F.coalesce(refused, F.lit(False))).withColumn("marked", F.col("marked") | (F.col("_new") & ~F.col("refused"))).select(*members.columns, "refused")


def toggle_groups(members: DataFrame, gids: DataFrame) -> DataFrame:
    """In the groups of gids: unmarks all if any is marked, else marks all but the best."""
    any_marked = members.groupBy("gid").agg(F.bool_or("marked").alias("_any")).join(gids.select("gid").distinct(), "gid")
    rows = members.join(any_marked, "gid", "left")
    new = F.when(F.col("_any").isNull(), F.col("marked")).when(F.col("_any"), F.lit(False)).otherwise(~F.col("best"))
    return rows.withColumn("marked", new).select(members.columns)


def keep_only(members: DataFrame, keep: DataFrame) -> DataFrame:
    """In the groups of keep (gid, path): marks every other file."""
    chosen = keep.select("gid", F.col("path").alias("_keep"))
    rows = members.join(chosen, "gid", "left")
    return rows.withColumn("marked", F.when(F.col("_keep").isNull(), F.col("marked")).otherwise(F.col("path") != F.col("_keep"))).select(members.columns)


def mark(members: DataFrame, paths: DataFrame, marked: bool) -> DataFrame:
    """Unmarks the files of paths, or marks them under the guard."""
    if marked:
        return guarded(members, paths.select("path", F.xxhash64("path").alias("turn"))).drop("refused")
    rows = members.join(paths.select("path").distinct().withColumn("_hit", F.lit(True)), "path", "left")
    return rows.withColumn("marked", F.col("marked") & F.col("_hit").isNull()).select(members.columns)


def unmark_all(members: DataFrame) -> DataFrame:
    return members.withColumn("marked", F.lit(False))


def whole_groups(members: DataFrame, gids: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Marks every file of the groups of gids; only with ``allow_empty``, as no copy survives."""
    if not allow_empty:
        raise ValueError("marking whole groups leaves no copy: pass allow_empty=True")
    rows = members.join(gids.select("gid").distinct().withColumn("_hit", F.lit(True)), "gid", "left")
    return rows.withColumn("marked", F.col("marked") | F.col("_hit").isNotNull()).select(members.columns)


def marked_totals(members: DataFrame) -> DataFrame:
    """(gid, marked_files, marked_bytes) by group, and overall with a null gid."""
    totals = [F.count_if("marked").alias("marked_files"), F.sum(F.when(F.col("marked"), F.col("size")).otherwise(F.lit(0))).cast("bigint").alias("marked_bytes")]
    return members.rollup("gid").agg(*totals)


def survivors(members: DataFrame) -> DataFrame:
    return members.filter(~F.col("marked"))


# ---- views of the result ------------------------------------------------------------------------


def confidence_class(confidence):
    return F.when(confidence >= 95, "high").when(confidence >= 70, "mid").otherwise("low")


def by_confidence(groups: DataFrame, kind: str = "all") -> DataFrame:
    """Groups that are all, sure (95 and more), trusted (70 and more) or weak (below 70)."""
    c = F.col("confidence")
    tests = {"all": F.lit(True), "sure": c >= 95, "trusted": c >= 70, "weak": c < 70}
    if kind not in tests:
        raise ValueError(f"no such class: {kind}")
    return groups.filter(tests[kind])


def search(groups: DataFrame, members: DataFrame, needle: str) -> DataFrame:
    """Groups any of whose files has the needle in path, artist, title or album, in any case."""
    found = F.lit(False)
    for column in ("path", "artist", "title", "album"):
        found = found | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(needle.strip().lower()))
    return groups.join(members.filter(found).select("gid").distinct(), "gid", "left_semi")


def visible_totals(members: DataFrame) -> DataFrame:
    return members.agg(F.count_distinct("gid").alias("groups"), F.count("*").alias("files"))


def capped(groups: DataFrame, most: int = 4000) -> DataFrame:
    """The first ``most`` groups by number, each with how many were cut off."""
    return groups.filter(F.col("gid") <= most).withColumn("cut", F.lit(max(0, groups.count() - most)).cast("bigint"))


def choose_columns(rows: DataFrame, chosen: list[str], known: list[str]) -> DataFrame:
    """Some of the known columns, at least one."""
    if not chosen or set(chosen) - set(known):
        raise ValueError("choose at least one of the known columns")
    return rows.select(*chosen)
