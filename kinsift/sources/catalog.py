"""Catalogues of files: what a scan takes of them, before anything is read."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinsift.functions.text import extension_of, folder_of, name_of
from kinsift.plans.config import AUDIO, IMAGE, SYSTEM_FOLDERS, VIDEO, ScanConfig
from kinsift.sources.signatures import VERSION, lookup


def category(ext: Column) -> Column:
    return F.when(ext.isin(AUDIO), "audio").when(ext.isin(VIDEO), "video").when(ext.isin(IMAGE), "image").otherwise("other")


def accepts(config: ScanConfig, ext: Column) -> Column:
    if config.mode == "all":
        return F.lit(True)
    return ext.isin(AUDIO if config.mode == "audio" else list(config.extensions))


def with_parts(files: DataFrame, root: Column | None = None) -> DataFrame:
    """files with name, folder, ext, category and rel_folder (below the root, ``/`` between segments)."""
    path = F.col("path")
    folder = folder_of(path)
    below = folder if root is None else F.when(F.startswith(folder, root), F.substr(folder, F.length(root) + 1)).otherwise(folder)
    out = files.withColumns({"name": name_of(path), "folder": folder, "ext": extension_of(path), "rel_folder": F.btrim(F.translate(below, "\\", "/"), F.lit("/"))})
    return out.withColumn("category", category(F.col("ext")))


def in_scope(config: ScanConfig) -> Column:
    """Folders that the walk enters: none of the system's, hidden ones only if asked, the root alone if flat."""
    segments = F.split("rel_folder", "/")
    ok = ~F.arrays_overlap(F.transform(segments, F.lower), F.array(*map(F.lit, SYSTEM_FOLDERS)))
    if config.skip_hidden:
        ok = ok & ~F.exists(segments, lambda s: F.startswith(s, F.lit(".")))
    if not config.recursive:
        ok = ok & (F.col("rel_folder") == "")
    return ok


def visible(files: DataFrame, config: ScanConfig) -> Column:
    """Files without the hidden (2) and system (4) attribute, where the catalogue has attributes."""
    if not config.skip_hidden or "attrs" not in files.columns:
        return F.lit(True)
    return F.coalesce(F.col("attrs"), F.lit(0)).bitwiseAND(6) == 0


def collect(files: DataFrame, config: ScanConfig, root: Column | None = None) -> DataFrame:
    """Files that a scan works on: each path once, in scope, of an accepted kind, visible and large enough."""
    rows = with_parts(files, root)
    rows = rows.filter(in_scope(config) & accepts(config, F.col("ext")) & visible(files, config) & (F.col("size") >= config.min_size))
    rows = rows.withColumn("path_key", F.lower("path") if config.fold_case else F.col("path"))
    return rows.dropDuplicates(["path_key"]).drop("path_key")


def observed(files: DataFrame, config: ScanConfig, root: Column | None = None, known: DataFrame | None = None) -> tuple[DataFrame, Observation]:
    """The files that collect() gives, and the figures of the scan, counted while they are first computed.

    Of the files in scope and of an accepted kind: scanned, skipped (hidden or too small), unreadable (without
    a size), and with known signatures (path, size, mtime_ns) cache_hits among the scanned. The observation
    has its figures after the first action on the files; no pass is made for them.
    """
    rows = with_parts(files, root).filter(in_scope(config) & accepts(config, F.col("ext")))
    rows = rows.withColumn("path_key", F.lower("path") if config.fold_case else F.col("path")).dropDuplicates(["path_key"]).drop("path_key")
    rows = rows.withColumn("_hit", F.lit(False)) if known is None else lookup(rows, known.select(VERSION)).withColumnRenamed("hit", "_hit")
    small = visible(files, config) & (F.col("size") >= config.min_size)
    ok, told = F.coalesce(small, F.lit(False)), Observation()
    counts = {"scanned": ok, "skipped": ~ok & F.col("size").isNotNull(), "unreadable": F.col("size").isNull(), "cache_hits": ok & F.col("_hit")}
    return rows.observe(told, *(F.count_if(c).alias(n) for n, c in counts.items())).filter(ok).drop("_hit"), told


def statistics(files: DataFrame, config: ScanConfig, root: Column | None = None) -> DataFrame:
    """One row: files scanned and skipped (hidden or too small), of those in scope and of an accepted kind.

    Files without a size could not be read.
    """
    rows, told = observed(files, config, root)
    rows.write.format("noop").mode("overwrite").save()
    return files.sparkSession.createDataFrame([tuple(told.get[n] for n in ("scanned", "skipped", "unreadable"))], "scanned bigint, skipped bigint, unreadable bigint")


def summary(told: Observation, groups: DataFrame) -> DataFrame:
    """One row of a scan's six figures: those observed, files in groups (dupes), and bytes that all but the largest of each take."""
    totals = groups.agg(F.coalesce(F.sum("files"), F.lit(0)).cast("bigint").alias("dupes"), F.coalesce(F.sum("reclaimable"), F.lit(0)).cast("bigint").alias("reclaimable"))
    return totals.select(*(F.lit(told.get[n]).cast("bigint").alias(n) for n in ("scanned", "skipped", "unreadable", "cache_hits")), "dupes", "reclaimable")


def resolve_tags(tags: Column) -> dict[str, Column]:
    """artist, title, album and track of a map of tag lists: the first key that has a text, trimmed; null for none."""
    # Keys in the order in which they are asked.
    keys = {
        "artist": ["artist", "albumartist", "performer", "TPE1", "©ART", "Author"],
        "title": ["title", "TIT2", "©nam", "Title"],
        "album": ["album", "TALB", "©alb", "WM/AlbumTitle"],
        "track": ["tracknumber", "TRCK", "trkn"],
    }
    return {field: F.coalesce(*(F.nullif(F.trim(F.try_element_at(F.try_element_at(tags, F.lit(k)), F.lit(1))), F.lit("")) for k in names)) for field, names in keys.items()}


def tag_fields(*values: Column) -> Column:
    """How many of the values are there and not empty."""
    return functools.reduce(Column.__add__, (F.coalesce((v != "").cast("int"), F.lit(0)) for v in values))


def has_cover(tags: Column) -> Column:
    return F.coalesce(F.exists(F.map_keys(tags), lambda k: F.startswith(k, F.lit("APIC")) | F.startswith(k, F.lit("covr"))), F.lit(False))
