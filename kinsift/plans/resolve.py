"""The whole scan: catalogue, rules, groups, ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from kinsift.operators import detect, merge
from kinsift.operators.rank import ranked
from kinsift.operators.skew import growing
from kinsift.plans.config import ScanConfig
from kinsift.storage import materialize


@dataclass(frozen=True)
class Resolution:
    """groups: a row per group, with gid; members: a row per file in a group, with the catalogue's columns, rank and best."""

    groups: DataFrame
    members: DataFrame


def keys_of(files: DataFrame, config: ScanConfig) -> DataFrame:
    """files with the keys of those rules that are on, and no other, computed once."""
    narrow = files.drop("content")
    keyed = detect.with_keys(narrow.repartition(config.key_partitions) if config.key_partitions else narrow, config.unicode)
    off = [() if config.use_tags else ("tag_key", "title_key"), () if config.use_tags and config.use_feat else ("core_key", "artist_set"), () if config.use_name else ("name_key",)]
    return materialize(keyed.drop(*(k for names in off for k in names)), "keys") if config.use_tags or config.use_name else keyed


def find_claims(files: DataFrame, config: ScanConfig, keyed: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Claims of all rules that are on. Rules by closeness see only files that no rule before claimed. ``keyed``: the keys
    of files, where they are computed already, with those of the rules that are on."""
    keyed = keys_of(files, config) if keyed is None else keyed
    found, methods = None, []
    for method, rows in detect.equal_key_stages(files, keyed, config):
        rows = materialize(rows, method)
        found, methods = rows if found is None else found.union(rows), [*methods, method]
    for method, on, rule in (("duration", config.use_duration, detect.close_duration), ("size", config.use_size, lambda f: detect.close_size(f, config))):
        if on:
            rows = materialize(rule(files if found is None else detect.unclaimed(files, found)), method)
            found, methods = rows if found is None else found.union(rows), [*methods, method]
    return found, methods


def resolve(files: DataFrame, config: ScanConfig) -> Resolution:
    """Groups of duplicates among files (file_id, path, name, category, size, mtime_s, and what the rules use)."""
    found, methods = find_claims(files, config)
    members, credits = merge.merge(found, methods)
    groups = materialize(merge.number_groups(merge.summarize(members, credits, files)), "groups")
    rows = members.join(growing(groups.select("group", "gid")), "group").drop("group").join(growing(files.drop("content")), "file_id")
    return Resolution(groups, ranked(rows))
