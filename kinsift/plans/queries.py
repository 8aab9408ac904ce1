"""One query per operator over the standard tables, and DuckDB SQL that must give the same rows."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinsift.functions import dates, fmt
from kinsift.functions import text as T
from kinsift.operators import anchors, detect, merge, rank, select
from kinsift.operators.skew import growing
from kinsift.plans.config import FEAT_BUCKET, ScanConfig
from kinsift.plans.fixtures import view, with_views
from kinsift.plans.resolve import find_claims, keys_of, resolve
from kinsift.sources import catalog, digests, folders, regions, report, signatures
from kinsift.sources.signature_table import SignatureTable
from kinsift.storage import materialize, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---- shared by the queries ----------------------------------------------------------------------

CONFIG = ScanConfig(mode="all", min_size=0, key_partitions=8)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.with_parts(view(spark, sf_dir, "tracks"), F.lit("/music"))
    return rows.withColumn("tag_fields", catalog.tag_fields(F.col("artist"), F.col("title"), F.col("album"))).withColumn("has_cover", F.col("file_id") % 4 == 0)


def dealt(files: DataFrame) -> DataFrame:
    """files over all cores: the table behind the tracks is one split, and keys cost more than moving its rows."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism)


KEY_COLUMNS = ["tag_key", "title_key", "core_key", "name_key", "artist_set"]


def keyed(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """Tracks with the wanted keys (all, if none is named), computed once."""
    rows = detect.with_keys(dealt(tracks(spark, sf_dir)))
    return materialize(rows.drop(*(k for k in KEY_COLUMNS if wanted and k not in wanted)), "keys")


def tag_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tracks with one tag key, numbered by their smallest id; confidence by rule of the number."""
    rows = detect.buckets(keyed(spark, sf_dir, "tag_key"), F.col("tag_key"))
    ids = rows.groupBy("key").agg(F.min("file_id").alias("gid"))
    return materialize(rows.join(ids, "key").withColumn("match_method", F.lit("tag")), "members")


def confidences(members: DataFrame) -> DataFrame:
    c = F.when(F.col("gid") % 3 == 0, 98).when(F.col("gid") % 3 == 1, 72).otherwise(40)
    return members.groupBy("gid").agg(F.count("*").alias("files"), F.sum("size").alias("total_size"), (F.sum("size") - F.max("size")).alias("reclaimable")).withColumn("confidence", c.cast("bigint"))


def marked_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tag_members with the best of each group and marks on some files."""
    rows = tag_members(spark, sf_dir)
    best = rank.best_rows(rows)
    rows = rows.join(best, "gid").withColumn("best", F.col("path") == F.col("best_path")).drop("best_path")
    return materialize(rows.withColumn("marked", F.col("file_id") % 5 == 0), "marked")


def nrm(x: str) -> str:
    """Comparison form of ASCII text in DuckDB SQL."""
    noise = r"\b(official\s*(music\s*)?(video|audio|lyrics?|visualizer)|lyrics?|hq|hd|4k|full\s*hd|(320|256|192|160|128|96|64)\s*k(bps)?|full\s*album|remaster(ed)?(\s*\d{4})?|explicit)\b"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '{noise}', ' ', 'g'), '[^a-z0-9_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


NAME = r"regexp_extract(path, '[^/]*$')"
STEM = rf"regexp_replace({NAME}, '\.[^.]*$', '')"
MARKS = r"\(\s*\d{1,3}\s*\)\s*$|[-_\s]+copy(\s*\(\s*\d+\s*\))?\s*$"
NAME_KEY = nrm(rf"trim(regexp_replace({STEM}, '{MARKS}', ''), ' -_.')")
CORE = nrm(r"trim(regexp_replace(regexp_replace(title, '(?i)[\(\[\{]\s*(feat|ft|featuring|with)\b\.?[^\)\]\}]*[\)\]\}]', ' ', 'g'), '(?i)\s*[-,]?\s*\b(feat|ft|featuring|with)\b\.?\s+.*$', ''), ' -_.')")
COPY = rf"(regexp_matches({STEM}, '{MARKS}') or contains(lower({STEM}), 'copy'))"

KEYS = f"""
keyed as (
  select *, {NAME} as name, case when {nrm("artist")} <> '' and {nrm("title")} <> '' then {nrm("artist")} || '|' || {nrm("title")} end as tag_key,
    case when length({nrm("title")}) >= 3 then {nrm("title")} end as long_title, {NAME_KEY} as base from tracks),
keys as (select *, case when tag_key is null then long_title end as title_key, case when length(base) >= 3 then 'audio|' || base end as name_key from keyed)"""


def bucket_sql(key: str) -> str:
    return with_views("tracks") + f", {KEYS} select file_id, {key} as key, count(*) over (partition by {key}) as files from keys where {key} is not null qualify count(*) over (partition by {key}) > 1"


SCORED = f"""{KEYS},
m as (select *, min(file_id) over (partition by tag_key) as gid, cast(artist <> '' as int) + cast(title <> '' as int) + cast(album <> '' as int) as tag_fields, file_id % 4 = 0 as has_cover,
    {COPY} as is_copy, contains(lower(path), '/temp') as passing, length(path) - length(replace(path, '/', '')) as depth
  from keys where tag_key is not null qualify count(*) over (partition by tag_key) > 1),
r as (select *, row_number() over (partition by gid order by is_copy, passing, bitrate desc, tag_fields desc, has_cover desc, size desc, round_even(duration, 1) desc, depth, mtime_s, path desc) as place,
    case gid % 3 when 0 then 98 when 1 then 72 else 40 end as confidence from m),
s as (select *, place = 1 as best, file_id % 5 = 0 as marked from r)"""
TAG = with_views("tracks") + ", " + SCORED


# ---- catalogue ----------------------------------------------------------------------------------


@query(
    with_views("tracks")
    + rf"""
select file_id, {NAME} as name, regexp_replace(path, '/[^/]*$', '') as folder, '.flac' as ext, 'audio' as category
from tracks where path like '%.flac' and size >= 100000"""
)
def catalog_filter(spark, sf_dir):
    config = ScanConfig(mode="custom", extensions=(".flac",), min_size=100_000)
    rows = catalog.collect(view(spark, sf_dir, "tracks").union(view(spark, sf_dir, "tracks")), config, F.lit("/music"))
    return rows.select("file_id", "name", "folder", "ext", "category")


@query(with_views("tracks") + " select cast(count_if(size >= 100000) as bigint) as scanned, cast(count_if(size < 100000) as bigint) as skipped, cast(0 as bigint) as unreadable from tracks where path like '%.flac'")
def scan_stats(spark, sf_dir):
    return catalog.statistics(view(spark, sf_dir, "tracks"), ScanConfig(mode="custom", extensions=(".flac",), min_size=100_000), F.lit("/music"))


@query(
    with_views("tracks")
    + r"""
select file_id, nullif(artist, '') as artist, coalesce(nullif(title, ''), nullif(album, '')) as title, nullif(album, '') as album,
  cast(artist <> '' as int) + cast(coalesce(nullif(title, ''), nullif(album, '')) is not null as int) + cast(album <> '' as int) as tag_fields, file_id % 4 = 0 as has_cover
from tracks"""
)
def tag_resolution(spark, sf_dir):
    rows = view(spark, sf_dir, "tracks")
    pad = lambda c: F.array(F.concat(F.lit(" "), F.col(c)))
    tags = F.create_map(F.lit("performer"), F.array().cast("array<string>"), F.lit("TPE1"), pad("artist"), F.lit("title"), pad("title"), F.lit("Title"), pad("album"), F.lit("TALB"), pad("album"), F.when(F.col("file_id") % 4 == 0, "APIC:front").otherwise("other"), F.array(F.lit("x")))
    rows = rows.select("file_id", tags.alias("tags"))
    got = catalog.resolve_tags(F.col("tags"))
    rows = rows.select("file_id", got["artist"].alias("artist"), got["title"].alias("title"), got["album"].alias("album"), got["track"].alias("track"), catalog.has_cover(F.col("tags")).alias("has_cover"))
    return rows.withColumn("tag_fields", catalog.tag_fields(F.col("artist"), F.col("title"), F.col("album"), F.col("track"))).select("file_id", "artist", "title", "album", "tag_fields", "has_cover")


@query(
    with_views("tracks")
    + f", {KEYS}"
    + rf"""
select file_id, {nrm("title")} as title, {CORE} as core, coalesce(tag_key, '') as tag_key, base as name_key, {COPY} as copy,
  case when artist <> '' and title <> '' then artist || ' — ' || title else artist || title end as display
from keys"""
)
def text_keys(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    return rows.select(
        "file_id",
        T.normalize(F.col("title"), False).alias("title"),
        T.core_title(F.col("title"), False).alias("core"),
        F.coalesce(T.tag_key(F.col("artist"), F.col("title"), False), F.lit("")).alias("tag_key"),
        T.name_key(F.col("name"), False).alias("name_key"),
        T.looks_like_copy(T.stem_of(F.col("name"))).alias("copy"),
        T.display(F.col("artist"), F.col("title")).alias("display"),
    )


@query(with_views("tracks") + rf", a as (select file_id, list_sort(list_distinct(list_filter(list_transform(string_split(artist, ' & '), lambda x: {nrm('x')}), lambda x: length(x) >= 2))) as w from tracks) select file_id, cast(len(w) as bigint) as n, array_to_string(w, ';') as artists from a")
def artist_sets(spark, sf_dir):
    rows = view(spark, sf_dir, "tracks").select("file_id", T.artists(F.col("artist"), False).alias("w"))
    return rows.select("file_id", F.size("w").cast("bigint").alias("n"), F.array_join("w", ";").alias("artists"))


# ---- rules by equal keys ------------------------------------------------------------------------


@query(
    with_views("doc_files")
    + """,
g as (select min(file_id) as "group", min(path) as first_path, count(*) as files, cast(sum(size) as bigint) as total_size, cast(sum(size) - max(size) as bigint) as reclaimable
  from doc_files where size > 0 group by size, sha256(content) having count(*) > 1)
select row_number() over (order by reclaimable desc, first_path) as gid, "group", first_path, files, total_size, reclaimable, 100 as confidence from g"""
)
def exact_groups(spark, sf_dir):
    files = view(spark, sf_dir, "doc_files")
    found = detect.exact(files)
    ids = found.groupBy("key").agg(F.min("file_id").alias("group"))
    members = found.join(ids, "key").select("group", "file_id").join(files.select("file_id", "path", "size"), "file_id")
    groups = members.groupBy("group").agg(F.min("path").alias("first_path"), F.count("*").alias("files"), F.sum("size").alias("total_size"), (F.sum("size") - F.max("size")).alias("reclaimable"))
    return merge.number_groups(groups.withColumn("confidence", F.lit(100))).select("gid", "group", "first_path", "files", "total_size", "reclaimable", "confidence")


@query(
    with_views("doc_files")
    + """,
r as (select file_id, instr(content, chr(10)) as start, length(content) as stop, content from doc_files),
d as (select file_id, stop - start as n, sha256(content[start + 1:]) as digest from r where start > 0)
select file_id, min(file_id) over (partition by n, digest) as "group", count(*) over (partition by n, digest) as files from d qualify count(*) over (partition by n, digest) > 1"""
)
def region_groups(spark, sf_dir):
    """The region of a document is what follows its first line."""
    files = view(spark, sf_dir, "doc_files")
    start = F.instr("content", "\n").cast("bigint")
    files = files.withColumns({"start": start, "end": F.length("content").cast("bigint")}).withColumn("digest", F.when(F.col("start") > 0, F.sha2(F.substr("content", F.col("start") + 1), 256)))
    found = detect.same_region(files)
    sizes = found.groupBy("key").agg(F.min("file_id").alias("group"), F.count("*").alias("files"))
    return found.join(sizes, "key").select("file_id", "group", "files")


def _bucket(spark, sf_dir, key: str) -> DataFrame:
    rows = detect.buckets(keyed(spark, sf_dir, key), F.col(key)).select("file_id", "key")
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("files")), "key").select("file_id", "key", "files")


@query(bucket_sql("tag_key"))
def tag_groups(spark, sf_dir):
    return _bucket(spark, sf_dir, "tag_key")


@query(bucket_sql("title_key"))
def title_groups(spark, sf_dir):
    return _bucket(spark, sf_dir, "title_key")


@query(bucket_sql("name_key"))
def name_groups(spark, sf_dir):
    return _bucket(spark, sf_dir, "name_key")


WORDS = rf"list_sort(list_distinct(list_filter(list_transform(string_split(artist, ' & '), lambda x: {nrm('x')}), lambda x: length(x) >= 2)))"
AGREE = "len(list_intersect(free[1].w, x.w)) = least(len(free[1].w), len(x.w)) and (free[1].d = 0 or x.d = 0 or abs(free[1].d - x.d) <= 2.5)"


CREDITS = rf"""
c as (select file_id, path, duration as d, {CORE} as core, {WORDS} as w from tracks),
k as (select core as key, list({{'id': file_id, 'w': w, 'd': d}} order by path) as free from c where len(w) > 0 and length(core) >= 3 group by core having count(*) between 2 and 60),
hop(key, free) as (
  select key, free from k
  union all
  select key, list_filter(free[2:], lambda x: not ({AGREE})) from hop where len(free) > 1),
g as (select key || '|' || free[1].id as key, free[1].id as anchor, list_filter(free[2:], lambda x: {AGREE}) as own from hop where len(free) > 1),
credited as (select key, unnest(list_prepend(anchor, list_transform(own, lambda x: x.id))) as file_id from g where len(own) > 0)"""


#: The same for titles of any number of files.
ALL_CREDITS = CREDITS.replace("count(*) between 2 and 60", "count(*) > 1")


@query(with_views("tracks") + f", {CREDITS} select key, file_id from credited")
def feat_groups(spark, sf_dir):
    return detect.same_song(keyed(spark, sf_dir, "core_key", "artist_set"), FEAT_BUCKET).select("key", "file_id")


# ---- rules by closeness -------------------------------------------------------------------------

ANCHORS = """
hop(a) as (select min(v) from x union all select (select min(v) from x where v > {limit}) from hop where a is not null)"""


@query(with_views("durations") + ", x as (select file_id, duration as v from durations where duration >= 20), " + ANCHORS.format(limit="a + 1.5") + " select file_id, v as duration, max(a) as anchor from x join hop on a <= v group by all")
def duration_anchors(spark, sf_dir):
    rows = view(spark, sf_dir, "durations").filter("duration >= 20")
    return anchors.anchor_clusters(rows, "duration", "anchor", window=1.5)


@query(with_views("sizes") + ", x as (select file_id, cast(size as double) as v from sizes), " + ANCHORS.format(limit="a * (1 + cast(0.02 as double))") + " select file_id, cast(v as bigint) as size, max(a) as anchor from x join hop on a <= v group by all")
def size_anchors(spark, sf_dir):
    return anchors.anchor_clusters(view(spark, sf_dir, "sizes"), "size", "anchor", ratio=0.02).select("file_id", "size", "anchor")


@query(
    with_views("sizes")
    + ", x as (select file_id, cast(size as double) as v, category from sizes where size >= 1000), "
    + ANCHORS.format(limit="a * (1 + cast(0.02 as double))")
    + """, c as (select file_id, category, max(a) as anchor from x join hop on a <= v group by all)
select file_id, min(file_id) over w as "group", count(*) over w as files from c window w as (partition by anchor, category) qualify count(*) over w > 1"""
)
def size_groups(spark, sf_dir):
    found = detect.close_size(view(spark, sf_dir, "sizes"), ScanConfig(min_size=1000))
    sizes = found.groupBy("key").agg(F.min("file_id").alias("group"), F.count("*").alias("files"))
    return found.join(sizes, "key").select("file_id", "group", "files")


@query(
    with_views("tracks")
    + f""", {KEYS},
p as (select file_id, duration as v, cast(size as double) as s from keys where duration >= 20 and file_id not in (select file_id from keys where tag_key is not null qualify count(*) over (partition by tag_key) > 1)),
x as (select v from p), {ANCHORS.format(limit="a + 1.5")},
c as (select file_id, s, max(a) as k from p join hop on a <= v group by all),
hop2(k, a) as (select k, min(s) from c group by k union all select h.k, (select min(s) from c where c.k = h.k and s > h.a * 1.25) from hop2 h where h.a is not null),
d as (select file_id, c.k, max(a) as b from c join hop2 on c.k = hop2.k and a <= s group by all)
select file_id, min(file_id) over w as "group", count(*) over w as files from d window w as (partition by k, b) qualify count(*) over w > 1"""
)
def duration_groups(spark, sf_dir):
    rows = keyed(spark, sf_dir, "tag_key")
    found = detect.close_duration(detect.unclaimed(rows, detect.same_tags(rows)))
    sizes = found.groupBy("key").agg(F.min("file_id").alias("group"), F.count("*").alias("files"))
    return found.join(sizes, "key").select("file_id", "group", "files")


# ---- groups -------------------------------------------------------------------------------------

STAGES = (("tag", "tag_key"), ("title", "title_key"), ("name", "name_key"))


def _labels() -> str:
    """SQL for the labels after each stage: the smallest file reachable over shared keys of the stages so far."""
    out, edges = [KEYS], []
    for n, (method, key) in enumerate(STAGES):
        edges.append(f"select file_id as f, min(file_id) over (partition by {key}) as g from keys where {key} is not null")
        both = f"e{n} as (select distinct * from (" + " union all ".join(f"select f, g from ({e}) union all select g, f from ({e})" for e in edges) + "))"
        reach = f"r{n}(f, g) as (select file_id, file_id from keys union select r.f, e.g from r{n} r join e{n} e on r.g = e.f)"
        out += [both, reach, f"l{n} as (select f, min(g) as label from r{n} group by f)"]
    claims = " union all ".join(f"select file_id as f, {n} as stage, '{m}' as method from keys where {k} is not null qualify count(*) over (partition by {k}) > 1" for n, (m, k) in enumerate(STAGES))
    credits = " union all ".join(
        (f"select label as c, {n} as stage from l{n} group by label having count(*) > 1" if n == 0 else f"select l{n}.label as c, {n} as stage from l{n} join l{n - 1} on l{n}.f = l{n - 1}.f group by l{n}.label having count(distinct l{n - 1}.label) > 1") for n in range(len(STAGES))
    )
    last = len(STAGES) - 1
    out += [f"claims as ({claims})", f"credits as (select distinct l.label as g, stage from ({credits}) c join l{last} l on l.f = c.c)", f"final as (select label as g, f from l{last} where f in (select f from claims))"]
    return with_views("tracks") + ", " + ", ".join(x.strip() for x in out)


def _resolved(spark, sf_dir):
    files = tracks(spark, sf_dir)
    rows = keyed(spark, sf_dir, "tag_key", "title_key", "name_key")
    found = detect.same_tags(rows).union(detect.same_title(rows)).union(detect.same_name(rows))
    return merge.merge(found, [m for m, _ in STAGES]), files


@query(_labels() + " select g as \"group\", final.f as file_id, min_by(method, stage) as match_method from final join claims on claims.f = final.f group by all")
def merged_groups(spark, sf_dir):
    (members, _), _ = _resolved(spark, sf_dir)
    return members


@query(
    _labels()
    + """,
size_of as (select g, count(*) as files, cast(sum(size) as bigint) as total_size, cast(sum(size) - max(size) as bigint) as reclaimable, min(path) as first_path from final join tracks on file_id = f group by g),
credit as (select g, string_agg(case stage when 0 then 'tag' when 1 then 'title' else 'name' end, ',' order by stage) as methods, min(case stage when 0 then 92 when 1 then 72 else 70 end) as confidence, count(*) > 1 as combined from credits group by g)
select row_number() over (order by confidence desc, reclaimable desc, first_path) as gid, g as "group", methods, confidence, combined, files, total_size, reclaimable from size_of join credit using (g)"""
)
def group_confidence(spark, sf_dir):
    (members, credits), files = _resolved(spark, sf_dir)
    groups = merge.number_groups(merge.summarize(members, credits, files))
    return groups.select("gid", "group", F.array_join("methods", ",").alias("methods"), "confidence", "combined", "files", "total_size", "reclaimable")


def _scan_sql() -> str:
    """The whole scan in SQL: rules stage by stage, components, the two rules by closeness on what is left, numbering and ranking."""
    names, sure = ("tag", "feat", "title", "name", "duration", "size"), (92, 90, 72, 70, 58, 40)
    shared = lambda n, key: f"select {n} as stage, cast({key} as varchar) as key, file_id as f from keys where {key} is not null qualify count(*) over (partition by {key}) > 1"
    equal = " union all ".join([shared(0, "tag_key"), "select 1, key, file_id from credited", shared(2, "title_key"), shared(3, "name_key")])
    out = [KEYS, ALL_CREDITS, f"equal as ({equal})", "star as (select stage, f, min(f) over (partition by stage, key) as g from equal)", "l as (select -1 as stage, file_id as f, file_id as label from keys)"]
    for n in range(4):
        out.append(f"e{n} as (select f, g from star where stage <= {n} union select g, f from star where stage <= {n})")
        out.append(f"r{n}(f, g) as (select file_id, file_id from keys union select r.f, e.g from r{n} r join e{n} e on r.g = e.f)")
        out.append(f"l{n} as (select f, min(g) as label from r{n} group by f)")
        before = "l" if n == 0 else f"l{n - 1}"
        out.append(f"c{n} as (select l{n}.label as label, {n} as stage from l{n} join {before} p on p.f = l{n}.f group by l{n}.label having count(distinct p.label) > 1)")
    window = ANCHORS.format(limit="a + 1.5").replace("hop", "hop_d").replace(" x ", " xd ")
    ratio = ANCHORS.format(limit="a * (1 + cast(0.02 as double))").replace("hop", "hop_s").replace(" x ", " xs ")
    out += [
        "pd as (select file_id, duration as v, cast(size as double) as s from keys where duration >= 20 and file_id not in (select f from equal))",
        "xd as (select v from pd)",
        window,
        "cd as (select file_id, s, max(a) as k from pd join hop_d on a <= v group by all)",
        "hop_b(k, a) as (select k, min(s) from cd group by k union all select h.k, (select min(s) from cd where cd.k = h.k and s > h.a * 1.25) from hop_b h where h.a is not null)",
        "dd as (select file_id, cd.k, max(a) as b from cd join hop_b on cd.k = hop_b.k and a <= s group by all)",
        "near_d as (select file_id as f, min(file_id) over w as label from dd window w as (partition by k, b) qualify count(*) over w > 1)",
        "ps as (select file_id, cast(size as double) as v from keys where file_id not in (select f from equal) and file_id not in (select f from near_d))",
        "xs as (select v from ps)",
        ratio,
        "cs as (select file_id, max(a) as k from ps join hop_s on a <= v group by all)",
        "near_s as (select file_id as f, min(file_id) over w as label from cs window w as (partition by k) qualify count(*) over w > 1)",
        "first_of as (select f, min(stage) as stage from equal group by f)",
        "placed as (select l3.f, label, stage from l3 join first_of on first_of.f = l3.f union all select f, label, 4 from near_d union all select f, label, 5 from near_s)",
        "credit as (" + " union all ".join(f"select m.label, c.stage from c{n} c join l3 m on m.f = c.label" for n in range(4)) + " union all select label, 4 from near_d union all select label, 5 from near_s)",
        "sure_of as (select label, min(case stage " + " ".join(f"when {k} then {c}" for k, c in enumerate(sure)) + " end) as confidence from credit group by label)",
        "sizes_of as (select label, cast(sum(size) - max(size) as bigint) as reclaimable, min(path) as first_path from placed join tracks on file_id = f group by label)",
        "numbered as (select label, confidence, row_number() over (order by confidence desc, reclaimable desc, first_path) as gid from sizes_of join sure_of using (label))",
        "whole as (select gid, confidence, case stage " + " ".join(f"when {k} then '{m}'" for k, m in enumerate(names)) + f" end as match_method, keys.*, cast(artist <> '' as int) + cast(title <> '' as int) + cast(album <> '' as int) as tag_fields, file_id % 4 = 0 as has_cover, {COPY} as is_copy, contains(lower(path), '/temp') as passing, length(path) - length(replace(path, '/', '')) as depth from placed join numbered using (label) join keys on file_id = f)",
        "ordered as (select *, row_number() over (partition by gid order by is_copy, passing, bitrate desc, tag_fields desc, has_cover desc, size desc, round_even(duration, 1) desc, depth, mtime_s, path desc) as rank from whole)",
    ]
    return with_views("tracks") + ", " + ", ".join(x.strip() for x in out) + " select gid, file_id, match_method, confidence, rank, rank = 1 as best from ordered"


@query(_scan_sql())
def full_scan(spark, sf_dir):
    """All rules that the tracks have columns for, merged, with the copy to keep."""
    found = resolve(tracks(spark, sf_dir), CONFIG)
    return found.members.join(growing(found.groups.select("gid", "confidence")), "gid").select("gid", "file_id", "match_method", "confidence", "rank", "best")


# ---- ranking and policies -----------------------------------------------------------------------


@query(TAG + " select gid, file_id, place as rank from s")
def best_copy(spark, sf_dir):
    return rank.ranked(tag_members(spark, sf_dir)).select("gid", "file_id", "rank")


@query(TAG + " select gid, file_id from s where not best")
def suggest_deletions(spark, sf_dir):
    return rank.suggested(tag_members(spark, sf_dir)).select("gid", "file_id")


REASONS = """,
o as (select gid, max(bitrate) as ob, max(size) as os, max(tag_fields) as ot, bool_or(has_cover) as oc, bool_or(is_copy) as ok, min(mtime_s) as om from s where not best group by gid),
w as (select s.gid, s.path, s.file_id, array_to_string(list_filter([
    case when bitrate > ob then 'higher bitrate (' || cast(bitrate // 1000 as varchar) || ' kbps)' end, case when size > os then 'larger' end, case when tag_fields > ot then 'more complete tags' end,
    case when has_cover and not oc then 'has cover art' end, case when not is_copy and ok then 'name shows no copy marker' end, case when mtime_s < om then 'older' end], lambda x: x is not null), ', ') as t
  from s join o using (gid) where best)"""


@query(TAG + REASONS + " select gid, path, coalesce(nullif(t, ''), 'default pick') as reason from w")
def keep_reasons(spark, sf_dir):
    return rank.reasons(tag_members(spark, sf_dir), "en")


@query(TAG + " select gid, file_id, row_number() over (partition by gid order by size desc, path) as place from s")
def members_in_order(spark, sf_dir):
    return rank.in_order(tag_members(spark, sf_dir)).select("gid", "file_id", "place")


@query(TAG + " select gid, file_id, confidence >= 70 and not best as marked from s")
def auto_select(spark, sf_dir):
    rows = marked_members(spark, sf_dir).drop("marked")
    return select.auto_select(rows, confidences(rows)).select("gid", "file_id", "marked")


@query(TAG + " select count(distinct case when confidence >= 70 then gid end) as auto, count(distinct case when confidence < 70 then gid end) as skipped from s")
def auto_select_counts(spark, sf_dir):
    return select.auto_counts(confidences(tag_members(spark, sf_dir)))


@query(
    TAG
    + """,
q as (select *, file_id % 2 = 0 and not marked as new from s),
l as (select *, count_if(not marked and not new) over (partition by gid) as open, max(case when new then file_id end) over (partition by gid) as last_new from q)
select gid, file_id, marked or (new and not (open = 0 and file_id = last_new)) as marked, new and open = 0 and file_id = last_new as refused from l"""
)
def survivor_guard(spark, sf_dir):
    rows = marked_members(spark, sf_dir)
    requests = rows.filter("file_id % 2 = 0").select("path", F.col("file_id").alias("turn"))
    return select.guarded(rows, requests).select("gid", "file_id", "marked", "refused")


@query(TAG + " select gid, file_id, case when gid % 2 = 1 then marked when bool_or(marked) over (partition by gid) then false else not best end as marked from s")
def toggle_group(spark, sf_dir):
    rows = marked_members(spark, sf_dir)
    return select.toggle_groups(rows, rows.filter("gid % 2 = 0").select("gid")).select("gid", "file_id", "marked")


@query(TAG + " select gid, file_id, case when gid % 2 = 1 then marked else file_id <> gid end as marked from s")
def keep_only(spark, sf_dir):
    rows = marked_members(spark, sf_dir)
    return select.keep_only(rows, rows.filter("gid % 2 = 0 and file_id = gid").select("gid", "path")).select("gid", "file_id", "marked")


@query(TAG + " select gid, file_id, marked and file_id % 10 <> 0 as marked from s")
def unmark_files(spark, sf_dir):
    rows = marked_members(spark, sf_dir)
    return select.mark(rows, rows.filter("file_id % 10 = 0"), False).select("gid", "file_id", "marked")


@query(TAG + " select gid, file_id, marked or gid % 2 = 0 as marked from s")
def mark_whole_groups(spark, sf_dir):
    rows = marked_members(spark, sf_dir)
    return select.whole_groups(rows, rows.filter("gid % 2 = 0"), allow_empty=True).select("gid", "file_id", "marked")


@query(TAG + " select coalesce(gid, 0) as gid, cast(count_if(marked) as bigint) as marked_files, cast(sum(case when marked then size else 0 end) as bigint) as marked_bytes from s group by rollup (gid)")
def marked_totals(spark, sf_dir):
    return select.marked_totals(marked_members(spark, sf_dir)).withColumn("gid", F.coalesce("gid", F.lit(0)))


# ---- views of the result ------------------------------------------------------------------------


@query(TAG + " select gid, cast(confidence as bigint) as confidence, case when confidence >= 95 then 'high' when confidence >= 70 then 'mid' else 'low' end as class from s where confidence >= 70 group by all")
def confidence_filter(spark, sf_dir):
    groups = select.by_confidence(confidences(tag_members(spark, sf_dir)), "trusted")
    return groups.select("gid", "confidence", select.confidence_class(F.col("confidence")).alias("class"))


@query(TAG + " select gid, count(*) as files from s group by gid having bool_or(contains(lower(path), 'widget') or contains(lower(artist), 'widget') or contains(lower(title), 'widget') or contains(lower(album), 'widget'))")
def search(spark, sf_dir):
    rows = tag_members(spark, sf_dir)
    return select.search(confidences(rows), rows, "WIDGET").select("gid", "files")


@query(TAG + " select count(distinct gid) as groups, count(*) as files from s")
def visible_totals(spark, sf_dir):
    return select.visible_totals(tag_members(spark, sf_dir))


@query(TAG + " select gid, file_id, bitrate, cast(row_number() over (order by gid, bitrate desc, path) as bigint) as place from s")
def sorted_members(spark, sf_dir):
    """place: a row's number in the order that the operator gives, its partitions being ranges of that order."""
    rows = rank.sorted_members(tag_members(spark, sf_dir), "bitrate", False).select("gid", "file_id", "bitrate", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("turn"))
    rows = materialize(rows, "sorted")
    before = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    before = before.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("done"))  # a row per partition
    return rows.join(F.broadcast(before), "part").select("gid", "file_id", "bitrate", (F.col("done") + F.col("turn") - F.col("first") + 1).alias("place"))


@query(TAG + ", g as (select gid, row_number() over (order by gid) as n from (select distinct gid from s)) select n as gid, gid as \"group\", greatest(0, (select count(*) from g) - 100) as cut from g where n <= 100")
def capped_groups(spark, sf_dir):
    """The result's cap, which is the feature here."""
    groups = merge.numbered(tag_members(spark, sf_dir).select(F.col("gid").alias("group")).distinct(), [F.col("group").asc()], "gid")
    return select.capped(groups, 100).select("gid", "group", "cut")


# ---- signatures and re-scans --------------------------------------------------------------------


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    files = view(spark, sf_dir, "doc_files").select("path", "file_id", "size", (F.col("mtime_s") * 1_000_000_000).alias("mtime_ns"), "content")
    old = view(spark, sf_dir, "old_signatures").join(files.select("file_id", "path"), "file_id")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("seen_day").cast("int")).cast("timestamp")
    return files, old.select("path", "size", (F.col("mtime_s") * 1_000_000_000).alias("mtime_ns"), F.concat(F.lit("old "), F.col("file_id")).alias("full"), day.alias("seen"))


@query("select doc_id as file_id, case when doc_id % 3 = 0 then 'new' when doc_id % 10 = 1 then 'changed' else 'hit' end as state from documents")
def rescan_diff(spark, sf_dir):
    files, old = _versions(spark, sf_dir)
    return signatures.states(files, old).select("file_id", "state")


@query(with_views("doc_files") + " select path, case when file_id % 3 = 0 or file_id % 10 = 1 then sha256(content) else 'old ' || cast(file_id as varchar) end as \"full\" from doc_files")
def signature_upsert(spark, sf_dir):
    files, old = _versions(spark, sf_dir)
    missed = signatures.lookup(files, old.select(signatures.VERSION)).filter("not hit")
    fresh = missed.withColumn("full", F.sha2("content", 256)).withColumn("seen", F.lit("2024-01-01").cast("timestamp"))
    return signatures.upsert(old, fresh).select("path", "full")


@query(with_views("doc_files") + " select path from doc_files where file_id % 3 <> 0 and 19000 + file_id % 200 >= 19110")
def signature_prune(spark, sf_dir):
    _, old = _versions(spark, sf_dir)
    now = F.date_add(F.lit("1970-01-01").cast("date"), 19200).cast("timestamp")
    return signatures.prune(old, now, 90).select("path")


@query("select cast(count_if(doc_id % 3 <> 0 and doc_id % 10 <> 1) as bigint) as hits, cast(count_if(doc_id % 3 = 0 or doc_id % 10 = 1) as bigint) as misses, cast(count_if(doc_id % 3 <> 0) as bigint) as rows from documents")
def signature_info(spark, sf_dir):
    files, old = _versions(spark, sf_dir)
    return signatures.info(old, signatures.lookup(files, old.select(signatures.VERSION)))


# ---- reports and deletions ----------------------------------------------------------------------


@query(
    TAG
    + ", a as (select *, count(*) over (partition by gid) as n from s where file_id % 3 <> 0) select dense_rank() over (order by gid) as gid, file_id from a where n > 1"
)
def regroup_after_delete(spark, sf_dir):
    rows = tag_members(spark, sf_dir).select("gid", "path", "file_id")
    deleted = rows.filter("file_id % 3 = 0").select("path", F.lit(True).alias("ok"))
    return merge.regroup(rows, deleted).select("gid", "file_id")


@query(TAG + " select cast(count_if(file_id % 7 <> 0) as bigint) as deleted, cast(count_if(file_id % 7 = 0) as bigint) as failed, cast(sum(case when file_id % 7 <> 0 then size else 0 end) as bigint) as freed from s where not best")
def deletion_totals(spark, sf_dir):
    rows = rank.suggested(tag_members(spark, sf_dir))
    return report.deletion_totals(rows.withColumn("ok", F.col("file_id") % 7 != 0))


@query(
    TAG
    + REASONS
    + """ select s.gid, 'Music tags: artist and title' || case when s.gid % 2 = 0 then ' (combined)' else '' end as method, cast(confidence as varchar) || '%' as confidence,
  case when best then 'keep' else 'suggested for deletion' end as state, name, regexp_replace(s.path, '/[^/]*$', '') as folder, size as bytes,
  cast(bitrate // 1000 as varchar) || ' kbps' as bitrate_text, artist, title, album, strftime(make_timestamp(mtime_s * 1000000), '%Y-%m-%d %H:%M') as modified, case when best then coalesce(nullif(t, ''), 'default pick') else '' end as reason
from s left join w on w.path = s.path"""
)
def report_rows(spark, sf_dir):
    rows = tag_members(spark, sf_dir)
    groups = confidences(rows).withColumns({"primary_method": F.lit("tag"), "combined": F.col("gid") % 2 == 0})
    return report.report(rows, groups, "en").drop("path", "size_text", "duration_text")


@query(
    TAG
    + r"""
select gid, file_id, row_number() over (partition by gid order by size desc, path) as place, case when artist <> '' and title <> '' then artist || ' — ' || title else artist || title end as title_text,
  cast(bitrate // 1000 as varchar) || ' kbps' as bitrate_text, strftime(make_timestamp(mtime_s * 1000000), '%Y-%m-%d %H:%M') as modified_text, 'Music tags: artist and title' as method_text,
  cast(count(*) over (partition by gid) as bigint) as files, cast(sum(size) over (partition by gid) as bigint) as total_size
from s"""
)
def result_view(spark, sf_dir):
    rows = tag_members(spark, sf_dir)
    groups = confidences(rows).withColumns({"primary_method": F.lit("tag"), "combined": F.lit(False)})
    return report.view(rows, groups, "en").select("gid", "file_id", "place", "title_text", "bitrate_text", "modified_text", "method_text", "files", "total_size")


# ---- dates and units ----------------------------------------------------------------------------


@query(
    with_views("dates")
    + """,
n as (select file_id, d, date_diff('day', date '1600-01-01', d) - 79 as n from dates),
c as (select *, n // 12053 as cycles, n % 12053 as k from n),
f as (select *, k // 1461 as fours, k % 1461 as r from c),
y as (select *, case when r >= 366 then (r - 1) // 365 else 0 end as later, case when r >= 366 then (r - 1) % 365 else r end as t from f)
select file_id, cast(979 + 33 * cycles + 4 * fours + later as integer) as year, cast(case when t < 186 then t // 31 else 6 + (t - 186) // 30 end + 1 as integer) as month, cast(case when t < 186 then t % 31 else (t - 186) % 30 end + 1 as integer) as day from y"""
)
def jalali_dates(spark, sf_dir):
    return view(spark, sf_dir, "dates").select("file_id", dates.jalali(F.col("d")).alias("j")).select("file_id", "j.year", "j.month", "j.day")


MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "]"
JALALI = (
    with_views("dates")
    + """,
n as (select file_id, d, date_diff('day', date '1600-01-01', d) - 79 as n, date_diff('day', d, date '1998-08-02') as ago from dates),
c as (select *, n // 12053 as cycles, n % 12053 as k from n),
f as (select *, k // 1461 as fours, k % 1461 as r from c),
y as (select *, case when r >= 366 then (r - 1) // 365 else 0 end as later, case when r >= 366 then (r - 1) % 365 else r end as t from f),
j as (select file_id, d, ago, 979 + 33 * cycles + 4 * fours + later as year, case when t < 186 then t // 31 else 6 + (t - 186) // 30 end + 1 as month, case when t < 186 then t % 31 else (t - 186) % 30 end + 1 as day from y),
w as (select *, """
    + f"""translate(day || ' ' || {MONTH_LIST}[month] || ' ' || year, '0123456789', '۰۱۲۳۴۵۶۷۸۹') as long_text,
  translate(year || '/' || lpad(cast(month as varchar), 2, '0') || '/' || lpad(cast(day as varchar), 2, '0'), '0123456789', '۰۱۲۳۴۵۶۷۸۹') as short_text from j)"""
)


@query(
    JALALI
    + """
select file_id, case when ago < 0 or ago >= 30 then long_text when ago = 0 then 'امروز' when ago = 1 then 'دیروز' else translate(cast(case when ago < 7 then ago else ago // 7 end as varchar), '0123456789', '۰۱۲۳۴۵۶۷۸۹') || case when ago < 7 then ' روز پیش' else ' هفته پیش' end end as said from w"""
)
def relative_dates(spark, sf_dir):
    return view(spark, sf_dir, "dates").select("file_id", dates.relative(F.col("d"), F.lit("1998-08-02").cast("date")).alias("said"))


@query(
    JALALI
    + """
select file_id, case when file_id % 10 = 0 then '—' else short_text end as fa_date, case when file_id % 10 = 0 then '—' else strftime(d, '%Y-%m-%d') end as en_date, long_text, short_text from w"""
)
def date_forms(spark, sf_dir):
    time = F.when(F.col("file_id") % 10 != 0, F.col("d").cast("timestamp"))
    return view(spark, sf_dir, "dates").select("file_id", dates.date_text(time, "fa").alias("fa_date"), dates.date_text(time, "en").alias("en_date"), dates.jalali_long(F.col("d")).alias("long_text"), dates.jalali_short(F.col("d")).alias("short_text"))


@query(with_views("dates") + " select file_id, strftime(d, '%Y-%m-%d') || case when file_id % 3 = 0 then ' 10:20:30' when file_id % 3 = 1 then ' 10:20:00' else ' 00:00:00' end as at from dates")
def stored_times(spark, sf_dir):
    rows = view(spark, sf_dir, "dates")
    text = F.concat(F.date_format("d", "yyyy-MM-dd"), F.when(F.col("file_id") % 3 == 0, "T10:20:30").when(F.col("file_id") % 3 == 1, " 10:20").otherwise(""))
    return rows.select("file_id", F.date_format(dates.parse_stored(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    with_views("tracks")
    + r"""
select file_id, cast(bitrate // 1000 as varchar) || ' kbps' as bitrate_text,
  case when s = 0 then '—' when s >= 3600 then (s // 3600) || ':' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') else (s // 60) || ':' || lpad(cast(s % 60 as varchar), 2, '0') end as duration_text,
  case when b < 1024 then b || ' B' when b >= 1048576 then printf(case when b >= 104857600 then '%.0f MB' else '%.1f MB' end, case when b >= 104857600 then round_even(b / 1048576, 0) else round_even(b / 1048576, 1) end)
    when b >= 102400 then printf('%.0f KB', round_even(b / 1024, 0)) else printf('%.1f KB', round_even(b / 1024, 1)) end as size_text,
  case when len(p) <= 2 then f else '…\' || p[-2] || '\' || p[-1] end as folder_text
from (select *, file_id % 9000 as s, case file_id % 4 when 0 then size % 2000 when 1 then size * 300 else size end as b, regexp_replace(path, '/[^/]*$', '') as f, list_filter(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), lambda x: x <> '') as p from tracks)""".replace("\\\\", "\\")
)
def human_units(spark, sf_dir):
    rows = view(spark, sf_dir, "tracks").withColumn("folder", T.folder_of(F.col("path")))
    size = F.when(F.col("file_id") % 4 == 0, F.col("size") % 2000).when(F.col("file_id") % 4 == 1, F.col("size") * 300).otherwise(F.col("size"))
    return rows.select("file_id", fmt.bitrate_text(F.col("bitrate"), "en").alias("bitrate_text"), fmt.duration_text(F.col("file_id") % 9000, "en").alias("duration_text"), fmt.size_text(size, "en").alias("size_text"), T.short_folder(F.col("folder")).alias("folder_text"))


# ---- scopes, scripts, bytes, toggles ------------------------------------------------------------


@query(
    with_views("doc_files")
    + r""",
p as (select file_id, case file_id % 5 when 0 then '/lib/Node_Modules/x/' when 1 then '/lib/.cache/' when 2 then '/lib/' when 3 then '/lib/a/b/' else '/lib/a/' end || file_id || '.txt' as path, file_id % 8 as attrs from doc_files)
select m.mode, file_id from p, (values ('all'), ('flat'), ('hidden')) m(mode)
where file_id % 5 <> 0 and (m.mode = 'hidden' or (file_id % 5 <> 1 and attrs & 6 = 0)) and (m.mode <> 'flat' or file_id % 5 = 2)"""
)
def scan_scopes(spark, sf_dir):
    """System folders are never entered; hidden folders and files only if asked; a flat scan takes the root's files alone."""
    folder = F.element_at(F.array(*map(F.lit, ("/lib/Node_Modules/x/", "/lib/.cache/", "/lib/", "/lib/a/b/", "/lib/a/"))), (F.col("file_id") % 5 + 1).cast("int"))
    files = view(spark, sf_dir, "doc_files").select("file_id", F.concat(folder, F.col("file_id").cast("string"), F.lit(".txt")).alias("path"), "size", (F.col("file_id") % 8).cast("int").alias("attrs"))
    scopes = {"all": {}, "flat": {"recursive": False}, "hidden": {"skip_hidden": False}}
    found = [catalog.collect(files, ScanConfig(mode="all", min_size=0, **more), F.lit("/lib")).select(F.lit(mode).alias("mode"), "file_id") for mode, more in scopes.items()]
    return functools.reduce(DataFrame.union, found)


@query(
    with_views("tracks")
    + r"""
select file_id, 'fi ' || trim(regexp_replace(regexp_replace(lower(album), '[^a-z0-9_\s]+', ' ', 'g'), '\s+', ' ', 'g')) || case when album = '' then '' else ' ' end || 'کیک ' || file_id || ' ' || file_id || ' x ss' as folded from tracks""".replace("\\\\", "\\")
)
def script_keys(spark, sf_dir):
    """Ligatures, wide letters and sharp s; Arabic letter forms; Arabic-Indic and Persian digits; a joiner of no width."""
    rows, number = view(spark, sf_dir, "tracks"), F.col("file_id").cast("string")
    arabic, persian = (F.translate(number, "0123456789", d) for d in ("\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669", "\u06f0\u06f1\u06f2\u06f3\u06f4\u06f5\u06f6\u06f7\u06f8\u06f9"))
    text = F.concat(F.lit("\ufb01 "), F.col("album"), F.lit(" \u0643\u200c\u064a\u0643 "), arabic, F.lit(" "), persian, F.lit(" \uff38 \u00df"))
    return rows.select("file_id", T.normalize(text).alias("folded"))


@query(
    with_views("doc_files")
    + """, r as (select file_id, content, strlen(content) as n, [case file_id // 5 % 4 when 3 then 320 else 310 end, 62, 24, 44, 0][file_id % 5 + 1] as s from doc_files)
select file_id, case when n >= 4096 and s > 0 then cast(s as bigint) end as start, case when n >= 4096 and s > 0 then cast(s + n as bigint) end as "end", case when n >= 4096 and s > 0 then sha256(content) end as digest from r"""
)
def byte_regions(spark, sf_dir):
    """Documents between the tags of MPEG, FLAC, MP4 and WAV files; a fifth kind has no rule.

    MPEG files end with ID3v1, before it in turn nothing, APEv2 with a header, Lyrics3v2, or APEv2 without
    one after an ID3v2 tag that has a footer.
    """
    body = F.col("content").cast("binary")
    big = F.lpad(F.hex(F.octet_length(body)), 8, "0")
    plus8 = F.lpad(F.hex(F.octet_length(body) + 8), 8, "0")
    little = F.concat(*(F.substring(big, k, 2) for k in (7, 5, 3, 1)))
    raw = lambda text: F.lit(text.encode("latin-1"))
    ape = lambda flags: "\0" * 40 + "APETAGEX\xd0\7\0\0\x48\0\0\0\1\0\0\0" + flags + "\0" * 8
    tags = [("", ""), ("", "APETAGEX" + "\0" * 24 + ape("\0\0\0\x80")), ("", "LYRICSBEGIN" + "x" * 50 + "000061LYRICS200"), ("3DI" + "\0" * 7, ape("\0" * 4))]
    turn = F.floor(F.col("file_id") / 5) % 4
    mpeg = body
    for k, (foot, tail) in enumerate(tags):
        head = "ID3\4\0" + ("\x10" if foot else "\0") + "\0\0\2\x2c" + "\0" * 300 + foot
        mpeg = F.when(turn == k, F.concat(raw(head), body, raw(tail + "TAG" + " " * 125))).otherwise(mpeg)
    files = [
        (".mp3", mpeg),
        (".flac", F.concat(raw("fLaC\0\0\0\x22" + "\0" * 34 + "\x84\0\0\x10" + "\0" * 16), body)),
        (".m4a", F.concat(raw("\0\0\0\x10ftypM4A \0\0\0\0"), F.unhex(plus8), raw("mdat"), body, raw("\0\0\0\x08free"))),
        (".wav", F.concat(raw("RIFF\0\0\0\0WAVEfmt \x10\0\0\0" + "\0" * 16 + "data"), F.unhex(little), body, raw("\0"))),
    ]
    kind = F.col("file_id") % 5
    ext, content = F.lit(".txt"), body
    for k, (name, built) in enumerate(files):
        ext, content = F.when(kind == k, name).otherwise(ext), F.when(kind == k, built).otherwise(content)
    return regions.regions(view(spark, sf_dir, "doc_files").select("file_id", ext.alias("ext"), content.alias("content")))


@query(with_views("tracks") + f", {KEYS} select file_id, name_key as key, 'name' as method from keys where name_key is not null qualify count(*) over (partition by name_key) > 1")
def rule_toggles(spark, sf_dir):
    """All rules but one switched off."""
    off = dict.fromkeys(("use_exact", "use_audio", "use_tags", "use_feat", "use_title", "use_duration", "use_size"), False)
    found, _ = find_claims(dealt(tracks(spark, sf_dir)), ScanConfig(mode="all", min_size=0, **off))
    return found.select("file_id", "key", "method")


@query(
    with_views("tracks")
    + f""", {KEYS}, {CREDITS},
n as (select 'tag' as method, count(*) as files from (select 1 from keys where tag_key is not null qualify count(*) over (partition by tag_key) > 1)
  union all select 'feat', count(*) from credited
  union all select 'title', count(*) from (select 1 from keys where title_key is not null qualify count(*) over (partition by title_key) > 1)
  union all select 'name', count(*) from (select 1 from keys where name_key is not null qualify count(*) over (partition by name_key) > 1))
select off, method, files from n, (values ('use_tags'), ('use_feat'), ('use_title'), ('use_name')) o(off)
where files > 0 and not (off = 'use_tags' and method <> 'name') and not (off = 'use_feat' and method = 'feat') and not (off = 'use_name' and method = 'name')"""
)
def toggle_counts(spark, sf_dir):
    """Files that each rule by equal keys claims with one switched off. Without tags there are no credits and titles either; titles come with tags."""
    files, parts = tracks(spark, sf_dir), []
    keyed = keys_of(dealt(files), ScanConfig(mode="all", min_size=0))  # once for all four
    for off in ("use_tags", "use_feat", "use_title", "use_name"):
        found, _ = find_claims(files, ScanConfig(mode="all", min_size=0, use_duration=False, use_size=False, feat_bucket=FEAT_BUCKET, **{off: False}), keyed)
        parts.append(found.groupBy("method").agg(F.count("*").alias("files")).select(F.lit(off).alias("off"), "method", "files"))
    return functools.reduce(DataFrame.union, parts)


@query(TAG + " select gid, file_id, size from s where not marked")
def kept_files(spark, sf_dir):
    rows = select.survivors(marked_members(spark, sf_dir))
    return select.choose_columns(rows, ["gid", "file_id", "size"], rows.columns)


@query(TAG + " select file_id, path, 'trash' as how, file_id % 7 <> 0 as ok, size from s where not best")
def deletion_log(spark, sf_dir):
    """The log as it is read back."""
    rows = rank.suggested(tag_members(spark, sf_dir)).select(F.timestamp_seconds("mtime_s").alias("ts"), "file_id", "path", F.lit("trash").alias("how"), (F.col("file_id") % 7 != 0).alias("ok"), F.lit(None).cast("string").alias("error"), "size")
    rows = materialize(rows, "deletions")
    path = f"{shared_dir(spark)}/kinsift-log-{uuid.uuid4().hex}"
    report.log_deletions(rows, path, "first")
    report.log_deletions(rows, path, "first")  # a run that is repeated adds nothing
    return spark.read.parquet(path).select("file_id", "path", "how", "ok", "size")


@query("select cast(count_if(doc_id % 3 <> 0) as bigint) as before, cast(0 as bigint) as after from documents")
def signature_clear(spark, sf_dir):
    _, old = _versions(spark, sf_dir)
    before, after = signatures.info(old), signatures.info(signatures.clear(old))
    return before.select(F.col("rows").alias("before")).crossJoin(after.select(F.col("rows").alias("after")))  # one row each


@query(with_views("doc_files") + """ select file_id, sha256(encode(cast(n as varchar)) || encode(content)[1:65536] || case when n > 131072 then encode(content)[n - 65535:n] else encode('') end) as quick from (select *, strlen(content) as n from doc_files)""")
def quick_signatures(spark, sf_dir):
    return view(spark, sf_dir, "doc_files").select("file_id", detect.quick_signature(F.col("content")).alias("quick"))


# ---- folders and files --------------------------------------------------------------------------


def _written(spark, sf_dir) -> str:
    """A folder with a file for each document, every third name beginning with ``_`` or ``.``, every tenth in a hidden folder."""
    root = f"{shared_dir(spark).removeprefix('file:')}/kinsift-tree-{uuid.uuid4().hex}"

    def write(batches):
        for batch in batches:
            for i, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{root}/{lang}/{'.h' if i % 10 == 0 else f'd{i // 400}'}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{('', '_', '.')[i % 3]}{i}.txt", "wb") as f:
                    f.write(text.encode())
            yield batch

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    docs.mapInArrow(write, docs.schema).write.format("noop").mode("overwrite").save()
    return root


TREE = ScanConfig(mode="custom", extensions=(".txt",), min_size=0)


@query(
    """
select '/' || coalesce(lang, 'none') || '/d' || cast(doc_id // 400 as varchar) || '/' || case doc_id % 3 when 1 then '_' when 2 then '.' else '' end || cast(doc_id as varchar) || '.txt' as path,
  cast(strlen(coalesce(text, '')) as bigint) as size
from documents where doc_id % 10 <> 0"""
)
def folder_scan(spark, sf_dir):
    """The walk finds every name but those below hidden folders."""
    root = _written(spark, sf_dir)
    rows = catalog.collect(folders.scan_folders(spark, [root, f"{root}/en"], TREE), TREE, F.lit(root))
    return rows.select(F.substring("path", len(root) + 1, 1000).alias("path"), "size")


@query(
    """
select min(doc_id) as first_id, count(*) as files, cast(strlen(coalesce(text, '')) as bigint) as size
from documents where doc_id % 10 <> 0 and text <> '' group by text having count(*) > 1"""
)
def tree_digest_groups(spark, sf_dir):
    """Files of equal content, by digests of their chunks of 1,000 bytes."""
    root = _written(spark, sf_dir)
    files = folders.scan_folders(spark, [root], TREE).filter("size > 0")
    found = digests.tree_digests(files.select("path", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end")), chunk=1000)
    ids = found.select("digest", "end", F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint").alias("id"))
    return ids.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("files"), F.max("end").alias("size")).filter("files > 1").drop("digest")


@query(
    with_views("doc_files", "old_signatures")
    + """,
f as (select d.*, o.file_id is not null as hit from doc_files d left join old_signatures o on o.file_id = d.file_id and o.size = d.size and o.mtime_s = d.mtime_s),
g as (select count(*) as n, sum(size) - max(size) as r from f where size >= 500 group by size, content having count(*) > 1)
select cast(count_if(size >= 500) as bigint) as scanned, cast(count_if(size < 500) as bigint) as skipped, cast(count_if(size is null) as bigint) as unreadable,
  cast(count_if(size >= 500 and hit) as bigint) as cache_hits, cast((select coalesce(sum(n), 0) from g) as bigint) as dupes, cast((select coalesce(sum(r), 0) from g) as bigint) as reclaimable
from f"""
)
def scan_summary(spark, sf_dir):
    """All six figures of a scan; four are observed while its files are written."""
    files, old = _versions(spark, sf_dir)
    rows, told = catalog.observed(files, ScanConfig(mode="all", min_size=500), F.lit("/"), old)
    rows = materialize(rows, "files")
    found = detect.exact(rows).join(rows.select("file_id", "size"), "file_id")
    groups = found.groupBy("key").agg(F.count("*").alias("files"), (F.sum("size") - F.max("size")).alias("reclaimable"))
    return catalog.summary(told, groups)


@query(
    with_views("doc_files", "old_signatures")
    + """
select d.path, d.size, case when o.file_id is null or o.mtime_s <> d.mtime_s then sha256(content) else 'old ' || cast(d.file_id as varchar) end as "full",
  case when o.file_id is null or o.mtime_s <> d.mtime_s or o.seen_day < 19193 then 19200 else o.seen_day end as seen_day
from doc_files d left join old_signatures o using (file_id)"""
)
def signature_table(spark, sf_dir):
    """A scan through the bucketed table: misses are signed, hits not seen for a week are refreshed, all others stay as they are."""
    files, old = _versions(spark, sf_dir)
    name = f"kinsift_{uuid.uuid4().hex}"
    table = SignatureTable.create(spark, name, f"{shared_dir(spark)}/{name}", "path string, size bigint, mtime_ns bigint, full string, seen timestamp", 8)
    table.write(old, 0)
    found = table.lookup(files, 1)
    now = F.date_add(F.lit("1970-01-01").cast("date"), 19200).cast("timestamp")
    table.upsert(found, found.filter("not hit").withColumn("full", F.sha2("content", 256)), 1, now)
    return table.latest(2).select("path", "size", "full", F.datediff("seen", F.lit("1970-01-01").cast("date")).alias("seen_day"))
