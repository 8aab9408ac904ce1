"""Rules that find duplicates. Each gives claims: (stage, method, key, file_id) of files that share a key.

Files are rows of (file_id, path, size, category, ...); a rule keeps the keys that two files or more share.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.functions import text as T
from kinsift.operators.anchors import anchor_clusters
from kinsift.operators.credits import anchored
from kinsift.operators.skew import growing
from kinsift.plans.config import DURATION_LEAST, DURATION_SIZES, DURATION_WINDOW, METHODS, ScanConfig
from kinsift.sources.digests import CHUNK, tree_digests
from kinsift.sources.regions import read_survivors, regions
from kinsift.storage import materialize

STAGE = {m: k + 1 for k, (m, _, _) in enumerate(METHODS)}
CONFIDENCE = {m: c for m, c, _ in METHODS}


def buckets(files: DataFrame, key: Column, most: int | None = None) -> DataFrame:
    """files with their ``key``, for keys that at least two files (and at most ``most``) share; null is no key.

    Keys are counted before rows move (a count per key and task is what the shuffle carries), and the
    join back is one that adaptive execution can split, so a hot key stays harmless.
    """
    rows = files.withColumn("key", key).filter("key is not null")
    shared = rows.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1")
    if most is not None:
        shared = shared.filter(F.col("_n") <= most)
    return rows.join(shared.select("key"), "key")


def claims(rows: DataFrame, method: str) -> DataFrame:
    return rows.select(F.lit(STAGE[method]).alias("stage"), F.lit(method).alias("method"), F.col("key").cast("string").alias("key"), "file_id")


def exact(files: DataFrame, content: str = "content") -> DataFrame:
    """Equal size and digest, for a table that holds the content: it is digested where it is scanned and never moves."""
    rows = files.filter("size > 0").select("file_id", "size", F.sha2(F.col(content), 256).alias("_digest"))
    return claims(buckets(rows, F.concat_ws(":", F.col("size").cast("string"), "_digest")), "exact")


def exact_files(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Equal size, then equal quick signature, then equal digest, for files (file_id, path, size) on a mounted file system.

    Each step opens only files that still share everything with another; digests are trees over chunks, so
    that many tasks read a large file.
    """
    signed = materialize(read_survivors(files.filter("size > 0"), ["size"], "quick").filter("quick is not null"), "quick")
    left = buckets(signed, F.concat_ws(":", F.col("size").cast("string"), "quick")).drop("key")
    whole = tree_digests(left.select("path", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end")), chunk)
    digested = left.join(whole.select("path", F.col("end").alias("size"), "digest"), ["path", "size"])
    return claims(buckets(digested.filter("digest is not null"), F.concat_ws(":", F.col("size").cast("string"), "digest")), "exact")


def region_files(files: DataFrame, include_untagged: bool = False, chunk: int = CHUNK) -> DataFrame:
    """same_region() for files (file_id, path, ext, size) on a mounted file system: bounds first, digests of regions whose length another shares."""
    bounds = regions(files, content=None, digest=False).filter("start is not null").drop("digest")
    found = materialize(bounds.join(files.select("file_id", "path", "size"), "file_id"), "bounds")
    if not include_untagged:
        found = found.filter("not (start = 0 and end = size)")
    left = buckets(found, F.col("end") - F.col("start")).drop("key")
    return same_region(left.join(tree_digests(left, chunk), ["path", "start", "end"]), include_untagged)


def quick_signature(content: Column, window: int = 65536) -> Column:
    """Digest of the length and of the first and last ``window`` bytes; the tail only beyond twice the window."""
    data = content.cast("binary")
    size = F.octet_length(data)
    tail = F.when(size > 2 * window, F.substring(data, -window, window)).otherwise(F.lit(b""))
    return F.sha2(F.concat(size.cast("string").cast("binary"), F.substring(data, 1, window), tail), 256)


def same_region(files: DataFrame, include_untagged: bool = False) -> DataFrame:
    """Equal length, then equal digest, of the content without its tags: columns start, end and digest.

    Files whose content is all region have none, as they carry no tags; ``include_untagged`` takes them in.
    """
    rows = files.filter(F.col("digest").isNotNull())
    if not include_untagged:
        rows = rows.filter(~((F.col("start") == 0) & (F.col("end") == F.col("size"))))
    rows = buckets(rows, F.col("end") - F.col("start")).drop("key")
    return claims(buckets(rows, F.concat_ws(":", (F.col("end") - F.col("start")).cast("string"), "digest")), "audio")


def with_keys(files: DataFrame, unicode: bool = True) -> DataFrame:
    """files with tag_key, title_key (where there is no tag key), core_key, artist_set and name_key."""
    audio = F.col("category") == "audio"
    artist, title = F.nullif(F.col("artist"), F.lit("")), F.nullif(F.col("title"), F.lit(""))
    rows = files.withColumns({"tag_key": F.when(audio, T.tag_key(artist, title, unicode)), "artist_set": T.artists(artist, unicode)})
    rows = rows.withColumn("title_key", F.when(audio & F.col("tag_key").isNull(), T.title_key(title, unicode)))
    rows = rows.withColumn("core_key", F.when(audio & (F.size("artist_set") > 0), T.core_title_key(title, unicode)))
    return rows.withColumn("name_key", F.concat(F.col("category"), F.lit("|"), T.key(T.name_key(F.col("name"), unicode), 3)))


def same_tags(files: DataFrame) -> DataFrame:
    return claims(buckets(files, F.col("tag_key")), "tag")


def same_title(files: DataFrame) -> DataFrame:
    return claims(buckets(files, F.col("title_key")), "title")


def same_name(files: DataFrame) -> DataFrame:
    return claims(buckets(files, F.col("name_key")), "name")


def same_song(files: DataFrame, most: int | None = None) -> DataFrame:
    """Equal titles without guest credits and compatible artists and durations.

    Of one title, the first file by path takes every later compatible one, then the next free file, and so on. Artists are
    compatible when one set holds the other, durations when one is unknown or they differ by at most FEAT_SECONDS. Titles that
    more than ``most`` files share, if that is given, are left out.
    """
    rows = buckets(files, F.col("core_key"), most).select("key", "path", F.col("file_id").cast("bigint").alias("file_id"), "artist_set", F.col("duration").cast("double").alias("duration"))
    found = materialize(anchored(rows), "anchored")
    taken = found.groupBy("key", "anchor").agg(F.count("*").alias("_n")).filter("_n > 1").select("key", "anchor")
    shared = found.join(growing(taken), ["key", "anchor"])
    return claims(shared.withColumn("key", F.concat_ws("|", "key", F.col("anchor").cast("string"))), "feat")


def close_duration(files: DataFrame) -> DataFrame:
    """Unclaimed audio of 20 s or more: anchored windows of durations, and in each, anchored ratios of sizes."""
    rows = files.filter((F.col("category") == "audio") & (F.col("duration") >= DURATION_LEAST))
    rows = anchor_clusters(rows, "duration", "_second", window=DURATION_WINDOW)
    rows = anchor_clusters(rows, "size", "_bytes", ratio=DURATION_SIZES, key="_second")
    return claims(buckets(rows, F.concat_ws("|", F.col("_second").cast("string"), F.col("_bytes").cast("string"))), "duration")


def close_size(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Unclaimed files: anchored ratios of sizes over all categories, split by category after."""
    rows = files.filter(F.col("size") >= config.min_size)
    rows = anchor_clusters(rows, "size", "_bytes", ratio=config.size_tolerance / 100)
    return claims(buckets(rows, F.concat_ws("|", F.col("_bytes").cast("string"), "category")), "size")


def unclaimed(files: DataFrame, claimed: DataFrame) -> DataFrame:
    return files.join(growing(claimed.select("file_id").distinct()), "file_id", "left_anti")


def equal_key_stages(files: DataFrame, keyed: DataFrame, config: ScanConfig) -> Iterator[tuple[str, DataFrame]]:
    """The rules by equal keys that the options turn on and the columns allow, strongest first. keyed: files with_keys()."""
    if config.use_exact and "content" in files.columns:
        yield "exact", exact(files)
    if config.use_audio and "digest" in files.columns:
        yield "audio", same_region(files, config.include_untagged)
    if config.use_tags:
        yield "tag", same_tags(keyed)
        if config.use_feat:
            yield "feat", same_song(keyed, config.feat_bucket)
        yield "title", same_title(keyed)
    if config.use_name:
        yield "name", same_name(keyed)
