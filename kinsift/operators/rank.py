"""Which copy of a group to keep, and why.

Rows are members with a column ``gid`` and those of the catalogue. Groups are ranked by a window per
group, large ones by ranges of it; the best copy alone takes an aggregate (best_rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.functions.fmt import label
from kinsift.functions.text import folder_of, looks_like_copy, name_of, stem_of
from kinsift.operators.merge import placed
from kinsift.plans.config import PASSING_FOLDERS


def keep_score() -> dict[str, Column]:
    """The nine keys in order of weight; larger is better."""
    backslashed = F.translate("path", "/", "\\")
    folder = F.lower(folder_of(backslashed))
    passing = F.lit(False)
    for part in PASSING_FOLDERS:
        passing = passing | F.contains(folder, F.lit(part))
    known = lambda c, zero: F.coalesce(F.col(c), F.lit(zero))
    return {
        "not_copy": (~looks_like_copy(stem_of(name_of(F.col("path"))))).cast("int"),
        "settled": (~passing).cast("int"),
        "k_bitrate": known("bitrate", 0).cast("bigint"),
        "k_tags": known("tag_fields", 0).cast("int"),
        "k_cover": known("has_cover", False).cast("int"),
        "k_size": F.col("size").cast("bigint"),
        "k_duration": F.bround(known("duration", 0.0).cast("double"), 1),
        "shallow": -F.length(F.regexp_replace(backslashed, r"[^\\]", "")),
        "old": -F.col("mtime_s").cast("double"),
    }


def with_score(members: DataFrame) -> DataFrame:
    """members with ``score``, a struct that sorts as the nine keys and, for full ties, the path do."""
    return members.withColumn("score", F.struct(*(c.alias(n) for n, c in keep_score().items()), F.col("path").alias("last")))


def best_rows(members: DataFrame) -> DataFrame:
    """(gid, best_path): the path of each group's best file; a maximum per group, combined before the shuffle."""
    return with_score(members).groupBy("gid").agg(F.max("score").alias("s")).select("gid", F.col("s.last").alias("best_path"))


def ranked(members: DataFrame) -> DataFrame:
    """members with rank (1 is the copy to keep) and best."""
    rows = placed(with_score(members), [F.col("score").desc()], "rank")
    return rows.withColumn("best", F.col("rank") == 1).drop("score")


def suggested(members: DataFrame) -> DataFrame:
    """All but the best of each group."""
    return members.join(best_rows(members), "gid").filter("path <> best_path").drop("best_path")


def reasons(members: DataFrame, lang: str = "fa") -> DataFrame:
    """(gid, path, reason): why each group's best file is kept, against the largest (or oldest) of the others."""
    rows = members.join(best_rows(members), "gid").withColumn("_best", F.col("path") == F.col("best_path"))
    rows = rows.withColumn("_copy", looks_like_copy(stem_of(name_of(F.col("path")))))
    mine = lambda c: F.max(F.when(F.col("_best"), c))
    other = lambda f, c: f(F.when(~F.col("_best"), c))
    bitrate, tags, cover = (F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("bitrate", "tag_fields", "has_cover"))
    seen = rows.groupBy("gid").agg(
        F.max(F.when(F.col("_best"), F.col("path"))).alias("path"),
        F.count("*").alias("n"),
        mine(bitrate).alias("b"),
        other(F.max, bitrate).alias("ob"),
        mine(F.col("size")).alias("s"),
        other(F.max, F.col("size")).alias("os"),
        mine(tags).alias("t"),
        other(F.max, tags).alias("ot"),
        mine(cover).alias("c"),
        other(F.max, cover).alias("oc"),
        mine(F.col("_copy").cast("int")).alias("k"),
        other(F.max, F.col("_copy").cast("int")).alias("ok"),
        mine(F.col("mtime_s")).alias("m"),
        other(F.min, F.col("mtime_s")).alias("om"),
    )
    say = lambda name, n=None: label(F.lit(name), lang, n)
    given = F.array(
        F.when((F.col("b") > 0) & (F.col("b") > F.col("ob")), say("why.bitrate", F.floor(F.col("b") / 1000))),
        F.when(F.col("s") > F.col("os"), say("why.size")),
        F.when(F.col("t") > F.col("ot"), say("why.tags")),
        F.when((F.col("c") == 1) & (F.col("oc") == 0), say("why.cover")),
        F.when((F.col("k") == 0) & (F.col("ok") == 1), say("why.notcopy")),
        F.when(F.col("m") < F.col("om"), say("why.older")),
    )
    text = F.array_join(F.array_compact(given), "، " if lang == "fa" else ", ")
    return seen.select("gid", "path", F.when(F.col("n") == 1, say("why.only")).when(text == "", say("why.default")).otherwise(text).alias("reason"))


#: Columns that members can be sorted by, and whether they are numbers.
SORTABLE = {"name": False, "folder": False, "size": True, "duration": True, "bitrate": True, "artist": False, "title": False, "album": False, "mtime_s": True, "match_method": False}


def in_order(members: DataFrame) -> DataFrame:
    """members with place: by size, falling, then path, within the group."""
    return placed(members, [F.col("size").desc(), F.col("path").asc()], "place")


def sorted_members(members: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Members in order of group and of a column, numbers by value and the rest as text; what is missing counts as 0 or ''."""
    if column not in SORTABLE:
        raise ValueError(f"members cannot be sorted by {column}")
    by = F.coalesce(F.col(column), F.lit(0)) if SORTABLE[column] else F.lower(F.coalesce(F.col(column), F.lit("")))
    return members.orderBy("gid", by.asc() if ascending else by.desc(), "path")
