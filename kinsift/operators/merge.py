"""Claims of several rules merged into groups, with methods and confidence.

Stage by stage, strongest first, the files that share a key are joined with the groups they are in
already. A stage is credited to a group that it made larger: one that joins several labels of the
stage before. Rules by closeness never join what a stronger rule found; their clusters are new groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsift.operators.components import connected_components
from kinsift.operators.detect import CONFIDENCE, STAGE
from kinsift.operators.skew import growing
from kinsift.storage import materialize


def merge(claims: DataFrame, methods: list[str]) -> tuple[DataFrame, DataFrame]:
    """(members, credits) of claims (stage, method, key, file_id): members(group, file_id, match_method),
    credits(group, stage). A group is named by its smallest file_id. methods: those that may occur, in order."""
    claims = materialize(claims, "claims")
    labels = materialize(claims.select("file_id", F.col("file_id").alias("label")).distinct(), "labels")
    credits = None
    for method in methods:
        own = claims.filter(F.col("method") == method).join(growing(labels), "file_id").select("key", "label").distinct()
        least = own.groupBy("key").agg(F.min("label").alias("to"), F.max("label").alias("top")).filter("to < top").select("key", "to")
        edges = materialize(own.join(least, "key").filter("label > to").select("label", "to").distinct(), "joins")
        if edges.isEmpty():
            continue
        found = connected_components(edges, "label", "to")
        found = materialize(found, "found")
        move = lambda df, c: df.join(growing(found.withColumnRenamed("node", c)), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")  # noqa: E731, B023
        labels = materialize(move(labels, "label").select("file_id", "label"), "labels")
        new = found.select(F.col("component").alias("group"), F.lit(STAGE[method]).alias("stage")).distinct()
        credits = materialize((new if credits is None else move(credits, "group").select("group", "stage").union(new)).distinct(), "credits")
    first = claims.groupBy("file_id").agg(F.min_by("method", "stage").alias("match_method"))
    members = labels.withColumnRenamed("label", "group").join(growing(first), "file_id").select("group", "file_id", "match_method")
    if credits is None:
        credits = members.select("group", F.lit(0).alias("stage")).limit(0)
    return members, credits


def summarize(members: DataFrame, credits: DataFrame, files: DataFrame) -> DataFrame:
    """One row per group: methods (strongest first), primary and weakest method, confidence (the weakest's),
    combined, files, total_size, reclaimable (all but the largest file), first_path."""
    names = F.create_map(*(F.lit(x) for m, s in STAGE.items() for x in (s, m)))
    sure = F.create_map(*(F.lit(x) for m, s in STAGE.items() for x in (s, CONFIDENCE[m])))
    credit = credits.groupBy("group").agg(F.array_sort(F.collect_set("stage")).alias("_stages"))
    sizes = members.join(growing(files.select("file_id", "size", "path")), "file_id").groupBy("group").agg(F.count("*").alias("files"), F.sum("size").alias("total_size"), (F.sum("size") - F.max("size")).alias("reclaimable"), F.min("path").alias("first_path"))
    out = sizes.join(growing(credit), "group")
    return out.select(
        "group",
        F.transform("_stages", lambda s: names[s]).alias("methods"),
        names[F.array_min("_stages")].alias("primary_method"),
        names[F.array_max("_stages")].alias("weakest_method"),
        sure[F.array_max("_stages")].alias("confidence"),
        (F.size("_stages") > 1).alias("combined"),
        "files",
        "total_size",
        "reclaimable",
        "first_path",
    )


def numbered(rows: DataFrame, order: list, name: str, pieces: str = "_piece") -> DataFrame:
    """rows with ``name``: their place in an order, from 1, without sorting all rows in one task.

    Rows are dealt to ranges of the order, numbered in each, and moved on by the size of the ranges before.
    """
    dealt = materialize(rows.repartitionByRange(*order).withColumn(pieces, F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(pieces).agg(F.count("*").alias("_n"))
    before = sizes.select(F.col(pieces).alias("_p"), (F.sum("_n").over(Window.orderBy(pieces)) - F.col("_n")).alias("_before"))  # a row per range
    at = F.row_number().over(Window.partitionBy(pieces).orderBy(*order))
    return dealt.withColumn("_at", at).join(F.broadcast(before), F.col(pieces) == F.col("_p")).withColumn(name, (F.col("_before") + F.col("_at")).cast("bigint")).drop("_at", "_p", "_before", "_n", pieces)


#: Rows from which a group is numbered in ranges.
LARGE = 1_000_000


def placed(rows: DataFrame, order: list, name: str, group: str = "gid", large: int = LARGE) -> DataFrame:
    """rows with ``name`` (int): their place in an order within each group, from 1.

    Groups of ``large`` rows and more are dealt to ranges of group and order; a row's place is that in its range
    after the rows that its group has in the ranges before. So no task holds a large group, and results do not depend on the number.
    """
    hot = materialize(rows.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") >= large).select(F.col(group).alias("_hot")), "large")
    plain = lambda df, *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    if hot.isEmpty():
        return rows.withColumn(name, plain(rows, group))
    few = rows.join(F.broadcast(hot), F.col(group) == F.col("_hot"), "left_anti")  # at most a large-th of all rows
    many = rows.join(F.broadcast(hot), F.col(group) == F.col("_hot"), "left_semi")
    dealt = materialize(many.repartitionByRange(group, *order).withColumn("_piece", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(F.col(group).alias("_group"), F.col("_piece").alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_group").orderBy("_range")) - F.col("_n"))  # a row per group and range
    at = dealt.withColumn("_at", plain(dealt, group, "_piece")).join(before, (F.col(group) == F.col("_group")) & (F.col("_piece") == F.col("_range")))
    return few.withColumn(name, plain(few, group)).unionByName(at.withColumn(name, (F.col("_before") + F.col("_at")).cast("int")).select(*rows.columns, name))


def number_groups(groups: DataFrame) -> DataFrame:
    """groups with gid from 1: by confidence, then reclaimable bytes, both falling, then the smallest path."""
    return numbered(groups, [F.col("confidence").desc(), F.col("reclaimable").desc(), F.col("first_path").asc()], "gid")


def regroup(members: DataFrame, deleted: DataFrame) -> DataFrame:
    """members(gid, path, ...) after deletions(path, ok): files that are gone leave, groups of one dissolve, gids close up."""
    gone = deleted.filter("ok").select("path").distinct()
    left = members.join(gone, "path", "left_anti")
    alive = materialize(left.groupBy("gid").agg(F.count("*").alias("_n")).filter("_n > 1").select("gid"), "alive")
    new = numbered(alive, [F.col("gid").asc()], "new_gid")
    return left.join(new, "gid").withColumn("gid", F.col("new_gid")).drop("new_gid").select(members.columns)
