"""Reports and logs of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.functions.dates import time_text
from kinsift.functions.fmt import REPORT, bitrate_text, duration_text, label, size_text
from kinsift.functions.text import display, folder_of, name_of, short_folder
from kinsift.operators.rank import in_order, reasons

#: Column names of report(), in the order of REPORT's headers.
COLUMNS = ["gid", "method", "confidence", "state", "name", "folder", "bytes", "size_text", "duration_text", "bitrate_text", "artist", "title", "album", "modified", "reason"]


def report(members: DataFrame, groups: DataFrame, lang: str = "fa", selection: DataFrame | None = None) -> DataFrame:
    """One row per file with the 15 columns of the report and the path.

    With a selection (path, marked) the state is keep or marked; without, keep or suggested. The
    reason stands in the row of the file that is kept.
    """
    kept = reasons(members, lang)
    rows = members.join(groups.select("gid", "primary_method", "confidence", "combined"), "gid").join(kept, ["gid", "path"], "left")
    best = F.col("reason").isNotNull()
    say = lambda x: label(F.lit(x), lang)
    if selection is None:
        state = F.when(best, say("csv.state.keep")).otherwise(say("csv.state.suggest"))
    else:
        rows = rows.join(selection.select("path", F.col("marked").alias("_marked")), "path", "left")
        state = F.when(F.col("_marked"), say("csv.state.drop")).otherwise(say("csv.state.keep"))
    method = label(F.concat(F.lit("method."), "primary_method"), lang)
    method = F.when(F.col("combined"), F.concat(method, F.lit(" ("), say("method.combined"), F.lit(")"))).otherwise(method)
    there = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "gid",
        method.alias("method"),
        F.concat(F.col("confidence").cast("string"), F.lit("%")).alias("confidence"),
        state.alias("state"),
        name_of(F.col("path")).alias("name"),
        folder_of(F.col("path")).alias("folder"),
        F.col("size").alias("bytes"),
        size_text(F.col("size"), "en").alias("size_text"),
        duration_text(F.col("duration"), "en").alias("duration_text"),
        F.when(F.coalesce(F.col("bitrate"), F.lit(0)) > 0, bitrate_text(F.col("bitrate"), "en")).otherwise("").alias("bitrate_text"),
        there("artist").alias("artist"),
        there("title").alias("title"),
        there("album").alias("album"),
        time_text(F.timestamp_seconds("mtime_s"), "en").alias("modified"),
        there("reason").alias("reason"),
        "path",
    )


def write_report(rows: DataFrame, path: str, lang: str = "fa", one_file: bool = False) -> None:
    """report() as CSV with a byte-order mark before the header, by group, size falling, and path.

    The header is the first line of the first range of rows; the parts, joined in order of their names, are
    the report. one_file has it written by one task, for small ones.
    """
    line = F.to_csv(F.struct(*(F.col(c).cast("string") for c in COLUMNS)), {"emptyValue": '""'})
    lines = rows.select("gid", F.col("bytes").cast("bigint").alias("bytes"), "path", line.alias("value"))
    none = F.lit(None)
    header = rows.sparkSession.range(1).select(none.cast(lines.schema["gid"].dataType).alias("gid"), none.cast("bigint").alias("bytes"), none.cast("string").alias("path"), F.lit("\ufeff" + ",".join(REPORT[lang])).alias("value"))
    order = F.col("gid").asc_nulls_first(), F.col("bytes").desc(), F.col("path")
    both = header.unionByName(lines)
    both = both.coalesce(1).sortWithinPartitions(*order) if one_file else both.repartitionByRange(*order).sortWithinPartitions(*order)
    both.select("value").write.mode("errorifexists").text(path)


def log_deletions(deletions: DataFrame, path: str, run: str) -> None:
    """Adds (ts, path, how, ok, error, size) under a folder per day and run; a run that is logged again replaces its own rows.

    Rows are dealt to ranges of days first, so that files are about as many as days and tasks, not one for each day in each task.
    """
    rows = deletions.withColumn("day", F.to_date("ts")).withColumn("run", F.lit(run)).repartitionByRange("day", "path")
    rows.write.partitionBy("day", "run").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def deletion_totals(deletions: DataFrame) -> DataFrame:
    return deletions.agg(F.count_if("ok").alias("deleted"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("size"))), F.lit(0)).cast("bigint").alias("freed"))


def view(members: DataFrame, groups: DataFrame, lang: str = "fa") -> DataFrame:
    """The result as people see it: formatted and raw columns of each file, its group's figures, the best flag."""
    rows = members.join(groups.select("gid", "primary_method", "confidence", "combined", "files", "total_size", "reclaimable"), "gid")
    return in_order(rows).withColumns(
        {
            "name": name_of(F.col("path")),
            "folder_text": short_folder(folder_of(F.col("path"))),
            "title_text": display(F.col("artist"), F.col("title")),
            "size_text": size_text(F.col("size"), lang),
            "duration_text": duration_text(F.col("duration"), lang),
            "bitrate_text": bitrate_text(F.col("bitrate"), lang),
            "modified_text": time_text(F.timestamp_seconds("mtime_s"), lang),
            "method_text": label(F.concat(F.lit("method."), "primary_method"), lang),
        }
    )
