"""Work and files that grow no faster than the input."""

import os

from pyspark.sql import functions as F

from kinsift.operators import detect
from kinsift.plans.queries import QUERIES
from kinsift.sources import report

SMALL = "/root/testdata/sf0.001"


def counted(monkeypatch):
    """The partitions of each table that keys are computed for."""
    calls, with_keys = [], detect.with_keys
    monkeypatch.setattr(detect, "with_keys", lambda files, *more: calls.append(files.rdd.getNumPartitions()) or with_keys(files, *more))
    return calls


def test_toggles_compute_keys_once_and_over_all_cores(spark, monkeypatch):
    calls = counted(monkeypatch)
    QUERIES["toggle_counts"](spark, SMALL)
    assert calls == [spark.sparkContext.defaultParallelism]


def test_rules_that_are_off_need_no_keys_and_one_split_is_dealt_out(spark, monkeypatch):
    calls, held = counted(monkeypatch), []
    same_name = detect.same_name
    monkeypatch.setattr(detect, "same_name", lambda files: held.append(files.columns) or same_name(files))
    QUERIES["rule_toggles"](spark, SMALL)
    assert calls == [spark.sparkContext.defaultParallelism]
    assert "name_key" in held[0] and not {"tag_key", "title_key", "core_key", "artist_set"} & {*held[0]}


def test_log_has_few_files_for_many_days(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select(F.timestamp_seconds(F.col("id") % 100 * 86400).alias("ts"), F.col("id").cast("string").alias("path"), F.lit("trash").alias("how"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("size"))
    report.log_deletions(rows, str(tmp_path / "log"), "first")
    files = [f for _, _, names in os.walk(tmp_path / "log") for f in names if f.endswith(".parquet")]
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4000
    assert len(files) <= 100 + 8


def test_joins_of_a_row_per_file_are_not_broadcast(spark, capsys):
    files, claimed = spark.range(1000).withColumnRenamed("id", "file_id"), spark.range(10).withColumnRenamed("id", "file_id")
    left = detect.unclaimed(files, claimed)
    left.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    assert left.count() == 990
