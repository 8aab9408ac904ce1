"""Regions, folders, signatures, reports and the incremental re-scan."""

import datetime as dt
import os
import struct

import pandas as pd
from pyspark.sql import functions as F

from kinsift.functions.fmt import REPORT
from kinsift.operators import detect
from kinsift.plans.config import ScanConfig
from kinsift.sources import catalog, digests, folders, regions, report, signatures
from kinsift.sources.signature_table import SignatureTable
from kinsift.streaming.incremental import rescan

BODY = bytes(range(256)) * 20
ID3 = b"ID3\x04\x00\x00" + bytes([0, 0, 1, 2]) + bytes(130)
ID3V1 = b"TAG" + bytes(125)
APE = bytes(40) + b"APETAGEX" + struct.pack("<III", 2000, 72, 0) + bytes(12)
LYRICS = b"LYRICSBEGIN" + b"000011" + b"LYRICS200"
FLAC = b"fLaC" + b"\x00\x00\x00\x22" + bytes(34) + b"\x84\x00\x00\x05" + bytes(5)
MP4 = struct.pack(">I4s", 24, b"ftyp") + bytes(16) + struct.pack(">I4s", 8 + len(BODY), b"mdat")
WAV = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(BODY))

CASES = [
    (".mp3", ID3 + BODY + APE[:72] + ID3V1, (140, 140 + len(BODY) + 0)),
    (".mp3", BODY, (0, len(BODY))),
    (".aac", BODY + LYRICS, (0, len(BODY))),
    (".flac", FLAC + BODY, (len(FLAC), len(FLAC) + len(BODY))),
    (".m4a", MP4 + BODY + b"\0\0\0\x08moov", (len(MP4), len(MP4) + len(BODY))),
    (".wav", WAV + BODY + b"tail", (len(WAV), len(WAV) + len(BODY))),
    (".flac", FLAC[:20], None),
    (".wav", b"RIFF", None),
    (".mp4", b"\0\0\0\x01mdat", None),
    (".mp3", b"", None),
    (".mp3", b"short", None),
    (".ogg", BODY, None),
]


def test_regions_of_bytes(spark):
    df = spark.createDataFrame(pd.DataFrame([(k, e, c) for k, (e, c, _) in enumerate(CASES)], columns=["file_id", "ext", "content"]))
    got = {r.file_id: r for r in regions.regions(df).collect()}
    for k, (_, content, want) in enumerate(CASES):
        if want is None:
            assert got[k].start is None, k
        elif k != 0:
            assert (got[k].start, got[k].end) == want, k
    # tags before and behind: only the body is left, whatever stands around it
    ape = struct.pack("<8sIIII8x", b"APETAGEX", 2000, 32, 0, 0)
    tagged = regions.region_of(ID3 + BODY + ape + ID3V1, ".mp3")
    assert tagged == regions.region_of(ID3 + BODY + ape + ID3V1, ".mp3") and tagged[:2] == (140, 140 + len(BODY))


def test_regions_by_path_and_missing_files(spark, tmp_path):
    (tmp_path / "a.mp3").write_bytes(ID3 + BODY)
    df = spark.createDataFrame([(1, ".mp3", f"{tmp_path}/a.mp3"), (2, ".mp3", f"{tmp_path}/gone.mp3")], "file_id long, ext string, path string")
    got = {r.file_id: r.end for r in regions.regions(df, None).collect()}
    assert got == {1: 140 + len(BODY), 2: None}


def test_region_files_by_tree_digests(spark, tmp_path):
    """Copies under other tags meet; a file that is all region takes part only if asked; one of equal length does not."""
    other = BODY[:-1] + bytes([BODY[-1] ^ 1])
    contents = [ID3 + BODY, ID3 + BODY + ID3V1, BODY, ID3 + other, b"RIFF"]
    for k, data in enumerate(contents):
        (tmp_path / f"{k}.mp3").write_bytes(data)
    files = spark.createDataFrame([(k, f"{tmp_path}/{k}.mp3", ".mp3", len(d)) for k, d in enumerate(contents)] + [(9, f"{tmp_path}/none.mp3", ".mp3", 9000)], "file_id long, path string, ext string, size long")
    for chunk in (999, 1 << 26):
        assert sorted(r.file_id for r in detect.region_files(files, chunk=chunk).collect()) == [0, 1]
        assert sorted(r.file_id for r in detect.region_files(files, True, chunk).collect()) == [0, 1, 2]


def test_survivors_alone_are_read(spark, tmp_path):
    for name, content in (("a", b"xx"), ("b", b"xy"), ("c", b"zzz")):
        (tmp_path / name).write_bytes(content)
    df = spark.createDataFrame([(k, f"{tmp_path}/{n}", s) for k, (n, s) in enumerate((("a", 2), ("b", 2), ("c", 3), ("d", 9)))], "file_id long, path string, size long")
    assert sorted(r.file_id for r in regions.read_survivors(df, ["size"]).collect()) == [0, 1]
    big = bytes(range(256)) * 1200
    for name, content in (("e", big), ("f", big), ("g", big[:150_000] + b"!" + big[150_001:]), ("h", big[:-1] + b"!")):
        (tmp_path / name).write_bytes(content)
    more = spark.createDataFrame([(k, f"{tmp_path}/{n}", len(big)) for k, n in enumerate("efghx")], "file_id long, path string, size long")
    quick = {r.file_id: r.quick for r in regions.read_survivors(more, ["size"], "quick").collect()}
    assert quick[0] == quick[1] == quick[2] != quick[3] and quick[4] is None
    for chunk in (1000, 1 << 26):
        assert sorted(r.file_id for r in detect.exact_files(more, chunk).collect()) == [0, 1]
    held = spark.createDataFrame([(big,)], "content binary").select(detect.quick_signature(F.col("content"))).first()[0]
    assert held == quick[0]


def test_scan_folders(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "windows")
    os.makedirs(tmp_path / "in" / "deep")
    for name, n in (("in/a.MP3", 10), ("in/deep/b.mp3", 20), ("in/windows/c.mp3", 30), ("in/d.txt", 40), ("in/deep/e.mp3", 1)):
        (tmp_path / name).write_bytes(bytes(n))
    root = f"{tmp_path}/in"
    found = folders.scan_folders(spark, [root, f"{root}/deep"])
    names = lambda c: sorted(r.name for r in catalog.collect(found, c, F.col("root")).collect())
    assert names(ScanConfig(min_size=5)) == ["a.MP3", "b.mp3"]
    assert "a.MP3" in names(ScanConfig(min_size=0, recursive=False))
    assert names(ScanConfig(min_size=0, mode="custom", extensions=(".txt",))) == ["d.txt"]


def test_hidden_files_and_attributes(spark):
    rows = [("/r/a.mp3", 9, 0), ("/r/.h/b.mp3", 9, 0), ("/r/c.mp3", 9, 2), ("/r/d.mp3", 9, None), ("/r/_x.mp3", 9, 0)]
    df = spark.createDataFrame(rows, "path string, size long, attrs int")
    got = lambda **c: sorted(r.name for r in catalog.collect(df, ScanConfig(min_size=0, **c), F.lit("/r")).collect())
    assert got() == ["_x.mp3", "a.mp3", "d.mp3"]
    assert len(got(skip_hidden=False)) == 5


def test_changed_rows_are_replaced_whole(spark):
    old = spark.createDataFrame([("a", 1, 1, "old", "q"), ("b", 1, 1, "keep", "q")], "path string, size long, mtime_ns long, full string, quick string")
    files = spark.createDataFrame([("a", 2, 2), ("b", 1, 1), ("c", 3, 3)], "path string, size long, mtime_ns long")
    assert {r.path: r.state for r in signatures.states(files, old).collect()} == {"a": "changed", "b": "hit", "c": "new"}
    fresh = signatures.lookup(files, old.select(signatures.VERSION)).filter("not hit").select("path", "size", "mtime_ns", F.lit("new").alias("full"), F.lit(None).cast("string").alias("quick"))
    assert sorted(map(tuple, signatures.upsert(old, fresh).select("path", "full", "quick").collect())) == [("a", "new", None), ("b", "keep", "q"), ("c", "new", None)]
    assert [r.path for r in signatures.vanished(old, files.filter("path <> 'b'")).collect()] == ["b"]
    assert signatures.clear(old).count() == 0 and signatures.info(old).first()["rows"] == 2


TABLE = "path string, size bigint, mtime_ns bigint, full string, seen timestamp"


def day(n):
    return F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(days=n))


def sign(missed):
    return missed.select("path", "size", "mtime_ns", F.concat("path", F.col("mtime_ns").cast("string")).alias("full"))


def test_rescan_as_a_stream(spark, tmp_path):
    schema = "path string, size long, mtime_ns long"
    table = SignatureTable.create(spark, "streamed", f"{tmp_path}/s", TABLE, 4)
    table.write(spark.createDataFrame([], TABLE), 0)
    signed = []

    def counted(missed):
        signed.append(missed.count())
        return sign(missed)

    for turn, rows in enumerate(([("a", 1, 1), ("b", 1, 1)], [("a", 1, 1), ("b", 2, 2), ("c", 1, 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rescan(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), table, counted, f"{tmp_path}/c", day(20 * turn)).awaitTermination()
    assert signed == [2, 2]
    assert sorted((r.full, r.seen.day) for r in table.latest(3).collect()) == [("a1", 21), ("b2", 21), ("c1", 21)]
    # what no scan meets any more is dropped, the hit that was met again is not
    assert table.prune(3, day(100)).count() == 3 and table.prune(2, day(100)).count() == 0
    spark.sql("drop table streamed")


def test_signature_table(spark, tmp_path):
    """Lookups shuffle files only; a generation is as large as the change, and writing it again changes nothing."""
    table = SignatureTable.create(spark, "signed", f"{tmp_path}/t", TABLE, 4)
    files = spark.range(1000).select(F.concat(F.lit("/f"), "id").alias("path"), F.col("id").alias("size"), F.lit(1).cast("long").alias("mtime_ns"))
    found = table.lookup(files, 0)
    table.upsert(found, sign(found.filter("not hit")), 0, day(0))
    assert table.rows_of(0) == 1000
    changed = files.withColumn("mtime_ns", F.when(F.col("size") < 5, 2).otherwise(1).cast("long"))
    for _ in range(2):
        found = table.lookup(changed, 1)
        table.upsert(found, sign(found.filter("not hit")), 1, day(3))
        assert table.rows_of(1) == 5
    assert {r.full for r in table.latest(2).filter("size < 7").collect()} == {"/f02", "/f12", "/f22", "/f32", "/f42", "/f51", "/f61"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = table.lookup(changed, 2)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    # a week later the hits are refreshed, and what was met stays when the rest is pruned
    met = table.lookup(changed.filter("size < 100"), 2)
    table.upsert(met, sign(met.filter("not hit")), 2, day(60))
    assert table.rows_of(2) == 100 and table.prune(3, day(120)).count() == 100
    table.compact(3, table.prune(3, day(120)))
    assert table.rows_of(0) == table.rows_of(1) == 0 and table.latest(4).count() == 100
    # another session finds the generations where they lie
    spark.sql("drop table signed")
    again = SignatureTable.create(spark, "signed_again", f"{tmp_path}/t", TABLE, 4)
    assert again.latest(4).count() == 100
    spark.sql("drop table signed_again")


def test_names_of_all_kinds_are_found(spark, tmp_path):
    for name in ("_a.mp3", ".b.mp3", "deep/er/_c.mp3", ".hidden/d.mp3", "$RECYCLE.BIN/e.mp3", "deep/er/still/f.mp3"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "deep" / "loop").symlink_to(tmp_path)
    (tmp_path / "gone.mp3").symlink_to(tmp_path / "nothing")
    names = lambda *a, **k: sorted(os.path.basename(r.path) for r in folders.scan_folders(spark, [str(tmp_path), f"{tmp_path}/none"], *a, **k).collect())
    every = [".b.mp3", "_a.mp3", "_c.mp3", "d.mp3", "e.mp3", "f.mp3", "gone.mp3"]
    for levels in (0, 1, 2, 5):
        assert names(levels=levels) == every
    assert names(ScanConfig()) == [".b.mp3", "_a.mp3", "_c.mp3", "f.mp3", "gone.mp3"]
    assert names(ScanConfig(recursive=False)) == [".b.mp3", "_a.mp3", "gone.mp3"]
    rows = folders.scan_folders(spark, [str(tmp_path)])
    assert rows.filter("size is null").count() == 1 and rows.filter("attrs = 0 and mtime_ns > 0").count() == 6
    told = catalog.statistics(rows, ScanConfig(min_size=2), F.lit(str(tmp_path))).first()
    assert tuple(told) == (0, 4, 1)
    assert folders.Walker({"roots": str(tmp_path), "levels": "2"}).partitions()[0] == folders.Part(str(tmp_path), str(tmp_path), False)


def test_tree_digests(spark, tmp_path):
    """Equal under trees exactly when equal under one SHA-256; a large file is hashed by several tasks."""
    contents = {"a": b"x" * 1000, "b": b"x" * 1000, "c": b"x" * 999 + b"y", "d": b"x" * 1001, "e": b"", "f": b"", "g": b"x" * 500}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(f"{tmp_path}/{n}", 0, len(d)) for n, d in contents.items()] + [(f"{tmp_path}/none", 0, 5), (f"{tmp_path}/g", 0, 501), (f"{tmp_path}/a", None, None)], "path string, start long, end long")
    for chunk in (1, 100, 333, 5000):
        got = {(os.path.basename(r.path), r.end): r.digest for r in digests.tree_digests(files.union(files), chunk).collect()}
        assert len(got) == 10 and got["none", 5] is got["g", 501] is got["a", None] is None
        own = {n: got[n, len(d)] for n, d in contents.items()}
        assert all((own[m] == own[n]) == (contents[m] == contents[n]) for m in contents for n in contents)
    part = digests.tree_digests(spark.createDataFrame([(f"{tmp_path}/a", 100, 600), (f"{tmp_path}/c", 300, 800), (f"{tmp_path}/c", 500, 1000)], "path string, start long, end long"), 64).collect()
    assert len({r.digest for r in part}) == 2
    parts = digests.chunks(files.limit(1), 10).repartition(8, "path", "number").select(F.spark_partition_id()).distinct().count()
    assert parts > 1


def test_report_file_and_log(spark, tmp_path):
    rows = [(1, 1, "/m/a, b.mp3", 10, 100, "A", 'say "x"', None, 61.0, 320000, 3, True), (1, 2, "/m/c (1).mp3", 9, 200, None, None, None, None, None, 0, False)]
    members = spark.createDataFrame(rows, "gid long, file_id long, path string, size long, mtime_s long, artist string, title string, album string, duration double, bitrate long, tag_fields int, has_cover boolean")
    groups = spark.createDataFrame([(1, "exact", 100, False, 2, 19, 9)], "gid long, primary_method string, confidence int, combined boolean, files long, total_size long, reclaimable long")
    out = report.report(members, groups, "en")
    by = {r.path: r for r in out.collect()}
    assert by["/m/a, b.mp3"].state == "keep" and by["/m/a, b.mp3"].reason.startswith("higher bitrate (320 kbps), larger")
    assert by["/m/c (1).mp3"].state == "suggested for deletion" and by["/m/c (1).mp3"].reason == ""
    marked = spark.createDataFrame([("/m/a, b.mp3", True)], "path string, marked boolean")
    assert {r.path: r.state for r in report.report(members, groups, "en", marked).collect()} == {"/m/a, b.mp3": "marked for deletion", "/m/c (1).mp3": "keep"}
    report.write_report(out, f"{tmp_path}/r", "en", one_file=True)
    part = next(p for p in os.listdir(tmp_path / "r") if p.endswith(".txt"))
    text = (tmp_path / "r" / part).read_bytes()
    assert text.startswith(b"\xef\xbb\xbf" + REPORT["en"][0].encode()) and text.count(b"\n") == 3
    assert report.view(members, groups, "en").count() == 2
    gone = spark.createDataFrame([(dt.datetime(2024, 5, 6), "/m/c (1).mp3", "trash", True, None, 9), (dt.datetime(2024, 5, 6), "/m/x", "trash", False, "locked", 5)], "ts timestamp, path string, how string, ok boolean, error string, size long")
    for run in ("one", "one", "two"):
        report.log_deletions(gone, f"{tmp_path}/log", run)
    assert spark.read.parquet(f"{tmp_path}/log").filter("day = '2024-05-06'").count() == 4
    assert tuple(report.deletion_totals(gone).first()) == (1, 1, 9)
