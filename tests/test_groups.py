"""Rules, anchors, components and groups against plain sequential versions."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinsift.operators import anchors, credits, detect, merge, rank, select
from kinsift.operators.components import connected_components
from kinsift.plans.config import METHODS, ScanConfig
from kinsift.plans.resolve import resolve
from kinsift.sources import catalog


def plain_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)] + [(300, k) for k in range(301, 340)] + [(None, 3), (5, 5)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == plain_components(edges)


def test_no_components(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_anchors(values, limit):
    out, anchor = {}, None
    for v in sorted(set(values)):
        if anchor is None or v > limit(anchor):
            anchor = v
        out[v] = anchor
    return out


@pytest.mark.parametrize(("kind", "seed"), [("window", 1), ("ratio", 2), ("window", 3)])
def test_anchors(spark, kind, seed):
    rng = random.Random(seed)
    rows = [(k % 3, round(rng.uniform(1, 60), 1)) for k in range(400)] + [(None, 3.0), (1, None)]
    how = {"window": 1.5} if kind == "window" else {"ratio": 0.1}
    limit = anchors.limit_of(how.get("window"), how.get("ratio"))
    df = spark.createDataFrame(rows, "g int, v double").repartition(7)
    got = {(r.g, r.v): r.a for r in anchors.anchor_clusters(df, "v", "a", key="g", **how).collect()}
    for g in range(3):
        want = plain_anchors([v for k, v in rows if k == g and v is not None], limit)
        assert {v: a for (k, v), a in got.items() if k == g and v is not None} == want
    assert got[None, 3.0] is None and got[1, None] is None
    assert {r.v: r.a for r in anchors.anchor_clusters(df.filter("v is not null"), "v", "a", **how).collect()} == plain_anchors([v for _, v in rows if v is not None], limit)


@pytest.fixture
def ranges(spark):
    """A session with many small ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize(("values", "how"), [
    ([round(x * 0.37 % 977, 2) for x in range(60_000)], {"window": 1.5}),
    ([x * 0.25 for x in range(4000)], {"window": 900.0}),  # one window covers many ranges
    ([float(x) for x in range(1, 3000)], {"ratio": 0.02}),
])
def test_anchors_through_a_tree_of_ranges(ranges, monkeypatch, values, how):
    """Blocks compose over several levels, and none has more runs than a range or one window has values."""
    monkeypatch.setattr(anchors, "FAN", 3)
    seen, real = [], anchors.materialize
    monkeypatch.setattr(anchors, "materialize", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    rows = ranges.createDataFrame(pd.DataFrame({"v": values}))
    got = {r.v: r.a for r in anchors.anchor_clusters(rows, "v", "a", **how).distinct().collect()}
    assert got == plain_anchors(values, anchors.limit_of(how.get("window"), how.get("ratio")))
    largest = dict(seen)["chains"].groupBy("part").count().agg(F.max("count")).first()[0]
    blocks = [df for name, df in seen if name == "blocks"]
    assert len(blocks) >= 3 and blocks[0].count() >= 30
    window = max(sum(v <= w <= how["window"] + v for w in values) for v in values[:1]) if "window" in how else 0
    assert all(b.agg(F.max(F.size("runs"))).first()[0] <= max(largest, window) for b in blocks)


def test_anchored_not_chained(spark):
    df = spark.createDataFrame([(20.0,), (21.0,), (22.0,), (23.0,)], "v double")
    assert sorted(r.a for r in anchors.anchor_clusters(df, "v", "a", window=1.5).collect()) == [20.0, 20.0, 22.0, 22.0]


def replay(claims, methods):
    """Buckets applied one after the other, as a person would merge groups."""
    owner, groups, credit, first, numbers = {}, {}, {}, {}, itertools.count()
    for method in methods:
        for key in sorted({k for m, k, _ in claims if m == method}):
            files = sorted({f for m, k, f in claims if m == method and k == key})
            touched = sorted({owner[f] for f in files if f in owner})
            new = [f for f in files if f not in owner]
            if not touched:
                g = next(numbers)
                groups[g], credit[g] = set(files), {method}
            else:
                g, *others = touched
                if new or others:
                    credit[g].add(method)
                for o in others:
                    groups[g] |= groups.pop(o)
                    credit[g] |= credit.pop(o)
                groups[g] |= set(new)
            for f in groups[g]:
                owner[f] = g
            for f in files:
                first.setdefault(f, method)
    return {min(m): (frozenset(m), frozenset(credit[g])) for g, m in groups.items()}, first


@pytest.mark.parametrize("seed", range(2))
def test_merge_equals_replay(spark, seed):
    rng, methods = random.Random(seed), ["exact", "tag", "title", "name"]
    claims = []
    for method in methods:
        for key in range(8):
            for f in rng.sample(range(60), rng.randrange(2, 4)):
                claims.append((method, str(key), f))
    want, first = replay(claims, methods)
    df = spark.createDataFrame([(detect.STAGE[m], m, k, f) for m, k, f in claims], "stage int, method string, key string, file_id long")
    members, credits = merge.merge(df, methods)
    names = {s: m for m, s in detect.STAGE.items()}
    got, credited = {}, {}
    for r in members.collect():
        got.setdefault(r.group, set()).add(r.file_id)
        assert first[r.file_id] == r.match_method
    for r in credits.collect():
        credited.setdefault(r.group, set()).add(names[r.stage])
    assert {g: (frozenset(m), frozenset(credited[g])) for g, m in got.items()} == want


def files(spark, rows):
    names = ["file_id", "path", "size", "mtime_s", "artist", "title", "album", "duration", "bitrate", "content"]
    full = [{"file_id": k, "path": f"/m/f{k}.mp3", "size": 100_000 + 7000 * k * k, "mtime_s": 1000 + k, "artist": "", "title": "", "album": "", "duration": 0.0, "bitrate": 128_000, "content": f"c{k}"} | r for k, r in enumerate(rows)]
    df = spark.createDataFrame(pd.DataFrame(full)[names])
    return catalog.with_parts(df).withColumn("tag_fields", catalog.tag_fields(F.col("artist"), F.col("title"), F.col("album"))).withColumn("has_cover", F.lit(False))


CONFIG = ScanConfig(mode="all", min_size=0, use_name=False, use_duration=False, use_size=False)


def groups_of(spark, rows, config=CONFIG):
    found = resolve(files(spark, rows), config)
    info = {r.gid: r for r in found.groups.collect()}
    out = {}
    for r in found.members.collect():
        out.setdefault(r.gid, set()).add(r.file_id)
    return {frozenset(m): info[g] for g, m in out.items()}


def test_guest_credits(spark):
    got = groups_of(
        spark,
        [
            {"title": "Ta Yeja (feat. Daniyal & Mahyar)", "artist": "Shayea & Daniyal & Mahyar"},
            {"title": "Ta Yeja (Ft. Daniyal & Mahyar)", "artist": "Shayea"},
            {"title": "Other (feat. Anna)", "artist": "Main & Anna"},
            {"title": "Other (feat. Berta)", "artist": "Main & Berta"},
            {"title": "Edit", "artist": "Solo", "duration": 180.0},
            {"title": "Edit ft. Guest", "artist": "Solo & Guest", "duration": 240.0},
        ],
    )
    assert list(got) == [frozenset({0, 1})] and got[frozenset({0, 1})].confidence == 90


def test_weakest_link_and_reconfirmation(spark):
    same = {"content": "x", "size": 500_000, "artist": "AA", "title": "Song"}
    got = groups_of(spark, [same, same, same, {"artist": "aa", "title": "SONG"}])
    only = got[frozenset({0, 1, 2, 3})]
    assert (only.confidence, only.combined, list(only.methods)) == (92, True, ["exact", "tag"])
    got = groups_of(spark, [same, same])
    assert (got[frozenset({0, 1})].confidence, got[frozenset({0, 1})].combined) == (100, False)


def test_closeness_never_extends(spark):
    config = ScanConfig(mode="all", min_size=0, use_name=False, use_tags=False, use_duration=False, unicode=False)
    got = groups_of(spark, [{"content": "x", "size": 500_000}, {"content": "x", "size": 500_000}, {"size": 501_000}, {"size": 900_000}, {"size": 901_000}], config)
    assert set(got) == {frozenset({0, 1}), frozenset({3, 4})}


def test_two_short_songs_stay_apart(spark):
    config = ScanConfig(mode="all", min_size=0, use_name=False, use_tags=False, use_size=False, unicode=False)
    assert groups_of(spark, [{"duration": 30.0, "size": 400_000}, {"duration": 30.5, "size": 900_000}], config) == {}


def test_full_tie_keeps_the_largest_path(spark):
    rows = files(spark, [{"size": 5, "mtime_s": 1}] * 3).withColumn("gid", F.lit(1))
    assert [r.path for r in rank.ranked(rows).filter("best").collect()] == ["/m/f2.mp3"]


def test_guard_keeps_a_survivor(spark):
    rows = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", False), (2, "d", False)], "gid long, path string, marked boolean")
    asked = spark.createDataFrame([("b", 1), ("c", 2), ("d", 3)], "path string, turn int")
    got = {r.path: (r.marked, r.refused) for r in select.guarded(rows, asked).collect()}
    assert got == {"a": (True, False), "b": (False, True), "c": (True, False), "d": (False, True)}


def test_whole_groups_need_the_flag(spark):
    rows = spark.createDataFrame([(1, "a", False)], "gid long, path string, marked boolean")
    with pytest.raises(ValueError, match="allow_empty"):
        select.whole_groups(rows, rows)
    assert select.whole_groups(rows, rows, allow_empty=True).first().marked


def test_config_checks_itself():
    with pytest.raises(ValueError, match="rule"):
        ScanConfig(use_exact=False, use_audio=False, use_tags=False, use_name=False, use_duration=False, use_size=False)
    with pytest.raises(ValueError, match="mode"):
        ScanConfig(mode="x")
    assert [m for m, _, _ in METHODS][0] == "exact"


def test_large_groups_are_numbered_in_ranges(ranges):
    """One group of nearly all rows: its places are those of one sort, and no range holds it."""
    rows = ranges.range(20_000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(100).alias("gid"), (F.hash("id") % 500).alias("size"), F.col("id").cast("string").alias("path"))
    order = [F.col("size").desc(), F.col("path").asc()]
    one, many = (sorted(map(tuple, merge.placed(rows, order, "place", large=n).collect())) for n in (10**9, 1000))
    assert one == many
    assert merge.placed(rows, order, "place", large=1000).filter("gid = 100").select(F.max("place")).first()[0] == 19_600
    pieces = rows.repartitionByRange("gid", *order).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert pieces < 4000


def plain_credits(files):
    """The rule as a loop over sets."""
    free, out = list(files), []
    while free:
        anchor, *rest = free
        fits = [f for f in rest if (f[1] <= anchor[1] or anchor[1] <= f[1]) and (not f[2] or not anchor[2] or abs(f[2] - anchor[2]) <= 2.5)]
        out += [(anchor[0], f[0]) for f in [anchor, *fits] if fits]
        free = [f for f in rest if f not in fits]
    return out


def test_guest_credits_equal_a_loop_over_sets(spark):
    rng = random.Random(8)
    rows = [(k, f"t{rng.randrange(60)}", f"/p{rng.randrange(10**6):06}", sorted(rng.sample("abcdef", rng.randrange(1, 4))), rng.choice([None, 0.0, 100.0, 102.0, 104.0, 200.0])) for k in range(900)]
    got = {(r.key, r.file_id) for r in detect.same_song(spark.createDataFrame(rows, "file_id long, core_key string, path string, artist_set array<string>, duration double").repartition(5)).collect()}
    want = set()
    for title in {r[1] for r in rows}:
        files = [(r[0], frozenset(r[3]), r[4]) for r in sorted(rows, key=lambda r: r[2]) if r[1] == title]
        want |= {(f"{title}|{a}", i) for a, i in plain_credits(files)} if 2 <= len(files) <= 60 else set()
    assert got == want and want


def credit_rows(kind, rng):
    """Titles of 30 to 1,500 files: (file_id, core_key, path, artist_set, duration)."""
    rows = []
    for title, n in (("small", 30), ("middle", 150), ("large", 1500)):
        for k in range(n):
            who, seconds = sorted(rng.sample("abcdefgh", rng.randrange(1, 4))), rng.choice([None, 0.0, float("nan"), float("inf"), -3.0, *(rng.randrange(4000) / 10 for _ in range(60))])
            if kind == "linked":  # one artist with many guests, and some files of that artist alone
                who, seconds = ["a"] if k % 5 == 0 else ["a", f"g{rng.randrange(300)}"], rng.randrange(6000) / 10
            elif kind == "one by one":  # by path, each file is just within or beyond the reach of the one before
                who, seconds = ["a"], k * 1.3
            elif kind == "apart":
                who = [f"x{rng.randrange(n // 3)}"]
            elif kind == "alike":
                who, seconds = ["a"], 200.0 + k % 2
            rows.append((len(rows), title, f"/p{k if kind == 'one by one' else rng.randrange(10**6):06}/{k}", who, seconds))
    return rows


@pytest.mark.parametrize(("kind", "unit"), [("mixed", 50_000), ("mixed", 200), ("linked", 200), ("one by one", 200), ("apart", 200), ("alike", 200)])
def test_guest_credits_of_titles_of_any_size(spark, monkeypatch, kind, unit):
    """Titles of more than 60 files are no exception; more than ``unit`` files of one title are decided by several tasks."""
    monkeypatch.setattr(credits, "UNIT", unit)
    seen, real = [], credits._in_order
    monkeypatch.setattr(credits, "_in_order", lambda rows, group, known=None: seen.append((rows, group)) or real(rows, group, known))
    rows = credit_rows(kind, random.Random(9))
    got = {(r.key, r.file_id) for r in detect.same_song(spark.createDataFrame(rows, "file_id long, core_key string, path string, artist_set array<string>, duration double").repartition(5)).collect()}
    want = set()
    for title in {r[1] for r in rows}:
        files = [(r[0], frozenset(r[3]), r[4]) for r in sorted(rows, key=lambda r: r[2]) if r[1] == title]
        want |= {(f"{title}|{a}", i) for a, i in plain_credits(files)}
    assert got == want and any(key.startswith("large") for key, _ in got)
    if unit == 200:
        largest = max(rows.groupBy(*group).count().agg(F.max("count")).first()[0] or 0 for rows, group in seen if "piece" not in group)
        assert largest < 2 * unit


def test_the_scan_leaves_out_no_title(spark):
    """All files of 70 with one title, two of them with a guest: one group by credits."""
    rows = [{"title": "Intro (feat. Guest)" if k < 2 else "Intro", "artist": "Solo & Guest" if k < 2 else "Solo"} for k in range(70)]
    got = groups_of(spark, rows, ScanConfig(mode="all", min_size=0, use_exact=False, use_audio=False, use_name=False, use_duration=False, use_size=False))
    assert set(got) == {frozenset(range(70))} and "feat" in got[frozenset(range(70))].methods
