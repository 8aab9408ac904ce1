"""Exact dedup, mixing, sharding, SimHash and substring dedup against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinsift.llm import exact, mixing, near, sharding, simhash, substring
from kinsift.llm.queries import QUERIES, SQL
from tests.llm.conftest import SMALL
from tests.oracle import assert_same

SPACE = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, SMALL, QUERIES[name], SQL[name])


# ---- exact dedup --------------------------------------------------------------------------------


def plain_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((r[0], keep[r[1] or ""], len(groups[r[1] or ""]), r[0] == keep[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)


@pytest.mark.parametrize("digest", [exact.sha256, F.length, lambda t: F.lit("one")])
def test_exact_report_even_with_colliding_digests(odd, odd_rows, digest):
    got = exact.report(odd, digest=lambda t: digest(t).cast("string")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(map(tuple, got)) == plain_exact(odd_rows)


def test_exact_deduplicate_keeps_one_of_each_text(odd, odd_rows, empty):
    got = exact.deduplicate(odd)
    assert got.columns == odd.columns
    assert sorted(r.text or "" for r in got.collect()) == sorted({r[1] or "" for r in odd_rows})
    assert exact.report(empty).count() == exact.deduplicate(empty).count() == 0


CLASHES = ["_id", "_text", "_digest", "_salt", "_again", "_copies", "_copy", "_part", "_piece", "_turn", "_at", "_shard", "_drop", "_own", "kept", "keep_id", "in_0", "count"]


@pytest.mark.parametrize("stage", [exact.deduplicate, exact.report, mixing.repeat, near.deduplicate, lambda d: sharding.shuffle(d, shards=3, rows=4)], ids=["exact", "report", "repeat", "near", "shuffle"])
def test_columns_named_like_inner_ones_pass_through(spark, stage):
    rows = [(k, f"text number {k % 7} of some", "s", *[f"{c}{k}" for c in CLASHES]) for k in range(20)] + [(3, "another text", "s", *["again"] * len(CLASHES))]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"{c} string" for c in CLASHES]]))
    got = stage(docs)
    lost = {"kept", "keep_id"} if stage is exact.report else set()  # replaced by results
    names = [c for c in docs.columns if c not in lost]
    assert [c for c in got.columns if c in names] == names
    known = {tuple(r[c] for c in names) for r in docs.collect()}
    assert got.count() and {tuple(r[c] for c in names) for r in got.collect()} <= known


def test_shuffle_splits_rows_of_one_id(spark):
    """A third of the rows without an id are spread over the classes like all others."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    a, b = (sorted(map(str, sharding.shuffle(docs.repartition(n), shards=7, rows=50).collect())) for n in (3, 5))
    assert a == b
    nameless = Counter(r.shard for r in sharding.shuffle(docs, shards=7, rows=50).collect() if r.doc_id is None)
    assert len(nameless) == 7 and max(nameless.values()) < 2 * min(nameless.values())


def test_shuffle_query_equals_its_law(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = sharding.op4_shuffle_shards(spark, SMALL).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in docs.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)} and len(rows) == len(docs)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


# ---- mixing -------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, left, out = 1.5 * sum(sizes.values()), set(names), {}
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in left}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return out


def test_mix(spark, odd, odd_rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "text").unionByName(odd.select(F.col("doc_id") + 10_000, "source", "text").toDF("doc_id", "source", "text"))
    rows = docs.collect()
    sizes, mixed = Counter(), mixing.mix(docs).collect()
    for r in rows:
        sizes[r.source] += len(SPACE.findall(r.text or ""))
    aim = plain_targets(dict(sizes))
    of = {(r.doc_id, len(SPACE.findall(r.text or ""))): r.source for r in rows}
    assert len(mixed) == len(rows)
    taken, largest = Counter(), Counter()
    for r in mixed:
        s = of[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(aim[s]) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - aim[s]) <= largest[s]
    assert sorted(map(str, mixed)) == sorted(map(str, mixing.mix(docs.repartition(9)).collect()))


def test_mix_by_document_weight_and_repeat(spark, empty):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("three words here").alias("text"), (F.col("id") % 2 * 3).alias("w"))
    got = mixing.mix(docs, share=0.2, doc_weight="w").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()
    by = {r.odd: r.n for r in got}
    assert by[0] == 0 and abs(by[1] - 1800) <= 3
    out = mixing.repeat(docs.select("doc_id", "source", "text"))
    assert abs(out.count() * 3 - 13500) <= 3 and out.columns == ["doc_id", "source", "text"]
    assert mixing.mix(empty).count() == mixing.repeat(empty).count() == 0


@pytest.mark.parametrize("ids", ["null", "five"])
def test_mix_of_tied_ids_equals_sql(spark, tmp_path, ids):
    """Rows without an id, or sharing five, are drawn each on its own and every source meets its target."""
    rows = spark.range(3000).select(F.when(F.lit(ids == "five"), F.col("id") % 5).alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.concat(F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")), F.col("id") % 1500).alias("text"))
    rows.unionByName(rows.filter("text like '%7'")).write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(spark, str(tmp_path), QUERIES["op2_source_mix"], SQL["op2_source_mix"])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    met = mixing.mix(docs).groupBy("source_size").agg(F.sum("taken").alias("n"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert len(met) == 3 and all(abs(r.n - r.target) <= r.most for r in met)


def test_repeat_tells_texts_of_one_id_apart(spark):
    docs = spark.createDataFrame([(1, "s", "one two three")] * 2 + [(1, "s", None), (1, "s", ""), (None, "s", "four five")], "doc_id long, source string, text string")
    out = mixing.repeat(docs, share=2.0)
    assert Counter(map(tuple, out.collect())) == {(1, "s", "one two three"): 4, (None, "s", "four five"): 2}


# ---- sharding -----------------------------------------------------------------------------------


def test_shuffle_through_a_matrix_of_two_levels(spark, monkeypatch):
    """More hash classes than the driver draws: same law, and the same places however rows are partitioned."""
    monkeypatch.setattr(sharding, "MOST_PARTITIONS", 3)
    ids = spark.range(2000).toDF("doc_id")
    a, b = (sorted(map(tuple, sharding.shuffle(ids.repartition(n), shards=7, rows=60).collect())) for n in (2, 5))
    assert a == b and sorted(r[0] for r in a) == list(range(2000))
    for s in range(7):
        slots = sorted(r[2] for r in a if r[1] == s)
        assert slots == list(range(len(slots))) and len(slots) in (285, 286)
    # rows of one shard come from all over the ids
    assert all(400 < np.std([r[0] for r in a if r[1] == s]) < 750 for s in range(7))


def test_dealt_below_keeps_the_columns():
    import pandas as pd

    got = sharding.dealt_below(pd.DataFrame({"_part": [9, 3, 6], "count": [5, 7, 0], "_above": [0, 0, 0], "_line": [[4, 0, 8]] * 3}), 1)
    lines = [np.diff([0, *ends]).tolist() for ends in got["_ends"]]
    assert got["_row"].tolist() == [3, 6, 9] and np.sum(lines, 0).tolist() == [4, 0, 8] and [sum(x) for x in lines] == [7, 0, 5]


def test_shuffle_of_maps_at_any_depth(spark):
    docs = spark.createDataFrame([(None if k % 2 else 1, [{"a": k}], (k, {"b": [k]})) for k in range(60)], "doc_id long, maps array<map<string, int>>, pair struct<n: int, m: map<string, array<int>>>")
    rows = sharding.shuffle(docs, shards=3, rows=4).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(3) for k in range(20)] and len({r.pair.n for r in rows}) == 60


def test_shards_are_even_gapless_and_repeatable(spark, odd, empty):
    got = sharding.shuffle(odd, shards=4, rows=5)
    rows = got.select("doc_id", "text", "shard", "slot").collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(4)) and max(sizes.values()) - min(sizes.values()) <= 1 and len(rows) == odd.count()
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    ids = spark.range(1000).toDF("doc_id")
    a, b = (sorted(map(tuple, sharding.shuffle(ids.repartition(n), rows=50).collect())) for n in (3, 8))
    assert a == b
    assert sharding.shuffle(empty).count() == 0


def test_shuffle_query_deals_whole_documents(spark, monkeypatch):
    """The digests are those of the dealt rows: a text that gets lost on the way shows."""
    docs, seen, real = spark.read.parquet(f"{SMALL}/documents.parquet"), [], sharding.shuffle

    def damaged(rows, *args, **more):
        seen.append(rows.columns)
        return real(rows, *args, **more).withColumn("text", F.when(F.col("doc_id") != 3, F.col("text")))

    want = {r.doc_id: (len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in sharding.op4_shuffle_shards(spark, SMALL).collect()} == want
    monkeypatch.setattr(sharding, "shuffle", damaged)
    got = {r.doc_id: (r["size"], r.text_crc32) for r in sharding.op4_shuffle_shards(spark, SMALL).collect()}
    assert seen == [docs.columns] and got == want | {3: (16, 0)}


def test_matrix_has_its_sums_and_the_right_spread():
    m = np.array(sharding.matrix([10, 0, 7, 23], [20, 20], 1))
    assert m.sum(1).tolist() == [10, 0, 7, 23] and m.sum(0).tolist() == [20, 20]
    first = [sharding.matrix([100, 100], [100, 100], s)[0][0] for s in range(400)]
    assert abs(np.mean(first) - 50) < 1 and 3 < np.std(first) < 4.2
    big = [sharding.hypergeometric(np.random.default_rng(s), 3_000_000_000, 5_000_000_000, 80_000_000) for s in range(200)]
    assert abs(np.mean(big) - 30_000_000) < 1500 and 3000 < np.std(big) < 5500


# ---- SimHash ------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {x: min((i for (i, _), y in zip(rows, label, strict=True) if y == x and i is not None), default=None) for x in label}
    return Counter((i, f"{f:016x}", least[x]) for (i, _), f, x in zip(rows, fps, label, strict=True))


def test_near_groups_equal_all_pairs(spark, odd, odd_rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1][:3000]) for r in docs.collect()]
    rows += [(1000 + i, t + " tail") for i, t in rows[:60]] + [(None if r[0] is None else 5000 + r[0], r[1]) for r in odd_rows]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == plain_near(rows)


def signed(fps):
    return [(f - (1 << 64) if f >> 63 else f,) for f in fps]


def groups_of(spark, fps, **more):
    from kinsift.operators.components import connected_components

    found = defaultdict(set)
    for r in connected_components(simhash.links(spark.createDataFrame(signed(fps), "fp long"), **more), "a", "b").collect():
        found[r.component].add(r.node)
    return sorted(map(sorted, found.values()))


def plain_groups(fps, distance):
    left, out = set(fps), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            f = todo.pop()
            group.add(f)
            near = {g for g in left if (f ^ g).bit_count() <= distance}
            left -= near
            todo += near
        if len(group) > 1:
            out.append(sorted(f[0] for f in signed(group)))
    return sorted(out)


@pytest.mark.parametrize("distance, segments, crowd", [(2, 2, 64), (2, 2, 3), (2, 3, 64), (1, 2, 64), (1, 1, 64), (0, 1, 64), (2, 4, 5)])
def test_links_equal_all_pairs(spark, distance, segments, crowd):
    rng = np.random.default_rng(distance + segments)
    fps = {int(x) for x in rng.integers(0, 1 << 64, 150, np.uint64)}
    for f in list(fps):  # neighbours at one to four bits, some in one segment alone
        for flips in (1, 2, 3, 4):
            for bits in (range(64), range(32)):
                fps.add(f ^ sum(1 << int(b) for b in rng.choice(list(bits), flips, False)))
    base = 0x0123456789ABCDEF  # a crowd that shares a segment, most of it far apart
    fps |= {base ^ (int(x) << 32) for x in rng.integers(0, 1 << 32, 120)} | {base ^ (1 << k) for k in range(64)} | {0, (1 << 64) - 1}
    assert groups_of(spark, fps, distance=distance, segments=segments, crowd=crowd) == plain_groups(fps, distance)


def test_radii_follow_from_the_pigeonhole_rule():
    assert simhash.radii(2, 2) == [1, 0] and simhash.radii(2, 3) == [0, 0, 0] and simhash.radii(3, 2) == [1, 1] and simhash.radii(1, 2) == [0, 0] and simhash.radii(1, 4) == [0, 0, -1, -1]


def test_verification_rejects_what_shares_a_segment(spark, monkeypatch):
    fps, seen, real = [5, 5 ^ (0b111 << 40), 5 ^ (0b11 << 40)], [], F.bit_count
    monkeypatch.setattr(simhash.F, "bit_count", lambda c: seen.append(c) or real(c) - 64)
    assert simhash.links(spark.createDataFrame(signed(fps), "fp long")).count() == 3 and seen
    monkeypatch.setattr(simhash.F, "bit_count", real)
    assert simhash.links(spark.createDataFrame(signed(fps), "fp long")).count() == 2


def test_a_distance_beyond_the_balls_is_refused(spark):
    with pytest.raises(ValueError, match="distance 2"):
        simhash.links(spark.createDataFrame(signed([1]), "fp long"), distance=3)


def test_near_groups_of_nothing(empty):
    assert simhash.near_groups(empty).count() == 0


# ---- substring dedup ----------------------------------------------------------------------------


def plain_substring(rows, window=13):
    big = 1 << 63
    words = [SPACE.findall(t or "") for _, t in rows]
    order = [big if i is None else i for i, _ in rows]
    first = {}
    for o, w in zip(order, words, strict=True):
        for k in range(len(w) - window + 1):
            p = tuple(w[k : k + window])
            first[p] = min(first.get(p, big + 1), o)
    out = Counter()
    for (i, _), o, w in zip(rows, order, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < o:
                gone.update(range(k, k + window))
        out[i, len(w), len(w) - len(gone), " ".join(x for k, x in enumerate(w) if k not in gone).encode()] += 1
    return out


@pytest.mark.parametrize("repeat_ids", [True, False])
def test_substring_equals_plain(spark, odd_rows, repeat_ids):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1][:2000]) for r in docs.collect()]
    passage = " ".join(f"w{k}" for k in range(60))
    rows += [(2000 + k, f"{'lead ' * k}{passage} {k} tail" if k % 2 else f"x{k} " + " ".join(passage.split()[k : k + 20])) for k in range(12)]
    rows += [(r[0], r[1]) for r in odd_rows] if repeat_ids else []
    got = substring.parse(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_kept, bytes(r.kept)) for r in got) == plain_substring(rows)
    for r in got:
        assert bool(r.factors) == (r.n_kept < r.n_words) and all(f.words >= 13 for f in r.factors)


def thue_morse(letters):
    a, b = "a", "b"
    while len(a) < letters:
        a, b = a + b, b + a
    return a, b


def same_digests(spark, rows):
    got = substring.parse(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_kept, bytes(r.kept)) for r in got) == plain_substring(rows)


def test_words_that_polynomial_hashes_mix_up_stay(spark):
    lead = " ".join(f"w{k}" for k in range(12))
    same_digests(spark, [row for k, n in enumerate((64, 1024, 2048, 4096)) for row in zip((2 * k, 2 * k + 1), (f"n{n} {lead} {w}" for w in thue_morse(n)), strict=True)])


def test_phrases_whose_word_hashes_collide_are_told_apart_by_their_words(spark, monkeypatch):
    """Words of four hashes: only the digests decide."""
    real = substring.Phrases.hashes
    monkeypatch.setattr(substring.Phrases, "hashes", lambda self, text: real(self, text) % np.uint64(4))
    text = " ".join(f"w{k}" for k in range(40))
    p = substring.Phrases()
    assert len(np.unique(p.anchors(p.hashes(text.encode())))) < 20
    words = text.split()
    assert len(np.unique(p.digests([w.encode() for w in words], np.arange(28)))) == 28


@pytest.mark.parametrize("rows_of_hot", [20, 100_000])
def test_passages_that_most_documents_share(spark, monkeypatch, rows_of_hot):
    monkeypatch.setattr(substring, "HOT_ROWS", rows_of_hot)
    passage = " ".join(f"p{k}" for k in range(30))
    same_digests(spark, [(k, f"a{k} b{k} {passage if k % 3 else passage[:80]} c{k}") for k in range(600, 0, -1)])


def test_the_largest_id_is_kept(spark):
    top, text = (1 << 63) - 1, " ".join(f"w{k}" for k in range(20))
    assert {r.doc_id for r in substring.parse(spark.createDataFrame([(top, text), (3, text + " x")], "doc_id long, text string")).collect()} == {top, 3}


def test_substring_of_nothing(empty):
    assert substring.parse(empty).count() == 0


def test_word_hashes_tell_words_apart_and_ignore_place():
    p = substring.Phrases()
    h = p.hashes("ab ba ab\tabc \n b".encode())
    assert len(h) == 5 and h[0] == h[2] and len(set(h.tolist())) == 4
    long = b"x" * 70
    assert len(set(p.hashes(b" ".join([long, long + b"x", long[:64], long[:63], long[:65], b"x\0", b"x"])).tolist())) == 7
    assert p.hashes(b"").size == 0 and p.hashes(b" x ")[0] == p.hashes(b"yyy x")[1]
