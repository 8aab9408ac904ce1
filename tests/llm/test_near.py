"""Near dedup against planted copies and all pairs."""

import random

import numpy as np

import corpus_pipeline
from kinsift.llm import near


def plain_jaccard(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def planted(rng, changes):
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    copy = list(words)
    for at in rng.sample(range(len(words)), changes):
        copy[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words), " ".join(copy)


def test_near_dedup_finds_planted_copies_and_nothing_less_near(spark):
    rng, rows, near_ids, far_ids = random.Random(7), [], set(), set()
    for k in range(300):
        a, b = planted(rng, k % 9 + 1)
        rows += [(2 * k, a), (2 * k + 1, b)]
        (near_ids if plain_jaccard(a, b) >= 0.8 else far_ids).add(2 * k + 1)
    assert len(near_ids) > 100 and len(far_ids) > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, "").collect()}
    assert left == {i for i, _ in rows} - near_ids


def test_large_buckets_compare_all_that_stay(spark, monkeypatch):
    """Large families that share all keys: rounds go on until each has one row left."""
    monkeypatch.setattr(near, "ALL_PAIRS", 2)
    monkeypatch.setattr(near, "LAST_PAIRS", 2)
    monkeypatch.setattr(near, "BANDS", 5)
    monkeypatch.setattr(near, "band_keys", lambda grams: list(range(5)) if len(grams) else [])
    monkeypatch.setattr(near, "by_fingerprint", lambda nodes: nodes.sparkSession.createDataFrame([], "a struct<rank:long,node:long>, b struct<rank:long,node:long>"))
    rng, rows = random.Random(1), []
    for family in range(5):
        words = [f"f{family}w{k}" for k in range(100)]
        rows += [(5 * k + family, " ".join([*words, f"tail{rng.randrange(10**9)}"])) for k in range(20)]
    left = near.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in left) == [0, 1, 2, 3, 4]


def test_keys_meet_as_often_as_stated():
    rng, met = np.random.default_rng(3), 0
    for _ in range(1000):
        all_of = rng.integers(0, 1 << 63, 200).astype("<u8")  # 180 of 200 in each, 160 in both: 0.8
        a, b = all_of[:180], np.concatenate([all_of[:160], all_of[180:]])
        met += bool(set(near.band_keys(a)) & set(near.band_keys(b)))
    assert met >= 990


def test_fingerprints_find_the_nearest_copies(spark):
    """Candidates of multi-index hashing alone: equal and close fingerprints, each verified by the shingle sets."""
    rng = random.Random(4)
    long = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(long)] + [(100 + k, t + " end") for k, t in enumerate(long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near.sketches(docs, "doc_id", "text").withColumnRenamed("doc_id", "rank")
    got = {(r.a.rank, r.b.rank) for r in near.by_fingerprint(nodes).collect()}
    assert got == {(k, 100 + k) for k in range(20)}


def test_texts_with_a_passage_in_common_stay(spark, monkeypatch):
    """Similar enough to share keys often, in buckets larger than all pairs allow, and never near."""
    monkeypatch.setattr(near, "ALL_PAIRS", 4)
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(200))
    rows = [(k, f"{passage} {' '.join(f'x{rng.randrange(10**6)}' for _ in range(60))}") for k in range(60)]
    assert near.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).count() == 60


def brute_force(rows):
    """The smallest id that near pairs lead to, over all pairs."""
    part = {i: i for i, _ in rows}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for k, (i, x) in enumerate(rows):
        for j, y in rows[:k]:
            if plain_jaccard(x, y) >= 0.8:
                a, b = sorted((root(i), root(j)))
                part[b] = a
    return {i: root(i) for i, _ in rows}


def chains(rng, families, size):
    """Families in which each text is a changed copy of another, so that many are near some but not the first."""
    rows = []
    for _ in range(families):
        texts = [[f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 120))]]
        while len(texts) < size:
            copy = list(rng.choice(texts))
            for at in rng.sample(range(len(copy)), rng.randrange(1, 3)):
                copy[at] = f"new{rng.randrange(10**6)}"
            texts.append(copy)
        rows += [" ".join(t) for t in texts]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "ALL_PAIRS", 2)
    monkeypatch.setattr(near, "LAST_PAIRS", 2)
    rows = chains(random.Random(5), 6, 30)
    got = near.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_force(rows)


def test_pairs_that_share_no_key_are_found(spark, monkeypatch):
    """No candidate of fingerprints or keys: all links come from the first shingles."""
    monkeypatch.setattr(near, "band_keys", lambda grams: [])
    rows = chains(random.Random(6), 6, 30)
    got = near.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_force(rows)


def test_similarity_of_exactly_four_fifths_counts():
    """The first shingles of sets at the limit meet, whatever the order."""
    rng = np.random.default_rng(8)
    for n in range(1, 60):
        all_of = np.sort(rng.integers(0, 1 << 63, 10 * n, dtype=np.int64)).astype("<u8")
        both = rng.permutation(all_of)
        a, b = np.sort(both[: 9 * n]), np.sort(np.concatenate([both[: 8 * n], both[9 * n :]]))
        known = np.sort(rng.choice(all_of, n, replace=False))
        often = rng.integers(2, 9, n)
        assert set(near.first_grams(a, known, often)) & set(near.first_grams(b, known, often))


def test_odd_sketches_are_never_farther_apart_than_the_sets():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 100, 3000):
        a, b = (np.unique(rng.integers(0, 4 * n + 1, n, dtype=np.int64)).astype("<u8") for _ in "ab")
        apart = sum(int(x).bit_count() for x in (near.odd_sketch(a) ^ near.odd_sketch(b)).view("<u8"))
        assert apart <= len(np.setxor1d(a, b))
