"""Periodic runs against a check of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from kinsift.llm import periodic
from tests.llm.conftest import SMALL


def all_runs(words):
    """Every maximal stretch of each period that is long enough, with its smallest period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def texts(rng):
    n, kind = rng.randrange(120), rng.randrange(7)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [0] * n
    if kind == 2:
        unit = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
        return [rng.randrange(3) for _ in range(rng.randrange(9))] + (unit * 40)[:n] + [rng.randrange(3) for _ in range(rng.randrange(9))]
    if kind == 3:
        words = [0]
        while len(words) < n:
            words += words[-rng.randrange(1, len(words) + 1) :] * rng.randrange(1, 6)
        return words[:400]
    if kind == 4:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 5:
        return [rng.randrange(50) for _ in range(n)]
    return ([0] * rng.randrange(1, 9) + [1]) * rng.randrange(1, 8)


def test_runs_of_random_batches():
    rng = random.Random(5)
    for _ in range(600):
        batch, ids, want = [texts(rng) for _ in range(rng.randrange(1, 6))], [], []
        for k, words in enumerate(batch):
            want += [(s + len(ids), n, q) for s, n, q in all_runs(words)]
            ids += [w + 100 * k for w in words]
        got = list(zip(*(x.tolist() for x in periodic.find(np.array(ids, np.int64))), strict=True))
        assert got == want


def test_small_groups_of_candidates(monkeypatch):
    monkeypatch.setattr(periodic, "TOGETHER", 3)
    rng = random.Random(6)
    for _ in range(100):
        words = texts(rng)
        assert list(zip(*(x.tolist() for x in periodic.find(np.array(words, np.int64))), strict=True)) == all_runs(words)


def test_colliding_hashes_are_noticed(monkeypatch):
    class Poor(periodic.Hashes):
        def __init__(self, words, seed):
            super().__init__(words if seed > 1 else np.zeros_like(words), seed)

    monkeypatch.setattr(periodic, "Hashes", Poor)
    words = [0, 1, 2] * 5 + [3, 0, 1, 2] * 5 + [2, 2, 1] * 9
    assert list(zip(*(x.tolist() for x in periodic.find(np.array(words, np.int64))), strict=True)) == all_runs(words)


def expected(rows):
    out = []
    for i, text in rows:
        words = [] if text is None else [w.decode() for w in text.encode().split()]
        h = None if i is None else zlib.crc32(str(i).encode())
        if words and h is not None and h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = all_runs(words)
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((i, len(runs), *top, None if top[1] is None else 1000 * top[1] // top[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in drop))))
    return sorted(out, key=repr)


def of(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=repr)


def test_query_equals_all_periods(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = of(periodic.op11_periodic_runs(spark, SMALL))
    assert got == expected(rows) and any(r[1] for r in got)


def test_odd_rows(spark, odd, odd_rows, empty, tmp_path):
    extra = [(100 + k, t) for k, t in enumerate(["a a a a a", "a a a a a a", "x " * 40, "a b c " * 400 + "d", "é ü " * 4, "  a\tb\na b\x0ba b a b  ", "a b " * 6])]
    rows = [r[:2] for r in odd_rows if len(r[1] or "") < 5000] + extra
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert of(periodic.op11_periodic_runs(spark, str(tmp_path))) == expected(rows)
    assert periodic.report(odd).count() == len(odd_rows)
    assert periodic.report(empty).count() == 0


def test_a_long_text_collapses(spark):
    docs = spark.createDataFrame([(7, "start " + "one two three " * 50_000 + "end")], "doc_id long, text string")
    row = periodic.report(docs).first()
    assert [tuple(r) for r in row.runs] == [(1, 150_000, 3)]
    assert row.collapsed == "start one two three end" and row.n_words == 150_002


@pytest.mark.parametrize("n", [0, 1, 2])
def test_short(n):
    assert [len(x) for x in periodic.find(np.zeros(n, np.int64))] == [0, 0, 0]
