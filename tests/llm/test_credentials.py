"""Secret scans: base patterns against plain regular expressions, inferred formats on examples that were held out."""

import hashlib
import re

import pytest

from kinsift.llm import credentials
from tests.llm.conftest import SMALL

PLAIN = {
    "assign": (re.compile("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def plain(text):
    """kind:start:end of all base matches, by start and kind, in code points."""
    found = [(m.start(), k, kind, m.end()) for k, (kind, (pattern, good)) in enumerate(PLAIN.items()) for m in pattern.finditer(text or "") if good(m)]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def check(rows, got):
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in rows), key=repr)
    by_id = {}
    for i, text in rows:
        by_id.setdefault(i, []).append(plain(text))
    for row in got:
        want = next(w for w in by_id[row.doc_id] if hashlib.sha256(",".join(w).encode()).hexdigest() == row.base_sha256)
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s.startswith(k) for s in want) for k in PLAIN]
        assert set(want) <= set(row.spans.split(",")) | ({""} if not want else set())


@pytest.fixture(scope="module")
def model(spark):
    return credentials.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_query_equals_plain_patterns(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(rows, credentials.op13_secrets(spark, SMALL).collect())


def test_query_on_odd_rows(spark, odd_rows, tmp_path):
    key = "AKIA" + "Q7" * 8
    extra = [
        "ſecret: abcdef1 ſecret", "TOKEN='abcdef' token=short passwd : x api_key=\"A/b+c=.-_9\"", f"é🎉 {key} {key}AKIA {key[:19]}", "0123456789abcdef01234567 " * 3 + "0123456789abcdef0123456",
        "ABCDEF0123456789abcdef0123456789ABCDEF", "password==== secret:\x20\x20'tokén", "token:\ttoken=token=token", "api-key=abcdefg apikey:abcdefg API_KEY=abcdefg", "x" * 300_000 + " secret=abcdef", f"token = {'0123456789abcdef' * 3}",
    ]
    rows = [r[:2] for r in odd_rows] + [(200 + k, t) for k, t in enumerate(extra)]
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, spans string, score double")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    check(rows, credentials.op13_secrets(spark, str(tmp_path)).collect())


def test_empty_table(spark, empty, model):
    assert credentials.scan(empty, model).count() == 0
    assert credentials.fit(empty).formats.keys() == model.formats.keys()


@pytest.mark.parametrize("label", credentials.FORMATS)
def test_formats_that_were_held_out(model, label):
    words = credentials.spelt(label, credentials.FORMATS[label], 300, seed=9)
    assert sum(model.score(w.encode()) is not None for w in words) >= 0.9 * len(words)


def test_ordinary_words_are_no_secrets(model):
    words = [w for w in credentials.spelt(credentials.WORD, credentials.WORDS, 600, seed=9) if len(w) >= credentials.SHORTEST]
    assert sum(model.score(w.encode()) is not None for w in words) <= 0.02 * len(words)
    for word in ["internationalization", "2023-10-05T12:30:00", "some_long_variable_name_here", "1234567890123456", "AbstractSingletonProxyFactoryBean"]:
        assert model.score(word.encode()) is None


def test_added_spans_and_their_places(model):
    token = credentials.spelt("github", credentials.FORMATS["github"], 1, seed=4)[0]
    text = f"Größe 🎉 {token}. token={'ab12' * 8} ü{token}"
    assert [s[:3] for s in credentials.spans_of(text.encode(), model)] == [(model.score(token.encode())[0], 8, 8 + len(token)), ("assign", 10 + len(token), 48 + len(token)), ("hex", 16 + len(token), 48 + len(token))]


def test_merging_keeps_prefixes_and_loops_the_rest():
    automaton = credentials.infer(["id_" + w for w in credentials.spelt("x", [[("abcd", 5, 30)]], 400)])
    assert len(automaton) < 12
    assert credentials.bits(automaton, "id_abcdabcd") < 60 and credentials.bits(automaton, "abcdabcd") == float("inf")


def test_merged_counts_are_those_of_the_examples():
    """Every automaton gives all words of a small language together a probability of at most one."""
    import itertools

    automaton = credentials.infer(["ab", "abab", "a", "ababab", "b"] * 20)
    total = sum(2 ** -credentials.bits(automaton, "".join(w)) for n in range(9) for w in itertools.product("ab", repeat=n))
    assert 0.3 < total <= 1.05
