"""Repaired conversations against all edits of short ones and a plain dynamic program for longer ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kinsift.llm import dialogue
from tests.llm.conftest import SMALL

SHAPE = re.compile("(s?(ua)+)?")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    """First fault of each (turn, role, text), in order."""
    seen, out = set(), []
    for _, role, text in rows:
        stripped = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not stripped else "duplicate" if (role, text) in seen else "" if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def exhaustive(rows, found):
    """Cheapest cost and least audit over all edits with at most two inserts in one place."""
    best = None
    choices = []
    for (_, role, _), fault in zip(rows, found, strict=True):
        more = 3 * (fault == "truncated")
        own = [("D", 4, "")]
        if fault not in ("blank", "duplicate"):
            own += [("K", more, role[:1] or "?"), ("R", 3 + more, "u"), ("R", 3 + more, "a")]
        choices.append([("I" * len(put) + letter, 3 * len(put) + cost, put + made) for put in ("", "u", "a", "ua", "au") for letter, cost, made in own])
    for picked in itertools.product(*choices):
        for end in ("", "u", "a", "ua", "au"):
            if SHAPE.fullmatch("".join(p[2] for p in picked) + end):
                best = min(best or (10**9,), (sum(p[1] for p in picked) + 3 * len(end), "".join(p[0] for p in picked) + "I" * len(end)))
    return best


def plain(rows, found):
    """The same for longer ones: the best (cost, audit) of each state, row by row."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserts(best):
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                to, new = follow[state], (cost + 3, audit + "I")
                best[to] = min(best.get(to, new), new)
        return best

    best = inserts({"": (0, "")})
    for (_, role, _), fault in zip(rows, found, strict=True):
        more, after = 3 * (fault == "truncated"), {}
        for state, (cost, audit) in best.items():
            steps = [(state, 4, "D")]
            if fault not in ("blank", "duplicate"):
                steps.append((follow[state], 3 + more, "R"))
                if role[:1] == follow[state] or role[:1] == "s" and state == "":
                    steps.append((role[:1], more, "K"))
            for to, add, letter in steps:
                new = (cost + add, audit + letter)
                after[to] = min(after.get(to, new), new)
        best = inserts(after)
    return min(best[s] for s in ("", "a") if s in best)


def expected(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    found, turns = faults(rows), [r[0] for r in rows if r[0] is not None]
    cost, audit = plain(rows, found)
    if len(rows) <= 3:
        assert exhaustive(rows, found) == (cost, audit)
    lines, left, before = [], iter(rows), ""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)[1:]
        if letter != "D":
            before = "s" if letter == "K" and role[:1] == "s" else {"": "u", "s": "u", "u": "a", "a": "u"}[before]
            lines.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[before]}:{text}")
    broken = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), broken, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def of(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=repr)


def made_up(rng, convs, most):
    words = ["Yes.", "No!", "Why?", "cut off", "", "  ", "and so on  ", "Right. \n", "é."]
    roles = ["user", "assistant", "system", "tool", "user", "assistant", "", "sys", None]
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(most)):
            rows.append((conv, None if rng.random() < 0.05 else turn - (rng.random() < 0.2), rng.choice(roles[: rng.choice([3, 9])]), None if rng.random() < 0.03 else rng.choice(words)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_random_conversations(spark):
    rng = random.Random(11)
    rows = made_up(rng, [*range(150), None], 5) + made_up(rng, range(200, 215), 60)
    got = of(dialogue.report(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == sorted((expected(c, r) for c, r in by_conversation(rows).items()), key=repr)


@pytest.fixture
def ranges(spark):
    """A session that keeps small ranges apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_conversation_over_many_ranges(ranges):
    """Most rows belong to one conversation, many of them equal: it is split, and its repair is that of the whole."""
    rng = random.Random(12)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["So.", "cut", "Well!", f"Turn {t}.", f"turn {t}"])) for t in range(3000)]
    rows += [(1, 700, "user", "Again.")] * 500 + made_up(rng, range(2, 8), 6)
    frame = ranges.createDataFrame(rows, SCHEMA).repartition(5)
    assert of(dialogue.report(frame)) == sorted((expected(c, r) for c, r in by_conversation(rows).items()), key=repr)


def test_query_equals_the_plain_program(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = by_conversation(damage(rows))
    assert of(dialogue.op12_conversations(spark, SMALL)) == sorted((expected(c, left[c]) if c in left else (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows}), key=repr)


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(13)
    rows = made_up(rng, [*range(60), None], 4) + [(1000 + k, 3, "user", "Alone.") for k in range(40)] + [(7, 1, "user", "Twice.")] * 2 + [(None, None, None, None)] * 2 + [(5, 9, "user", "long " * 100_000)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n long, audit string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    left = by_conversation(damage(rows))
    want = [expected(c, left[c]) if c in left else (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows}]
    assert of(dialogue.op12_conversations(spark, str(tmp_path))) == sorted(want, key=repr)


def test_empty_table_and_other_types(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert dialogue.report(none).count() == 0 and dialogue.repair(none).count() == 0
    named = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Hello."), ("b", 1, "assistant", "Oh.")], "c string, t int, r string, x string")
    got = {(r.c, r.place, r.edit, r.role, r.text) for r in dialogue.repair(named, "c", "t", "r", "x").collect()}
    assert got == {("a", 0, "K", "user", "Hi."), ("a", 1, "K", "assistant", "Hello."), ("b", 0, "I", "user", ""), ("b", 1, "K", "assistant", "Oh.")}


@pytest.mark.parametrize("symbol", range(9))
def test_powers_are_repeated_steps(symbol):
    for n in (1, 2, 3, 7, 64, 1000):
        costs = dialogue.END
        for _ in range(n):
            costs = dialogue.before(dialogue.power(symbol, 0), costs)
        assert dialogue.before_run(symbol, n, dialogue.END) == costs == dialogue.before(dialogue.matrix_of(((symbol, n),)), dialogue.END)


def test_an_unrolled_run_of_thousands(ranges):
    frame = ranges.range(4000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x.").alias("text"))
    rows = dialogue.prepared(frame, "conv_id", "turn", "role", "text")
    assert dialogue.symbols(rows).select(F.spark_partition_id()).distinct().count() > 1
    row = dialogue.audits(rows).first()
    assert row.duplicate == 3999 and row.audit == "K" + "D" * 3999 + "I" and row.cost == 15999
