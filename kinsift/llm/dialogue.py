"""Repair of conversation structure: the cheapest edits that make roles alternate, by dynamic programming over runs.

A conversation is read as a row of symbols, each the role's class and what is wrong with the row. A symbol
moves an automaton of four states (nothing written, after system, after user, after assistant) at the
costs of a 4 x 4 matrix in which sums take the place of products and minima that of sums; inserted rows
are part of it. Equal consecutive symbols are one run, whose matrix is put together from cached binary
powers. Costs are carried from the end to the start, then choices are unrolled from the start: given
the state, each edit leads to one state, so the least letter of those that keep the cost gives the least audit.

Matrices compose, so a conversation of any length is worked on in ranges of its rows: each range sends
its runs and one matrix, learns what its rows cost from there on, and unrolls its part for each state
that it may be entered in. Only conversations at a range's ends can be split; all others are done in their range.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from kinsift.llm.text import pack, release
from kinsift.storage import materialize

SPACE = " \t\n\x0b\x0c\r"

#: States: nothing written, after a system, a user, an assistant row. The next row that may follow each, as a state.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = ("", "system", "user", "assistant")

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Symbols: 2 * class + (truncated), class s, u, a or another; the last is a row that must go.
CLASSES = "sua"
GONE = 8

NEVER = 1 << 60

Matrix = tuple[tuple[int, ...], ...]
Costs = tuple[int, ...]


def kept_state(state: int, symbol: int) -> int | None:
    """The state after a row that keeps its role; None where it may not stand."""
    role = symbol // 2 + 1
    if symbol == GONE or role > ASSISTANT:
        return None
    if role == SYSTEM:
        return SYSTEM if state == START else None
    return role if NEXT[state] == role else None


def inserted(state: int, most: int = 2) -> Iterator[tuple[int, int]]:
    """The states that inserts lead to, with their costs."""
    for k in range(most + 1):
        yield state, k * INSERT
        state = NEXT[state]


#: What it costs to end in each state: an even number of rows must follow an optional system row.
END: Costs = tuple(min(cost for at, cost in inserted(s) if at in (START, ASSISTANT)) for s in range(4))


@functools.lru_cache(maxsize=None)
def power(symbol: int, bit: int) -> Matrix:
    """The matrix of 2**bit rows of one symbol."""
    if bit:
        half = power(symbol, bit - 1)
        return compose(half, half)
    out = [[NEVER] * 4 for _ in range(4)]
    more = TRUNCATED if symbol % 2 else 0
    for start in range(4):
        for state, cost in inserted(start):
            steps = [(state, DELETE)]
            if symbol != GONE:
                steps.append((NEXT[state], REROLE + more))
                if (kept := kept_state(state, symbol)) is not None:
                    steps.append((kept, more))
            for to, add in steps:
                out[start][to] = min(out[start][to], cost + add)
    return tuple(map(tuple, out))


def compose(first: Matrix, then: Matrix) -> Matrix:
    return tuple(tuple(min(first[i][k] + then[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def before(matrix: Matrix, costs: Costs) -> Costs:
    """Costs to the end from each state, given those behind the matrix."""
    return tuple(min(a + b for a, b in zip(row, costs, strict=True)) for row in matrix)


@functools.lru_cache(maxsize=1 << 14)
def _before_run(symbol: int, length: int, costs: Costs) -> Costs:
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            costs = before(power(symbol, bit), costs)
    return costs


def before_run(symbol: int, length: int, costs: Costs) -> Costs:
    """Costs before ``length`` rows of one symbol. They are cached less their minimum, which few values occur of."""
    least = min(costs)
    return tuple(c + least for c in _before_run(symbol, length, tuple(c - least for c in costs)))


@functools.lru_cache(maxsize=1 << 12)
def matrix_of(runs: tuple[tuple[int, int], ...]) -> Matrix:
    """The matrix of a row of runs."""
    whole = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))
    for symbol, length in runs:
        for bit in range(length.bit_length()):
            if length >> bit & 1:
                whole = compose(whole, power(symbol, bit))
    return whole


@functools.lru_cache(maxsize=1 << 14)
def _row(symbol: int, state: int, after: Costs) -> tuple[str, int]:
    now, out = before(power(symbol, 0), after), ""
    more = TRUNCATED if symbol % 2 else 0
    while True:
        if DELETE + after[state] == now[state]:
            return out + "D", state
        if INSERT + now[NEXT[state]] == now[state]:
            out, state = out + "I", NEXT[state]
            continue
        kept = kept_state(state, symbol)
        if kept is not None and more + after[kept] == now[state]:
            return out + "K", kept
        return out + "R", NEXT[state]


def unroll_run(symbol: int, length: int, state: int, after: Costs) -> tuple[list[str], int]:
    """The edits of a run entered in a state, and the state it is left in; halves are told apart by cached powers."""
    least = min(after)
    after = tuple(c - least for c in after)
    if length == 1:
        edits, state = _row(symbol, state, after)
        return [edits], state
    half = length // 2
    first, state = unroll_run(symbol, length - half, state, before_run(symbol, half, after))
    then, state = unroll_run(symbol, half, state, after)
    return first + then, state


def unroll(runs: list[tuple[int, int]], state: int, after: Costs) -> tuple[str, int]:
    """The least audit of the cheapest edits, and the last state."""
    behind = [after]
    for symbol, length in reversed(runs[1:]):
        behind.append(before_run(symbol, length, behind[-1]))
    out = []
    for (symbol, length), costs in zip(runs, reversed(behind), strict=True):
        edits, state = unroll_run(symbol, length, state, costs)
        out += edits
    return "".join(out), state


def closing(state: int) -> tuple[str, int]:
    """The inserts that end a conversation."""
    out = ""
    while state not in (START, ASSISTANT):
        out, state = out + "I", NEXT[state]
    return out, state


# ---- rows of conversations ----------------------------------------------------------------------


def prepared(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text) of every row; a null role or text is one space."""
    return rows.select(F.col(conv_id).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


ORDER = ["conv", "turn", "role", "digest"]


def symbols(rows: DataFrame) -> DataFrame:
    """(conv, turn, initial, n, blank, truncated, again) in order of rows: equal rows are one with their number n,
    and again says that the role and text occur in an earlier turn."""
    ending = F.rtrim(F.col("text"), F.lit(SPACE))
    facts = rows.select("conv", "turn", "role", digest(F.col("text")).alias("digest"), (ending == "").alias("blank"), (~F.right(ending, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    equal = facts.groupBy("conv", "turn", "role", "digest").agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    texts = equal.groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.count("*").alias("turns"), F.min(order).alias("earliest"))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    marked = equal.join(texts.filter("turns > 1"), same, "left").withColumn("again", F.coalesce(F.col("earliest") != order, F.lit(False)))
    ranges = marked.select(*ORDER, "n", "blank", "truncated", "again").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return ranges.select("conv", "turn", F.left("role", F.lit(1)).alias("initial"), "n", "blank", "truncated", "again")


FACTS = ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")


class Piece:
    """What one range knows of a conversation."""

    def __init__(self, conv: object):
        self.conv, self.runs = conv, []
        self.low = self.high = self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, n: int, blank: bool, truncated: bool, again: bool) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.illegal += (self.last is not None and illegal(self.last, initial)) + (n - 1) * illegal(initial, initial)
        self.first = initial if self.first is None else self.first
        self.last = initial
        if blank or again:
            self.blank, self.duplicate = self.blank + n * blank, self.duplicate + n * (not blank)
            self.extend(GONE, n)
            return
        self.truncated += truncated
        place = CLASSES.find(initial) if initial else -1
        self.extend(2 * (place if place >= 0 else 3) + truncated, 1)
        if n > 1:
            self.duplicate += n - 1
            self.extend(GONE, n - 1)

    def extend(self, symbol: int, n: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1] = (symbol, self.runs[-1][1] + n)
        else:
            self.runs.append((symbol, n))

    def facts(self) -> tuple:
        return self.low, self.high, self.turns, self.blank, self.duplicate, self.truncated, self.illegal


def illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def keyed(conv: StructField, rest: str) -> StructType:
    """A schema with the conversation's own column in front."""
    return StructType([StructField("conv", conv.dataType, True), *StructType.fromDDL(rest).fields])


def in_arrow(rows: DataFrame, schema: StructType, work: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Runs ``work`` over the tuples of each partition in Arrow batches."""
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack(work(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), kinds)
        release()

    return rows.mapInArrow(run, schema)


def audits(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of prepared rows, a row for each conversation."""
    conv = rows.schema["conv"]

    def work(given: Iterator[tuple]) -> Iterator[tuple]:
        part, held, first = TaskContext.get().partitionId(), None, True
        for key, *row in given:
            if held is None or key != held.conv:
                if held is not None:
                    yield split(part, held) if first else whole(held)
                    first = False
                held = Piece(key)
            held.add(*row)
        if held is not None:
            yield split(part, held)

    def whole(p: Piece) -> tuple:
        """A conversation that lies in this range."""
        edits, state = unroll(p.runs, START, END)
        cost = functools.reduce(lambda c, run: before_run(*run, c), reversed(p.runs), END)[START]
        return p.conv, None, None, gaps(p.low, p.high, p.turns), p.blank, p.duplicate, p.truncated, p.illegal, cost, edits + closing(state)[0]

    def split(part: int, p: Piece) -> tuple:
        """One that may go on in another range."""
        piece = {"runs": [dict(zip(("symbol", "n"), r, strict=True)) for r in p.runs], "matrix": [c for line in matrix_of(tuple(p.runs)) for c in line], "first": p.first, "last": p.last}
        piece |= dict(zip(FACTS, p.facts(), strict=True))
        return p.conv, part, piece, *[None] * 7

    facts = "first_turn: bigint, last_turn: bigint, turns: bigint, blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint"
    schema = keyed(conv, f"part int, piece struct<runs: array<struct<symbol: int, n: bigint>>, matrix: array<bigint>, first: string, last: string, {facts}>, {RESULT}")
    found = materialize(in_arrow(symbols(rows), schema, work), "pieces")
    names = [f.name for f in StructType.fromDDL(RESULT).fields]
    done = found.filter("part is null").select("conv", *names)
    # At most two pieces a range from here on. What follows a piece comes from the matrices behind it.
    ends = found.filter("part is not null").select("conv", "part", F.col("piece.matrix").alias("matrix"))
    behind = in_arrow(ends.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "matrix"))).alias("pieces")), keyed(conv, "part int, after array<bigint>"), behind_pieces)
    joined = found.filter("part is not null").select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), "piece")
    joined = joined.join(behind, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).select("conv", "part", "piece", "after")
    ways = in_arrow(joined, keyed(conv, f"part int, first string, last string, {facts.replace(':', '')}, costs array<bigint>, ways array<struct<audit: string, state: int>>"), ways_through)
    grouped = ways.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(*ways.columns[1:]))).alias("pieces"))
    return done.unionByName(in_arrow(grouped, keyed(conv, RESULT), joined_pieces))


def behind_pieces(given: Iterator[tuple]) -> Iterator[tuple]:
    for conv, pieces in given:
        costs = END
        for piece in reversed(pieces):
            yield conv, piece["part"], list(costs)
            m = piece["matrix"]
            costs = before(tuple(tuple(m[k : k + 4]) for k in range(0, 16, 4)), costs)


def ways_through(given: Iterator[tuple]) -> Iterator[tuple]:
    """The edits of a piece for each state in which it may be entered."""
    for conv, part, piece, after in given:
        runs, after = [(r["symbol"], r["n"]) for r in piece["runs"]], tuple(after)
        costs = functools.reduce(lambda c, run: before_run(*run, c), reversed(runs), after)
        yield conv, part, piece["first"], piece["last"], *(piece[f] for f in FACTS), list(costs), [dict(zip(("audit", "state"), unroll(runs, s, after), strict=True)) for s in range(4)]


def joined_pieces(given: Iterator[tuple]) -> Iterator[tuple]:
    for conv, pieces in given:
        state, audit, last, low, high = START, [], None, None, None
        totals = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
        for p in pieces:
            for name in totals:
                totals[name] += p[name]
            totals["illegal"] += last is not None and illegal(last, p["first"])
            totals["turns"] -= high is not None and high == p["first_turn"]
            low, high, last = p["first_turn"] if low is None else low, p["last_turn"] if p["last_turn"] is not None else high, p["last"]
            audit.append(p["ways"][state]["audit"])
            state = p["ways"][state]["state"]
        audit.append(closing(state)[0])
        yield conv, gaps(low, high, totals.pop("turns")), *totals.values(), pieces[0]["costs"][START], "".join(audit)


def edited(found: DataFrame, rows: DataFrame, schema: StructType, emit: Callable[[object, tuple, Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Streams each conversation's audit and its rows in order through ``emit``.

    found has the audits and, with a null audit, conversations without rows. Nothing but the audit is held.
    """
    names = [f.name for f in StructType.fromDDL(RESULT).fields]
    heads = found.select("conv", F.lit(0).alias("tag"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *names)
    lines = rows.select("conv", F.lit(1).alias("tag"), "turn", "role", "text", *(F.lit(None).cast(found.schema[n].dataType).alias(n) for n in names))
    both = heads.unionByName(lines).repartition("conv").withColumn("digest", digest(F.col("text"))).sortWithinPartitions("conv", "tag", "turn", "role", "digest").drop("digest")

    def work(given: Iterator[tuple]) -> Iterator[tuple]:
        at = next(given, None)
        while at is not None:
            head = at

            def lines() -> Iterator[tuple]:
                nonlocal at
                at = next(given, None)
                while at is not None and at[1] == 1:
                    yield at[3], at[4]
                    at = next(given, None)

            yield from emit(head[0], head[5:], lines())

    return in_arrow(both, schema, work)


def edits_of(audit: str, lines: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each row of the repaired conversation."""
    state = START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(lines)
        if letter == "D":
            continue
        system = letter == "K" and role[:1] == "s"
        state = SYSTEM if system else NEXT[state]
        yield letter, role if letter == "K" else NAMES[state], text
    for _ in lines:  # moves on to the next conversation
        raise ValueError("an audit is shorter than its conversation")


def hashed(conv: object, head: tuple, lines: Iterator[tuple]) -> Iterator[tuple]:
    sha, first = hashlib.sha256(), True
    for _, role, text in edits_of(head[-1] or "", lines):
        sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    yield conv, *(head if head[-1] is not None else (0,) * 6 + ("",)), sha.hexdigest()


def numbered(conv: object, head: tuple, lines: Iterator[tuple]) -> Iterator[tuple]:
    for k, (edit, role, text) in enumerate(edits_of(head[-1] or "", lines)):
        yield conv, k, edit, role, text


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations; edit is K(ept), R(eroled) or I(nserted).

    Rows are taken by turn (null first), of one turn by role and a digest of the text. A null role or text
    is one space, a null conv_id a conversation of its own; ids may have any type; other columns are not
    looked at; an empty table gives no rows. A conversation that loses all rows has none here.
    """
    given = prepared(rows, conv_id, turn, role, text)
    schema = keyed(given.schema["conv"], "place bigint, edit string, role string, text string")
    return edited(audits(given), given, schema, numbered).withColumnRenamed("conv", conv_id)


def report(rows: DataFrame, ids: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation.

    Edge cases as for repair(). ids may have further rows with a conv_id: conversations without rows get
    zeros, an empty audit and the digest of nothing. The digest is of one sequence, so one task streams
    through the texts of a conversation; all else about long conversations is done in ranges.
    """
    given = prepared(rows, conv_id, turn, role, text)
    found = audits(given)
    if ids is not None:
        names = [f.name for f in StructType.fromDDL(RESULT).fields]
        both = found.withColumn("_found", F.lit(1)).unionByName(ids.select(F.col(conv_id).alias("conv")).distinct().withColumn("_found", F.lit(0)), allowMissingColumns=True)
        found = both.groupBy("conv").agg(*(F.max(n).alias(n) for n in names))
    return edited(found, given, keyed(given.schema["conv"], f"{RESULT}, repaired_sha256 string"), hashed).withColumnRenamed("conv", conv_id)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, by a checksum of conversation and turn."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind", "copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return report(damaged(rows), rows)
