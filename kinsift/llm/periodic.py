"""Periodic runs of words, found on a grammar of the text.

A run is a stretch of words with smallest period q that spans at least four periods and six words and
that no neighbouring word extends. Its word pairs occur three times or more in the document, so the
text is first cut where a pair is rarer, and stretches of fewer than six words fall away. What is left
of many documents lies in one array of word ids and is compressed by Re-Pair in batched rounds: each
round replaces, by a new symbol, every pair that is more frequent than the pairs it overlaps. When no
pair repeats, the symbols left over are joined two by two to one root for each stretch.

A run crosses the boundary between the two sides of the lowest symbol that contains it. So the runs
across each symbol's boundary, inside its expansion, are computed once, at its first place in the
text: a period needs two copies on one side of the boundary, which one comparison of hashes tells,
and then reaches as far as a binary search over hashes says. They are moved to all places where the
symbol is derived, and of intervals with one period the maximal ones stay. Results are compared word
by word in the end; should a hash have collided, the batch is done again with other hashes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.llm.bpe import batched
from kinsift.llm.text import map_texts

#: A run spans this many of its periods and this many words at least.
COPIES, WORDS = 4, 6

#: Candidates (symbol, period) that are looked at together; bounds the memory of a long document.
TOGETHER = 1 << 21

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def stretches(ids: np.ndarray) -> np.ndarray:
    """Places of the words that can be part of a run, and the number of the stretch each is in.

    ids of different documents differ, so a pair across documents is never repeated.
    """
    at, piece = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    while len(at) > 1:
        own = ids[at]
        linked = piece[:-1] == piece[1:]
        keys = np.where(linked, own[:-1] * (ids.max() + 1) + own[1:], -1)
        order = np.argsort(keys, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
        often = np.empty(len(keys), bool)
        often[order] = np.repeat(np.diff(np.append(edges, len(keys))) >= COPIES - 1, np.diff(np.append(edges, len(keys))))
        cut = np.append(0, np.cumsum(~(often & linked)))
        keep = np.bincount(cut)[cut] >= WORDS
        if keep.all() and (np.diff(cut) == 0).sum() == linked.sum():
            break
        at, piece = at[keep], cut[keep]
    return (at, piece) if len(at) >= WORDS else (at[:0], piece[:0])


class Grammar:
    """Re-Pair over the stretches of one batch: two sides, length and first place of each symbol."""

    def __init__(self, words: np.ndarray, piece: np.ndarray):
        _, symbols = np.unique(words, return_inverse=True)
        self.terminals = int(symbols.max()) + 1
        self.sides, self.first, self.blocks = [], [], []
        self.size = [np.ones(self.terminals, np.int64)]
        self.total = self.terminals
        symbols, place = symbols.astype(np.int64), np.arange(len(words))
        while len(symbols) > 1:
            chosen, keys = self.repeated(symbols, piece)
            if not len(chosen):
                chosen, keys = self.neighbours(piece)
                if not len(chosen):
                    break
            symbols, piece, place = self.replace(symbols, piece, place, chosen, keys)
        self.roots, self.places = symbols, place
        self.left, self.right = (np.concatenate([np.full(self.terminals, -1), *x]) for x in zip(*self.sides, strict=True))
        self.first = np.concatenate([np.zeros(self.terminals, np.int64), *self.first])
        self.size = np.concatenate(self.size)

    def repeated(self, symbols: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of repeated pairs that beat the pairs they overlap: by the number of bits of their count, then by
        a hash, so that long chains of ever more frequent pairs do not wait for each other."""
        keys = np.where(piece[:-1] == piece[1:], symbols[:-1] * self.total + symbols[1:], -1)
        order = np.argsort(keys, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
        counts = np.diff(np.append(edges, len(keys)))
        counts[keys[order[edges]] < 0] = 0
        weight = np.frexp(counts.astype(np.float64))[1].astype(np.uint64) << np.uint64(56)
        weight |= (keys[order[edges]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)
        ranked = np.empty(len(edges), np.int64)
        ranked[np.argsort(weight, kind="stable")] = np.arange(1, len(edges) + 1)
        ranked[counts < 2] = 0
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.repeat(ranked, np.diff(np.append(edges, len(keys))))
        best = (rank > 0) & (rank >= np.append(0, rank[:-1])) & (rank >= np.append(rank[1:], 0))
        chosen = np.flatnonzero(best)
        # of overlapping places (x x x) every second one, from the left
        run = np.maximum.accumulate(np.where(np.append(True, np.diff(chosen) != 1), np.arange(len(chosen)), 0)) if len(chosen) else chosen
        chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
        return chosen, keys[chosen]

    @staticmethod
    def neighbours(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every second place of each stretch; no two share a symbol."""
        starts = np.flatnonzero(np.append(True, np.diff(piece) != 0))
        within = np.arange(len(piece)) - np.repeat(starts, np.diff(np.append(starts, len(piece))))
        chosen = np.flatnonzero((within[:-1] % 2 == 0) & (piece[:-1] == piece[1:]))
        return chosen, np.arange(len(chosen))

    def replace(self, symbols: np.ndarray, piece: np.ndarray, place: np.ndarray, chosen: np.ndarray, keys: np.ndarray) -> tuple:
        _, once, which = np.unique(keys, return_index=True, return_inverse=True)
        one = chosen[once]
        sizes = np.concatenate(self.size) if len(self.size) > 1 else self.size[0]
        self.sides.append((symbols[one], symbols[one + 1]))
        self.first.append(place[one])
        self.size = [sizes, sizes[symbols[one]] + sizes[symbols[one + 1]]]
        symbols[chosen] = self.total + which
        self.blocks.append((self.total, self.total + len(once)))
        self.total += len(once)
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        return symbols[keep], piece[keep], place[keep]


class Hashes:
    """Prefix sums of words times powers: equal stretches have equal hashes, whichever the seed."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        values = rng.integers(1, 1 << 63, int(words.max()) + 1, np.uint64)
        base = np.full(len(words) + 1, int(rng.integers(0, 1 << 62)) * 2 + 1, np.uint64)
        base[0] = 1
        self.power = np.multiply.accumulate(base)
        self.sums = np.append(np.uint64(0), np.cumsum(values[words] * self.power[:-1]))

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from a equal those from b; a < b."""
        return (self.sums[a + size] - self.sums[a]) * self.power[b - a] == self.sums[b + size] - self.sums[b]

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from a (up to a, if back) equal those from b; at most ``most``."""
        got = np.zeros(len(a), np.int64)
        for bit in range(int(most.max(initial=0)).bit_length(), -1, -1):
            more = got + (1 << bit)
            ok = np.flatnonzero(more <= most)
            shift = more[ok] if back else 0
            same = self.equal(a[ok] - shift, b[ok] - shift, more[ok])
            got[ok[same]] = more[ok[same]]
        return got


def crossing(grammar: Grammar, hashes: Hashes, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """(symbol, start, end, period) of the runs across each symbol's boundary; places count from the symbol's start."""
    symbols = np.arange(grammar.terminals, grammar.total)
    begin, end = grammar.first[symbols], grammar.first[symbols] + grammar.size[symbols]
    middle = begin + grammar.size[grammar.left[symbols]]
    found = []
    for right in (True, False):
        most = np.minimum((end - middle if right else middle - begin) // 2, (end - begin) // COPIES)
        bounds = np.append(0, np.cumsum(most))
        low = 0
        while low < len(symbols):
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + TOGETHER, side="right")) - 1)
            which = np.repeat(np.arange(low, high), most[low:high])
            q = np.arange(len(which)) - (bounds[which] - bounds[low]) + 1
            m = middle[which]
            at = m if right else m - q  # words from here and from q further on are compared
            ok = np.flatnonzero((words[at] == words[at + q]) & (words[at - 1] == words[at - 1 + q]) if right else (words[m] == words[at]) & (words[m - 1] == words[at - 1]))
            which, q, at = which[ok], q[ok], at[ok]
            ok = hashes.equal(at, at + q, q) if right else hashes.equal(at - q, at, q)
            which, q, at = which[ok], q[ok], at[ok]
            start = at - hashes.reach(at, at + q, at - begin[which], back=True)
            stop = at + q + hashes.reach(at, at + q, end[which] - at - q)
            ok = stop - start >= np.maximum(WORDS, COPIES * q)
            found.append((symbols[which[ok]], (start - begin[which])[ok], (stop - begin[which])[ok], q[ok]))
            low = high
    return shortest_periods(*(np.concatenate(x) for x in zip(*found, strict=True)))


def shortest_periods(owner: np.ndarray, start: np.ndarray, stop: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of equal intervals of one owner, the one of the smallest period: the others are its multiples."""
    order = np.lexsort((q, stop, start, owner))
    owner, start, stop, q = owner[order], start[order], stop[order], q[order]
    new = np.append(True, (np.diff(owner) != 0) | (np.diff(start) != 0) | (np.diff(stop) != 0))[: len(q)]
    return owner[new], start[new], stop[new], q[new]


def everywhere(grammar: Grammar, owner: np.ndarray, start: np.ndarray, stop: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, period) of the runs at all places where their symbols are derived; owner is sorted."""
    edges = np.searchsorted(owner, np.arange(grammar.total + 1))
    wanted = np.diff(edges) > 0
    for low, high in grammar.blocks:
        wanted[low:high] |= wanted[grammar.left[low:high]] | wanted[grammar.right[low:high]]
    symbols, places, out = grammar.roots, grammar.places, []
    while len(symbols):
        go = wanted[symbols]
        symbols, places = symbols[go], places[go]
        many = edges[symbols + 1] - edges[symbols]
        run = np.repeat(edges[symbols] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum()) if len(many) else many
        shift = np.repeat(places, many)
        out.append((start[run] + shift, stop[run] + shift, q[run]))
        inner = symbols >= grammar.terminals
        symbols, places = symbols[inner], places[inner]
        left = grammar.left[symbols]
        symbols, places = np.concatenate([left, grammar.right[symbols]]), np.concatenate([places, places + grammar.size[left]])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def maximal(start: np.ndarray, stop: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of one period that share a period or more are one; then each has its smallest period."""
    order = np.lexsort((start, q))
    start, stop, q = start[order], stop[order], q[order]
    group = np.append(0, np.cumsum(np.diff(q) != 0))[: len(q)]
    span = int(stop.max(initial=0)) + 1
    far = np.maximum.accumulate(stop + group * span) - group * span if len(q) else stop
    new = np.append(True, (np.diff(q) != 0) | (start[1:] > far[:-1] - q[1:]))[: len(q)]
    firsts = np.flatnonzero(new)
    if len(firsts):
        start, stop, q = start[firsts], np.maximum.reduceat(stop, firsts), q[firsts]
    return shortest_periods(np.zeros(len(q), np.int64), start, stop, q)[1:]


def true_runs(words: np.ndarray, piece: np.ndarray, runs: tuple[np.ndarray, ...]) -> bool:
    """Whether every interval has its period and no word beside it extends it."""
    for a, b, q in zip(*(x.tolist() for x in runs), strict=True):
        if not np.array_equal(words[a : b - q], words[a + q : b]):
            return False
        if a and piece[a - 1] == piece[a] and words[a - 1] == words[a - 1 + q] or b < len(words) and piece[b] == piece[a] and words[b] == words[b - q]:
            return False
    return True


def find(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, length, period) of all runs in the words of a batch, by start and period."""
    at, piece = stretches(ids)
    none = np.empty(0, np.int64)
    if not len(at):
        return none, none, none
    _, words = np.unique(ids[at], return_inverse=True)
    grammar = Grammar(words, piece)
    for seed in count():
        found = maximal(*everywhere(grammar, *crossing(grammar, Hashes(words, seed), words)))
        if true_runs(words, piece, found):
            break
    start, stop, q = found
    order = np.lexsort((q, start))
    return at[start[order]], (stop - start)[order], q[order]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d]


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", change: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each row's words by start and period, and the text without
    the repeats, its words joined by one space.

    ``change(doc_id, n)`` may give the places of the words to read in place of 0 to n-1 (None: as they are).
    Words are parted by ASCII white space. A null or empty text has no words, no runs and an empty collapsed
    text; null ids stay null; repeated rows stay repeated; other columns are not looked at; an empty table gives
    no rows. Each document is worked on whole, in one task, with memory in proportion to its length; nothing is shuffled.
    """

    def rows(pairs: Iterator[tuple]) -> Iterator[tuple]:
        for part in batched(pairs):
            number, texts, ids = count(), [], []
            for i, raw in part:
                words = raw.split()
                places = change(i, len(words)) if change and words else None
                if places is not None:
                    words = [words[k] for k in places.tolist()]
                texts.append(words)
                ids.append(np.fromiter(map(defaultdict(number.__next__).__getitem__, words), np.int64, len(words)))
            starts = np.append(0, np.cumsum([len(x) for x in ids]))
            runs = find(np.concatenate(ids))
            edges = np.searchsorted(runs[0], starts)
            for k, (i, _) in enumerate(part):
                own = [(s - int(starts[k]), n, q) for s, n, q in zip(*(x[edges[k] : edges[k + 1]].tolist() for x in runs), strict=True)]
                words = kept_words(texts[k], own) if own else texts[k]
                yield i, len(texts[k]), [dict(zip(("start", "length", "period"), run, strict=True)) for run in own], b" ".join(words).decode()

    return map_texts(docs, doc_id, text, f"doc_id bigint, n_words bigint, runs {RUN}, collapsed string", rows)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's damage: in one document of ten, all words from a place on repeat with a period."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def longest(runs: Column) -> Column:
    """The run of the greatest length; of these the smallest start, then period."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = report(docs, change=planted).withColumn("top", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    length, period = F.col("top.length"), -F.col("top.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
