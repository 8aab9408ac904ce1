"""Secret scans: probabilistic automata, inferred from labelled credentials, score what looks like a credential.

The grammar of each label is inferred by merging states. Its examples form a prefix tree with counts; from
the root on, each new state is merged with a known one if their endings and next letters, and those of all
states reached from both, differ by less than a Hoeffding bound allows; of several the closest is taken, and if
there is none the state stays. Fixed prefixes stay chains of states, random parts become loops.

Examples come from two sources: the base patterns label values found in the corpus (a bounded sample), and
public formats are spelt out from their prefix, alphabet and length. Ordinary long words, of the corpus and
spelt out, train one more automaton in the same way. A candidate is every maximal stretch of letters that
credentials consist of; it is a secret if some format explains it better than ordinary words do, by so
many bits a letter and in all.
"""

from __future__ import annotations

import functools
import heapq
import math
import random
import re
import string
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.llm.bpe import batched
from kinsift.llm.text import map_texts
from kinsift.storage import materialize

#: Base patterns on UTF-8 bytes, with the least length of group 1; a match that is shorter is dropped.
BASE = {
    "assign": (re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 6),
    "access": (re.compile(rb"(AKIA[A-Z0-9]+)"), 20),
    "hex": (re.compile(rb"([0-9a-f]{24,})"), 24),
}
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Stretches of these letters, with no letter beyond ASCII beside them, are candidates from this length on.
LETTERS = string.ascii_letters + string.digits + "+/_.=-"
SHORTEST = 16
CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_.=\-\x80-\xff])[A-Za-z0-9+/_.=-]{16,}+(?![\x80-\xff])")

#: Letter classes for a quick look: a document without a long stretch of either needs no pattern.
IS_HEX = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
IS_LETTER = bytes(116 if chr(b) in LETTERS else 32 for b in range(256))

#: Examples of each label: at most so many of the corpus, so many spelt out, none longer than this.
FIT_VALUES, SPELT, LONGEST = 400, 400, 200

#: Bits by which a format must explain a candidate better than words do: a letter, and in all.
BITS_A_LETTER, BITS = 1.75, 32.0

#: Bits of a letter that no ordinary word of the examples has in its place: small letters are likelier in words than others.
#: In a format they are 12 for letters of its examples; others it does not have.
UNKNOWN = {letter: 7.0 if letter.islower() else 12.0 for letter in LETTERS}

#: The Hoeffding bound's chance of keeping states apart that are alike.
ALPHA = 0.05

ALNUM, HEX, UPPER, URL = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-"

# Public credential formats, as parts that are either text or (alphabet, least, most letters).
FORMATS = {
    "assign": [[(ALNUM + "+/_-", 16, 44)]],
    "access": [["AKIA", (UPPER, 16, 16)]],
    "hex": [[(HEX, 24, 24)], [(HEX, 32, 32)], [(HEX, 40, 40)], [(HEX, 64, 64)]],
    "github": [[p, (ALNUM, 36, 36)] for p in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")] + [["github_pat_", (ALNUM, 22, 22), "_", (ALNUM, 59, 59)]],
    "gitlab": [["glpat-", (URL, 20, 20)]],
    "slack": [[p, ("0123456789", 11, 13), "-", ("0123456789", 11, 13), "-", (ALNUM, 24, 24)] for p in ("xoxb-", "xoxp-", "xoxa-")],
    "google": [["AIza", (URL, 35, 35)]],
    "stripe": [[p, (ALNUM, 24, 24)] for p in ("sk_live_", "rk_live_", "sk_test_")],
    "npm": [["npm_", (ALNUM, 36, 36)]],
    "sendgrid": [["SG.", (URL, 22, 22), ".", (URL, 43, 43)]],
    "jwt": [["eyJ", (URL, 17, 33), ".eyJ", (URL, 30, 80), ".", (URL, 43, 43)]],
}

#: Ordinary long words: numbers, dates, names of hosts and files, words of many parts.
WORDS = [
    [("0123456789", 16, 24)],
    [("0123456789", 4, 4), "-", ("01", 2, 2), "-", ("0123456789", 2, 2), "T", ("0123456789", 2, 2)],
    [("0123456789", 3, 3), "-", ("0123456789", 3, 4), "-", ("0123456789", 4, 8), "-", ("0123456789", 2, 4)],
    [("aeinrst", 3, 8), ".", ("aeinrst", 3, 9), ".", ("aeinrstcom", 2, 3), "/", ("aeinrst", 4, 12)],
    [("aeinrstlodu", 4, 9), "-", ("aeinrstlodu", 4, 9), "-", ("aeinrstlodu", 4, 9)],
    [("aeinrstlodu", 4, 9), "_", ("aeinrstlodu", 4, 9), "_", ("aeinrstlodu", 2, 9)],
    [("aeinrstlodu", 16, 24)],
    [("AEINRSTLODU", 16, 24)],
    [("ABCDFGMPST", 1, 1), ("aeinrstlodu", 3, 8), ("ABCDFGMPST", 1, 1), ("aeinrstlodu", 3, 8), ("ABCDFGMPST", 1, 1), ("aeinrstlodu", 3, 8)],
    [("/", 1, 1), ("aeinrst", 3, 6), "/", ("aeinrst", 3, 8), "/", ("aeinrst", 3, 8), ".", ("aeinrst", 2, 4)],
    [("=", 16, 60)], [("-", 16, 60)], [("_", 16, 60)], [(".", 16, 60)],
]
WORD = "word"

#: A format has states: for each its transitions {letter: (state, bits)} and the bits of ending there.
Automaton = list[tuple[dict[str, tuple[int, float]], float]]


def spelt(label: str, forms: list[list], number: int, seed: int = 0) -> list[str]:
    """Examples of a format by its rule; the same for every run."""
    rng = random.Random(f"{label}:{seed}")
    return ["".join(p if isinstance(p, str) else "".join(rng.choices(p[0], k=rng.randint(p[1], p[2]))) for p in forms[k % len(forms)]) for k in range(number)]


class Merging:
    """The prefix tree of examples, and the automaton that merging makes of it."""

    def __init__(self, examples: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.passed: list[dict[str, int]] = [{}]
        self.ended, self.count = [0], [0]
        for word in examples:
            state = 0
            for letter in word:
                self.count[state] += 1
                self.passed[state][letter] = self.passed[state].get(letter, 0) + 1
                if letter not in self.next[state]:
                    self.next[state][letter] = len(self.next)
                    self.next.append({})
                    self.passed.append({})
                    self.ended.append(0)
                    self.count.append(0)
                state = self.next[state][letter]
            self.count[state] += 1
            self.ended[state] += 1

    def alike(self, a: int, b: int) -> bool:
        """Whether two states, and those reached from both, could be one. What follows b is a tree."""
        n, m, todo = 0, 0, [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.count[a], self.count[b]
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound < 1:
                if abs(self.ended[a] / n - self.ended[b] / m) > bound:
                    return False
                for letter in self.passed[a].keys() | self.passed[b].keys():
                    if abs(self.passed[a].get(letter, 0) / n - self.passed[b].get(letter, 0) / m) > bound:
                        return False
            todo += [(self.next[a][x], self.next[b][x]) for x in self.next[b] if x in self.next[a]]
        return True

    def distance(self, a: int, b: int) -> float:
        n, m = self.count[a], self.count[b]
        return abs(self.ended[a] / n - self.ended[b] / m) + sum(abs(self.passed[a].get(x, 0) / n - k / m) - self.passed[a].get(x, 0) / n for x, k in self.passed[b].items())

    def fold(self, a: int, b: int) -> None:
        """Adds the tree of b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.ended[a] += self.ended[b]
            for letter, to in self.next[b].items():
                self.passed[a][letter] = self.passed[a].get(letter, 0) + self.passed[b][letter]
                if letter in self.next[a]:
                    todo.append((self.next[a][letter], to))
                else:
                    self.next[a][letter] = to

    def merged(self) -> Automaton:
        """States reached most often are looked at first."""
        known, new = [0], [(-self.count[to], to, 0, x) for x, to in self.next[0].items()]
        heapq.heapify(new)
        while new:
            _, state, parent, letter = heapq.heappop(new)
            if self.next[parent].get(letter) != state:
                continue
            fitting = [(self.distance(k, state), k) for k in known if self.alike(k, state)]
            if fitting:
                into = min(fitting)[1]
                self.next[parent][letter] = into
                self.fold(into, state)
            else:
                known.append(state)
            done = set(known)
            new = [(-self.count[to], to, k, x) for k in known for x, to in self.next[k].items() if to not in done]
            heapq.heapify(new)
        place = {state: k for k, state in enumerate(known)}
        out = []
        for state in known:
            n = self.count[state]
            out.append(({x: (place[to], -math.log2(self.passed[state][x] / n)) for x, to in self.next[state].items()}, -math.log2((self.ended[state] + 0.5) / (n + 1))))
        return out


def infer(examples: list[str]) -> Automaton:
    return Merging(sorted(w for w in examples if len(w) <= LONGEST)).merged()


def bits(automaton: Automaton, word: str, unknown: dict[str, float] | None = None) -> float:
    """The bits that the automaton takes for a word; a letter that it has not seen takes those in ``unknown`` and stays in the state."""
    state, total = 0, 0.0
    for letter in word:
        to, cost = automaton[state][0].get(letter) or (state, unknown.get(letter, math.inf) if unknown else math.inf)
        state, total = to, total + cost
        if total == math.inf:
            return total
    return total + automaton[state][1]


class Model:
    """The automata of all labels and of ordinary words."""

    def __init__(self, values: dict[str, list[str]]):
        examples = {label: values.get(label, []) + spelt(label, forms, SPELT) for label, forms in FORMATS.items()}
        self.formats = {label: infer(words) for label, words in examples.items()}
        self.letters = {label: dict.fromkeys(set().union(*words), 12.0) for label, words in examples.items()}
        self.words = infer(values.get(WORD, []) + spelt(WORD, WORDS, SPELT))
        self.known: dict[bytes, tuple[str, float] | None] = {}

    def score(self, word: bytes) -> tuple[str, float] | None:
        """(label, bits a letter gained over words) of a secret; None for anything else."""
        if word not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            text = word.decode()
            plain = bits(self.words, text, UNKNOWN)
            label, best = min(((label, bits(a, text, self.letters[label])) for label, a in self.formats.items()), key=lambda x: x[1])
            gain = plain - best
            self.known[word] = (label, gain / len(text)) if gain >= max(BITS, BITS_A_LETTER * len(text)) else None
        return self.known[word]


def base_spans(text: bytes) -> list[tuple[str, int, int, bytes]]:
    """(kind, start, end, value) of the base patterns' matches, in bytes; they never overlap within a kind."""
    out, lower = [], None
    for kind, (pattern, least) in BASE.items():
        if kind == "assign":
            lower = text.lower()
            if not any(k in lower for k in KEYWORDS):
                continue
        elif kind == "access" and b"AKIA" not in text or kind == "hex" and b"h" * least not in text.translate(IS_HEX):
            continue
        out += [(kind, *m.span(), m[1]) for m in pattern.finditer(text) if len(m[1]) >= least]
    return out


def candidates(text: bytes) -> Iterator[tuple[int, int]]:
    """Byte spans of stretches that may be credentials, without full stops at their ends."""
    if b"t" * SHORTEST in text.translate(IS_LETTER):
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            while end > start and text[end - 1] == 46:
                end -= 1
            if end - start >= SHORTEST:
                yield start, end


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The automata, from at most FIT_VALUES values of each kind (and as many words) of the corpus and the spelt ones.

    Values are taken by the least checksums over all documents, so the sample depends on neither order nor partitions.
    """

    def rows(pairs: Iterator[tuple]) -> Iterator[tuple]:
        best: dict[str, dict[str, int]] = {label: {} for label in (*BASE, WORD)}

        def take(label: str, value: bytes) -> None:
            if len(value) <= LONGEST:
                best[label][value.decode()] = zlib.crc32(value)
                if len(best[label]) >= 4 * FIT_VALUES:
                    best[label] = dict(heapq.nsmallest(FIT_VALUES, best[label].items(), key=lambda x: (x[1], x[0])))

        for _, text in pairs:
            spans = base_spans(text)
            for kind, _, _, value in spans:
                take(kind, value)
            for start, end in candidates(text):
                if not any(a < end and start < b for _, a, b, _ in spans):
                    take(WORD, text[start:end])
        for label, values in best.items():
            for value, rank in heapq.nsmallest(FIT_VALUES, values.items(), key=lambda x: (x[1], x[0])):
                yield label, value, rank

    found = materialize(map_texts(docs.withColumn("_none", F.lit(None).cast("bigint")), "_none", text, "label string, value string, rank bigint", rows), "values")
    return Model({label: [r.value for r in found.filter(F.col("label") == label).dropDuplicates(["value"]).orderBy("rank", "value").limit(FIT_VALUES).collect()] for label in (*BASE, WORD)})


def spans_of(text: bytes, model: Model) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, score) in code points, by start and kind; base spans have no score."""
    base = base_spans(text)
    found = [(a, b, list(BASE).index(kind), kind, None) for kind, a, b, _ in base]
    order = {label: k for k, label in enumerate(FORMATS)}
    for start, end in candidates(text):
        if not any(a <= start and end <= b for _, a, b, _ in base) and (hit := model.score(text[start:end])):
            found.append((start, end, order[hit[0]], *hit))
    ends, at, points = {}, 0, 0
    for place in sorted({p for f in found for p in f[:2]}):
        points += len(text[at:place].decode())
        ends[place], at = points, place
    return [(kind, ends[a], ends[b], score) for a, b, _, kind, score in sorted(found, key=lambda f: (f[0], f[2]))]


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): array of (kind, start, end, score) by start, then kind in the order of FORMATS.

    Places are code points, ends exclusive; score is null for base patterns and the bits a letter otherwise.
    A candidate inside a base span adds none. Null and empty texts have no spans; repeated rows stay repeated, null
    ids null; other columns are not looked at; an empty table gives no rows. Whole texts are read; nothing is shuffled.
    """

    def rows(pairs: Iterator[tuple]) -> Iterator[tuple]:
        for part in batched(pairs):
            for i, raw in part:
                yield i, [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(raw, model)]
        model.known.clear()

    return map_texts(docs, doc_id, text, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint, score: double>>", rows)


def of_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, fit(docs))
    base = F.filter("spans", lambda s: s["score"].isNull())
    counts = [F.size(F.filter(base, functools.partial(of_kind, kind))).cast("bigint").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
