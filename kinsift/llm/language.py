"""Language ID by unigram pieces whose segmentation is summed out.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, computed by the forward algorithm for many words
at once; a text's is the product over its words. The probabilities are fitted by expectation
maximisation (forward-backward over the same segmentations) on word counts of labelled documents.

A background, which knows how often each letter occurs in all languages together and nothing of their
order, stands for texts of no language: a text that it explains better than every language is of none.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.llm.bpe import batched, public_path
from kinsift.llm.text import map_texts, release
from kinsift.storage import materialize

VOCABULARY = "piece_bpe_32k.model"

#: Labelled documents that the model is fitted on, at most: those with the smallest hash of their id.
FIT_DOCUMENTS = 4000
#: Labels that may be learned; more are an error, as they would be dirty data.
LANGUAGES = 500
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Part of a language's probability that is shared by all pieces alike, and the probability of a letter that no piece has.
SMOOTH, UNKNOWN = 0.01, 1e-7
#: Part of the background's probability that all letters of the vocabulary share alike.
EVEN = 0.5
#: Probabilities of words of up to SHORT letters fit into a float when each letter counts 2**LIFT; longer ones are summed as logarithms.
SHORT, LIFT = 64, 10

#: A text of which no language is at least this likely, among those learned and the background, is not of any.
SURE = 0.5

START = "▁"


def words_of(text: str) -> list[str]:
    """Runs between white space, letters and their marks alone, in lower case, each with the mark of a word's
    start; runs without a letter are left out."""
    if text.isascii():
        return [START + w for w in text.translate(LETTERS).split()]
    return [START + w for x in text.lower().split() if (w := x if x.isalpha() else OTHERS.sub("", x)) and any(map(str.isalpha, w))]


#: ASCII letters in lower case, white space as it is, the rest deleted.
LETTERS = {c: chr(c).lower() if chr(c).isalpha() else (chr(c) if chr(c).isspace() else None) for c in range(128)}

OTHERS = regex.compile("[^\\p{L}\\p{M}]+")

#: Letters from which a word is summed on its own, a stretch of STEP places at a time, and sums that are held at once for shorter ones.
LONG, STEP, SUMS = 4096, 1 << 14, 1_600_000

#: Odd multiplier of the rolling hash of letters.
MIXER = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary's pieces of letters, found by hash in a table of open addresses that also holds their beginnings."""

    NOTHING, BEGINNING = -1, -2

    def __init__(self, path: str, bits: int = 20):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = sorted({p for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)) and all(c == START or (c.isalpha() and c == c.lower()) for c in p)})
        self.lengths = np.array([*map(len, self.names), 0])
        self.longest = int(self.lengths.max())
        entries = {p[:n]: self.BEGINNING for p in self.names for n in range(1, len(p))} | {p: n for n, p in enumerate(self.names)}
        self.bits, self.keys, self.ids = bits, np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.NOTHING, np.int32)
        taken = set()
        for entry, number in entries.items():
            h = np.zeros(1, np.uint64)
            for c in entry:
                h = self.step(h, np.uint64(ord(c)))
            h = int((h * MIXER)[0])
            if h in taken:
                raise ValueError("two pieces have one hash")
            taken.add(h)
            at = h >> (64 - bits)
            while self.ids[at] != self.NOTHING:
                at = (at + 1) & ((1 << bits) - 1)
            self.keys[at], self.ids[at] = h, number

    @staticmethod
    def step(h: np.ndarray, letters: np.ndarray) -> np.ndarray:
        h = (h ^ letters) * MIXER
        return h ^ (h >> np.uint64(29))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of pieces, BEGINNING for what only begins one, NOTHING otherwise."""
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        got, same = self.ids[at], self.keys[at] == hashes
        out = np.where(same, got, self.NOTHING)
        more = np.flatnonzero(~same & (got != self.NOTHING))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            got, same = self.ids[at[more]], self.keys[at[more]] == hashes[more]
            out[more[same]] = got[same]
            more = more[~same & (got != self.NOTHING)]
        return out

    def spans(self, letters: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """For words of one length, as a matrix of letters: for each (start, end), the words that have a piece there, and which."""
        out, (count, size) = {}, letters.shape
        for a in range(size):
            rows, h = np.arange(count), np.zeros(count, np.uint64)
            for b in range(a + 1, min(size, a + self.longest) + 1):
                h = self.step(h, letters[rows, b - 1])
                found = self.find(h * MIXER)
                hit, go = found >= 0, found != self.NOTHING
                if hit.any():
                    out[a, b] = rows[hit], found[hit]
                rows, h = rows[go], h[go]
                if not len(rows):
                    break
        return out


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def lifted(weights: np.ndarray, table: Pieces, size: int) -> tuple[np.ndarray, float, Callable, Callable]:
    """What forward and backward sums need for words of ``size`` letters: weights of pieces and of a letter that no
    piece has, how to add two sums and how to lengthen one. Long words use logarithms."""
    if size <= SHORT:
        return weights * 2.0 ** (LIFT * table.lengths[:, None]), UNKNOWN * 2.0**LIFT, np.add, np.multiply
    with np.errstate(divide="ignore"):
        return np.log(weights), float(np.log(UNKNOWN)), np.logaddexp, np.add


def forward(spans: dict, weights: np.ndarray, letter: float, plus: Callable, times: Callable, count: int, size: int, of: np.ndarray | None = None) -> np.ndarray:
    """The sum over all segmentations of each prefix: (size + 1, words, languages), or (size + 1, words) for one language of each word."""
    alpha = np.empty((size + 1, count) + (() if of is not None else (weights.shape[1],)))
    alpha[0] = times(1.0, 1.0) if times is np.multiply else 0.0
    by_end: dict[int, list[int]] = {}
    for a, b in spans:
        by_end.setdefault(b, []).append(a)
    for b in range(1, size + 1):
        alpha[b] = times(alpha[b - 1], letter)
        for a in by_end.get(b, ()):
            rows, found = spans[a, b]
            share = weights[found] if of is None else weights[found, of[rows]]
            alpha[b][rows] = plus(alpha[b][rows], times(alpha[a][rows], share))
    return alpha


def by_length(words: list[str], most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, letters) of words of one length at a time, of about ``most`` letters together."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(words) else ():
        size = int(sizes[places[0]])
        step = max(1, most // size)
        for a in range(0, len(places), step):
            part = places[a : a + step]
            flat = "".join(words[i] for i in part.tolist()).encode("utf-32-le")
            yield part, np.frombuffer(flat, "<u4").reshape(len(part), size).astype(np.uint64)


def log_long(word: str, table: Pieces, weights: np.ndarray, step: int = STEP) -> np.ndarray:
    """Log probability of one long word in each language: the pieces of ``step`` places at a time, and as many sums as a piece has letters."""
    letters = np.frombuffer(word.encode("utf-32-le"), "<u4")
    logs, letter, plus, _ = lifted(weights, table, SHORT + 1)
    kept = table.longest + 1
    sums = np.full((kept, weights.shape[1]), -np.inf)  # those of the places modulo kept
    sums[0] = 0.0
    ending: dict[int, list[tuple[int, int]]] = {}  # by end: start and piece
    for begin in range(0, len(letters), step):
        starts, h = np.arange(begin, min(begin + step, len(letters))), None
        for n in range(table.longest):
            starts = starts[starts + n < len(letters)]
            h = np.zeros(len(starts), np.uint64) if h is None else h[: len(starts)]
            h = table.step(h, letters[starts + n].astype(np.uint64))
            found = table.find(h * MIXER)
            for a, piece in zip(starts[found >= 0].tolist(), found[found >= 0].tolist(), strict=True):
                ending.setdefault(a + n + 1, []).append((a, piece))
            go = found != table.NOTHING
            if not go.any():
                break
            starts, h = starts[go], h[go]
        for end in range(begin + 1, min(begin + step, len(letters)) + 1):
            now = sums[(end - 1) % kept] + letter
            for a, piece in ending.pop(end, ()):
                now = plus(now, sums[a % kept] + logs[piece])
            sums[end % kept] = now
    return sums[len(letters) % kept]


def log_words(words: list[str], table: Pieces, weights: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over its segmentations. Memory does not grow with a word's length or the languages."""
    out = np.zeros((len(words), weights.shape[1]))
    long = [k for k, w in enumerate(words) if len(w) > LONG]
    for k in long:
        out[k] = log_long(words[k], table, weights)
    if long:
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        out[short] = log_words([words[k] for k in short], table, weights)
        return out
    for part, letters in by_length(words, min(400_000, SUMS // weights.shape[1])):
        ways = lifted(weights, table, letters.shape[1])
        last = forward(table.spans(letters), *ways, *letters.shape)[-1]
        out[part] = np.log(last) - np.log(2.0) * LIFT * letters.shape[1] if ways[2] is np.add else last
    return out


def log_letters(words: list[str], background: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """Log probability of each word by the background: known letters in order, their logs, and that of any other letter."""
    known, logs, rest = background
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    each = np.where(known[at] == flat, logs[at], rest)
    return np.add.reduceat(each, np.cumsum([0, *map(len, words[:-1])])) if words else np.zeros(0)


def expected(words: list[str], language: np.ndarray, times: np.ndarray, table: Pieces, weights: np.ndarray) -> np.ndarray:
    """Expected number of each piece in each language (pieces, languages) over words seen ``times`` times."""
    counts, n = np.zeros(weights.shape), weights.shape[1]
    for part, letters in by_length(words):
        spans, (count, size), of = table.spans(letters), letters.shape, language[part]
        share, letter, plus, mul = lifted(weights, table, size)
        alpha = forward(spans, share, letter, plus, mul, count, size, of)
        beta = np.empty_like(alpha)
        beta[size] = alpha[0]
        by_start: dict[int, list[int]] = {}
        for a, b in spans:
            by_start.setdefault(a, []).append(b)
        for a in range(size - 1, -1, -1):
            beta[a] = mul(beta[a + 1], letter)
            for b in by_start.get(a, ()):
                rows, found = spans[a, b]
                beta[a][rows] = plus(beta[a][rows], mul(beta[b][rows], share[found, of[rows]]))
        for (a, b), (rows, found) in spans.items():
            through = mul(mul(alpha[a][rows], share[found, of[rows]]), beta[b][rows])
            part_of = through / alpha[size][rows] if plus is np.add else np.exp(through - alpha[size][rows])
            counts += np.bincount(found * n + of[rows], weights=part_of * times[part][rows], minlength=counts.size).reshape(counts.shape)
    return counts


def normal(counts: np.ndarray) -> np.ndarray:
    """Probabilities from counts, with a row of zeros last, for no piece."""
    total = np.maximum(counts.sum(0), 1e-300)
    out = (1 - SMOOTH) * counts / total + SMOOTH / (len(counts) - 1)
    out[-1] = 0
    return out


@dataclass
class Model:
    """Languages in order, probabilities (pieces and a row of zeros, languages), and the background."""

    languages: list[str]
    weights: np.ndarray
    background: tuple[np.ndarray, np.ndarray, float]


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None, documents: int = FIT_DOCUMENTS, rounds: int = ROUNDS) -> Model:
    """The model, fitted on the rows of at most ``documents`` ids with a label and a text.

    Which ids is decided by their hash, so reruns agree; repeated rows count as often as they stand. Word
    counts are a table; each round computes expected pieces from it in Spark, and what reaches the
    driver has at most one row per language and piece of the fixed vocabulary, and one per letter. An
    empty table, or one without labels, gives a model of no language. More than LANGUAGES labels are an error.
    """
    path = path or public_path(VOCABULARY)
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    chosen = usable.select(F.col(doc_id).alias("_chosen")).distinct().orderBy(F.xxhash64("_chosen"), "_chosen").limit(documents)
    sample = usable.join(F.broadcast(chosen), F.col(doc_id).eqNullSafe(F.col("_chosen")), "left_semi").select(F.col(text).alias("_text"), F.col(lang).alias("_lang"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole, label in zip(batch.column(0), batch.column(1), strict=True):
                seen: dict[str, int] = {}
                for w in (w[k : k + LONG] for w in words_of(whole.as_py()) for k in range(0, len(w), LONG)):  # longer ones count in parts
                    seen[w] = seen.get(w, 0) + 1
                if seen:
                    yield pa.record_batch({"word": list(seen), "lang": [label.as_py()] * len(seen), "n": pa.array(list(seen.values()), pa.int64())})

    words = materialize(sample.mapInArrow(cut, "word string, lang string, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n")), "words")
    languages = sorted(r[0] for r in words.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels in {lang}")
    table = pieces(path)
    if not languages:
        return Model([], np.zeros((len(table.names) + 1, 0)), (np.zeros(0, np.uint32), np.zeros(0), 0.0))
    letters = words.select(F.explode(F.split("word", "")).alias("letter"), "n").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    letters = sorted((ord(r.letter), r.n) for r in letters if len(r.letter) == 1)
    total = sum(n for _, n in letters)
    alike = EVEN / len({*"".join(table.names), *(chr(c) for c, _ in letters)})
    background = np.array([c for c, _ in letters], np.uint32), np.log([(1 - EVEN) * n / total + alike for _, n in letters]), float(np.log(alike))
    number = {x: k for k, x in enumerate(languages)}
    weights = normal(np.ones((len(table.names) + 1, len(languages))))
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                total = total + expected(batch.column(0).to_pylist(), np.array([number[x] for x in batch.column(1).to_pylist()], np.int64), batch.column(2).to_numpy().astype(float), pieces(path), shared.value)
            if isinstance(total, np.ndarray):
                piece, language = np.nonzero(total)
                yield pa.record_batch({"piece": piece.astype(np.int64), "language": language.astype(np.int64), "n": total[piece, language]})

        got = words.mapInArrow(run, "piece bigint, language bigint, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(weights)
        counts[got["piece"], got["language"]] = got["n"]
        weights = normal(counts)
    return Model(languages, weights, background)


class Scorer:
    """Sums log probabilities of texts' words, each distinct word computed once while it is kept."""

    def __init__(self, path: str, model: Model, most: int = 100_000):
        self.table, self.model, self.most = pieces(path), model, most
        self.kept: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages) + 1))

    def score(self, texts: list[str]) -> list[np.ndarray | None]:
        """Log probability of each text by language and, last, by the background; None without a letter."""
        cut = [words_of(t) for t in texts]
        new = set().union(*cut).difference(self.kept)
        if len(self.kept) + len(new) > self.most:
            self.kept, self.rows, new = {}, self.rows[:0], set().union(*cut)
        if new:
            fresh = sorted(new)
            self.kept.update(zip(fresh, range(len(self.kept), len(self.kept) + len(fresh)), strict=True))
            logs = np.column_stack([log_words(fresh, self.table, self.model.weights), log_letters(fresh, self.model.background)])
            self.rows = np.concatenate([self.rows, logs])
        return [self.rows[np.fromiter(map(self.kept.__getitem__, w), np.int64, len(w))].sum(0) if w else None for w in cut]

    def best(self, texts: list[str]) -> list[tuple[int, float] | None]:
        """The likeliest language of each text and its share of the probability, the background's included; None without a letter."""
        if not self.model.languages:
            return [None for _ in texts]
        out: list[tuple[int, float] | None] = []
        for logs in self.score(texts):
            if logs is None:
                out.append(None)
                continue
            first = int(logs[:-1].argmax())
            out.append((first, float(1 / np.exp(np.minimum(logs - logs[first], 700)).sum())))
        return out


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the text alone.

    score is the predicted language's share of the probability of the text over the learned languages
    and the background, so it is small for texts of no language. Null texts and texts without a letter
    are ``und`` with score 0, as is every text when no language was learned. Ties go to the first
    language in alphabetical order. Repeated rows stay repeated, null ids stay null, an empty table gives
    no rows. Nothing is shuffled; the model, a row per piece of the fixed vocabulary, is broadcast.
    """
    path = path or public_path(VOCABULARY)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(pairs: Iterator[tuple]) -> Iterator[tuple]:
        scorer = Scorer(path, shared.value)
        for part in batched(pairs, 1 << 20):
            for (i, _), got in zip(part, scorer.best([x.decode("utf-8", "replace") for _, x in part]), strict=True):
                yield (i, "und", 0.0) if got is None else (i, model_languages[got[0]], got[1])

    model_languages = list(model.languages)
    return map_texts(docs, doc_id, text, "doc_id bigint, lang_pred string, score double", rows)


def keep(docs: DataFrame, model: Model, text: str = "text", sure: float = SURE, path: str | None = None) -> DataFrame:
    """docs without the rows that are of no learned language: no letter, or no language with a share of ``sure``
    among the languages and the background.

    All columns and rows pass through the task that scores them, so nothing is shuffled or joined; repeated
    rows go or stay alike, an empty table stays empty. If no language was learned, the rows with a letter stay.
    """
    path = path or public_path(VOCABULARY)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(path, shared.value)
        for batch in batches:
            texts = ((k, (x.as_py() or "").encode()) for k, x in enumerate(batch.column(at)))
            for part in batched(texts, 1 << 20):
                held = [x.decode() for _, x in part]
                if scorer.model.languages:
                    stays = [got is not None and got[1] >= sure for got in scorer.best(held)]
                else:
                    stays = [bool(words_of(x)) for x in held]
                yield batch.slice(part[0][0], len(part)).filter(pa.array(stays, pa.bool_()))
        del scorer
        release()

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
