"""BPE encoding and decoding with batched numpy merge rounds.

Texts are cut at ASCII white space, which no token of the vocabulary crosses, and each distinct
piece is encoded once per batch. The words of all new pieces lie in one flat symbol array; a round
looks up the rank of every adjacent pair by binary search over the sorted pair keys, finds each
word's lowest rank, and merges that pair everywhere in the word. Words without a known pair leave
the array, so rounds shrink.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from kinsift.llm.text import map_texts

VOCABULARY = "word_bpe_49k.json"

#: Entries of each of a worker's two tables, of encoded pieces and of words, and bytes of the longest key that stays in
#: one: together they bound its memory. Beyond KEPT the longer ones go, which are the rare ones.
KEPT, LONG = 120_000, 24

#: Stands between the ids of pieces; no id is as large, and ids leave zero bytes that keep it from appearing across two.
GAP = b"\xff" * 4

#: Bytes of text whose new pieces are encoded together; longer texts are cut at white space and joined again.
BATCH = 1 << 20

#: Pieces with other characters than these go through the library's own normaliser and pre-tokeniser (those that may
#: hold a special token, too). The class and the lower case of the rest are the same in all versions of Unicode, and none combines.
UNSETTLED = regex.compile("[^\x00-\u024f\u2010-\u2027]|<\\|")


def public_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Rules:
    """How a vocabulary file of the tokenizers library normalises texts and cuts them into words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace("\\s", "\\p{White_Space}") + "|\\n")
        bare = spec | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.library = Tokenizer.from_str(json.dumps(bare))  # normaliser and pre-tokeniser alone
        self.bytes_of = {ord(c): b for b, c in enumerate(byte_letters())}
        self.setup(spec)

    def setup(self, spec: dict) -> None:
        """What a subclass takes from the vocabulary file, which is not kept."""

    def words_of(self, piece: str) -> list[str]:
        """The words of one piece without special tokens, by the library."""
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [word.translate(self.bytes_of).encode("latin-1").decode() for word, _ in cut]

    def learn(self, pieces: Iterable[bytes], kept: dict[bytes, bytes], known: dict[str, bytes], ask: Callable[[list[str]], list[bytes]]) -> None:
        """Puts the ids of pieces into kept. known has the ids of words; ask gives those of new ones."""
        plain, rare, special = list(pieces), [], []
        text = b"\n".join([*plain, b""]).decode("utf-8", "replace")
        if odd := {text[text.rfind("\n", 0, m.start()) + 1 : text.index("\n", m.start())].encode() for m in UNSETTLED.finditer(text)}:
            plain = [p for p in plain if p not in odd]
            for piece in odd:
                (special if b"<|" in piece and self.split_special.search(piece.decode()) else rare).append(piece)
            text = b"\n".join([*plain, b""]).decode("utf-8", "replace")
        words = self.words.findall(text.lower())
        for piece in rare:
            words += [*self.words_of(piece.decode()), "\n"]
        new = list(set(words).difference(known, ("\n",)))
        known.update(zip(new, ask(new), strict=True))
        known["\n"] = GAP
        kept.update(zip(chain(plain, rare), b"".join(map(known.__getitem__, words)).split(GAP)))
        for word in new:
            if len(word) > LONG:
                del known[word]
        for piece in special:
            own = b""
            for k, part in enumerate(self.split_special.split(piece.decode())):
                if k % 2:
                    own += self.special[part].to_bytes(4, "little")
                elif part:
                    self.learn([part.encode()], kept, known, ask)
                    own += kept[part.encode()]
            kept[piece] = own


class Bpe(Rules):
    """A vocabulary file of the tokenizers library: BPE with word ends, lower case, NFC."""

    def setup(self, spec: dict) -> None:
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        letters = byte_letters()
        self.inside = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        self.base = 1 << max(*vocab.values(), *self.special.values()).bit_length()
        # A pair's merge may come only after those that make its sides: then merging all places of
        # the lowest pair at once is the same as merging them one by one.
        made = {c: -1 for x in letters for c in (x, x + end)}
        for rank, (a, b) in enumerate(merges):
            if made.get(a, rank) >= rank or made.get(b, rank) >= rank:
                raise ValueError(f"merge {rank} comes before one that makes its sides")
            made.setdefault(a + b, rank)
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        self.kept: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}  # ids of words

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and where each word starts in it."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.inside[flat], np.repeat(np.arange(len(words)), sizes)
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[flat[last]]
        none = len(self.merged)
        done = []
        while len(symbols):
            keys = np.where(word[:-1] == word[1:], symbols[:-1] * self.base + symbols[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, keys), none - 1)
            rank = np.append(np.where(self.keys[at] == keys, self.ranks[at], none), none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            if (over := least == none).any():
                done.append((word[over], symbols[over]))
                go = ~over
                symbols, word, rank, least = symbols[go], word[go], rank[go], least[go]
            hits = np.flatnonzero(rank == least) if len(symbols) else np.empty(0, np.int64)
            if not len(hits):
                break
            # of overlapping places (x x x) every second one, from the left
            run = np.maximum.accumulate(np.where(np.append(True, np.diff(hits) != 1), np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
            symbols[hits] = self.merged[rank[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            symbols, word = symbols[keep], word[keep]
        where, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, np.int64),) * 2
        order = np.argsort(where, kind="stable")
        return ids[order].astype("<u4"), np.searchsorted(where[order], np.arange(len(words) + 1))

    def ask(self, words: list[str]) -> list[bytes]:
        ids, starts = self.merge([w.encode() for w in words])
        return [ids[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        shorten(self.known)
        return encode_pieces(texts, self.kept, lambda new: self.learn(new, self.kept, self.known, self.ask))

    def forget(self) -> None:
        self.kept, self.known = {}, {}

    def decode(self, ids: bytes) -> bytes:
        """As the library without a decoder: the tokens, special ones too, joined by spaces, in UTF-8."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def shorten(kept: dict, new: int = 0) -> None:
    """Takes out the longer keys when kept and ``new`` more entries are over KEPT; all, if that leaves half of it."""
    if len(kept) + new > KEPT:
        for key in [k for k in kept if len(k) > 6]:
            del kept[key]
        if 2 * len(kept) > KEPT:
            kept.clear()


def slices(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of at most ``most`` bytes, or one piece, whose pieces are those of the text."""
    while len(text) > most:
        at = next((k for k in range(most, 0, -1) if text[k - 1] in b" \t\n\v\f\r"), 0)
        at = at or next((k for k in range(most, len(text)) if text[k] in b" \t\n\v\f\r"), len(text))
        yield text[:at]
        text = text[at:]
    yield text


def encode_pieces(texts: list[bytes], kept: dict[bytes, bytes], learn: Callable[[set[bytes]], None]) -> list[bytes]:
    """Joins the ids of each text's pieces, which ``learn`` puts into ``kept`` when they are new."""
    if len(texts) == 1:
        return [b"".join(_joined([part], kept, learn)[0] for part in slices(texts[0], BATCH))]
    return _joined(texts, kept, learn)


def _joined(texts: list[bytes], kept: dict[bytes, bytes], learn: Callable[[set[bytes]], None]) -> list[bytes]:
    cut = [t.split() for t in texts]
    new = set().union(*cut).difference(kept)
    shorten(kept, len(new))
    new = new.union(*cut).difference(kept) if new else new
    if new:
        learn(new)
    out = [b"".join(map(kept.__getitem__, pieces)) for pieces in cut]
    for piece in new:
        if len(piece) > LONG:
            del kept[piece]
    return out


def batched(pairs: Iterator[tuple], most: int = BATCH) -> Iterator[list[tuple]]:
    """Documents in lists of about ``most`` bytes of text; a longer one stands alone."""
    held, size = [], 0
    for pair in pairs:
        if held and size + len(pair[1]) > most:
            yield held
            held, size = [], 0
        held.append(pair)
        size += len(pair[1])
        if size >= most or len(held) >= 4096:
            yield held
            held, size = [], 0
    if held:
        yield held


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): each row's token ids (binary, little-endian unsigned 32-bit).

    Special tokens in a text are found as the library finds them; none are added. Null texts count as
    empty and have no ids. Repeated rows stay repeated, null ids stay null, other columns are not
    looked at. An empty table gives no rows. Nothing is shuffled.
    """
    path = path or public_path()

    def rows(pairs: Iterator[tuple]) -> Iterator[tuple]:
        bpe = load(path)
        for part in batched(pairs):
            yield from zip((i for i, _ in part), bpe.encode([t for _, t in part]), strict=True)
        bpe.forget()

    return map_texts(docs, doc_id, text, "doc_id bigint, ids binary", rows)


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, decoded): the texts that ids decode to, in UTF-8; null ids count as none."""
    path = path or public_path()

    def rows(pairs: Iterator[tuple]) -> Iterator[tuple]:
        bpe = load(path)
        for i, x in pairs:
            yield i, bpe.decode(x)

    return map_texts(encoded, doc_id, ids, "doc_id bigint, decoded binary", rows)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() reduced to digests inside the task."""
    path = path or public_path()

    def rows(pairs: Iterator[tuple]) -> Iterator[tuple]:
        bpe = load(path)
        for part in batched(pairs):
            for (i, _), ids in zip(part, bpe.encode([t for _, t in part]), strict=True):
                yield i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()
        bpe.forget()

    return map_texts(docs, doc_id, text, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", rows)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
