"""Token files: whole documents' ids in coded blocks, in document order, and their reader.

A file is one partition of the id-ordered corpus: a sequence of blocks, each a row of a Parquet table
(file, block, first id's place in the file, documents' ids and lengths, coded bytes). Spark's writer
commits it as a whole, so a lost executor leaves no half-written file, and any store that Spark
reaches will do. Every block is decoded by itself, wherever it is read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinsift.llm import rangecoder
from kinsift.llm.bpe import LONG, UNSETTLED, Rules, batched, byte_letters, public_path, slices
from kinsift.llm.text import pack, release, utf8
from kinsift.operators.skew import join_small
from kinsift.storage import materialize

END = 1

#: Bytes of text whose distinct pieces are encoded together; longer texts are cut at white space and joined again.
TEXT = 8 << 20

#: Words that a worker keeps with their ids, and words in one text for the library, which is slower on longer ones.
WORDS, ASKED = 600_000, 50

#: Kinds of characters in the vocabulary file's rule: letters and others form runs, a digit is a word, and white space is
#: none. Settled characters, lower-cased, are below LOWERED.
SPACE, LETTER, DIGIT, OTHER = range(4)
LOWERED = 0x3000

#: Pieces that the rule's contractions or the library's own steps are for.
RULED = regex.compile(f"'|{UNSETTLED.pattern}")

FILES = "file int, block int, place bigint, doc_ids array<bigint>, lengths array<bigint>, data binary"


def _gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat that index names, one after the other, and their lengths."""
    counts = sizes.take(index)
    at = np.repeat(begins.take(index) - np.cumsum(counts) + counts, counts)
    at += np.arange(len(at))
    return flat.take(at), counts


def _spread(own: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _gather(), of stretches of ids given as bytes."""
    sizes = np.fromiter(map(len, own), np.int64, len(own)) >> 2
    return _gather(np.frombuffer(b"".join(own), "<u4"), np.cumsum(sizes) - sizes, sizes, index)


class Library:
    """The tokenizers library, asked once for each distinct word that its own splitting rule gives.

    Texts are cut at white space, which no token crosses, and Arrow finds the distinct pieces of a batch. These are cut
    into words by the rule in the vocabulary file, all at once, or by the library's normaliser and pre-tokeniser where
    they have characters that versions of Unicode see differently. The library encodes the words that are new, without its
    normaliser; special tokens are taken out before. Words stay known from task to task, WORDS at most.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.rules, self.letters = Rules(path), dict(enumerate(byte_letters()))
        self.letters[10] = " "  # stands between words; no word holds a line end
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # words are normalised and cut already: what is left of the library's steps is its model
        self.words = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        suffix, vocabulary = spec["model"]["end_of_word_suffix"], self.words.get_vocab()
        if not suffix:
            raise ValueError("not a vocabulary with word ends")
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}  # ids of words, the latest last
        points = "".join(map(chr, range(LOWERED)))
        self.kinds = np.full(LOWERED, OTHER, np.uint8)
        for kind, rule in ((LETTER, "\\p{L}"), (DIGIT, "\\p{N}"), (SPACE, "\\p{White_Space}")):
            self.kinds[[m.start() for m in regex.finditer(rule, points)]] = kind

    def ask(self, words: list[str]) -> list[bytes]:
        """The library's ids of words that are normalised and cut already, as the letters that stand for their bytes."""
        letters = "\n".join(words).encode().decode("latin-1").translate(self.letters).split(" ") if words else []
        texts = [" ".join(letters[a : a + ASKED]) for a in range(0, len(letters), ASKED)]
        ids: list[int] = []
        for a in range(0, len(texts), 50):
            for found in self.words.encode_batch_fast(texts[a : a + 50], add_special_tokens=False):
                ids += found.ids
        flat = np.array(ids, "<u4")
        ends = 4 * np.flatnonzero(self.final.take(flat)) + 4
        if len(ends) != len(letters):
            # a word is empty or has no end token of its own: one by one
            return [np.array([t.id for t in self.words.model.tokenize(word)], "<u4").tobytes() for word in letters]
        data = flat.tobytes()
        return [data[a:b] for a, b in pairwise([0, *ends.tolist()])]

    def shorten(self) -> None:
        """Forgets the words that have been known longest when there are more than WORDS."""
        if len(self.known) > WORDS:
            self.known = dict(islice(self.known.items(), len(self.known) - WORDS * 3 // 4, None))

    def plain(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of settled characters without an apostrophe, one after the other, and each piece's number of ids."""
        text = b"\n".join([*pieces, b""]).decode().lower()
        points, data = np.frombuffer(text.encode("utf-32-le"), "<u4"), text.encode()
        kind = self.kinds.take(points)
        begin = kind == DIGIT
        begin[0] = True
        begin[1:] |= kind[1:] != kind[:-1]
        begin = np.flatnonzero(begin)
        place = np.append(np.cumsum(1 + (points > 0x7F) + (points > 0x7FF), dtype=np.int32) if len(data) > len(points) else np.arange(1, len(points) + 1, dtype=np.int32), np.int32(0))
        offsets = np.append(place[begin - 1], np.int32(len(data)))
        full = kind[begin] != SPACE
        coded = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data)).filter(pa.array(full)).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.shorten()
        own = list(map(self.known.get, words))
        if missing := [k for k, x in enumerate(own) if x is None]:
            new = [words[k] for k in missing]
            for k, word, x in zip(missing, new, self.ask(new), strict=True):
                own[k] = x
                if len(word) <= LONG:
                    self.known[word] = x
        ids, counts = _spread(own, coded.indices.to_numpy(zero_copy_only=False))
        piece = np.cumsum(points == 10)[begin[full]]
        return ids, np.bincount(piece, counts, len(pieces)).astype(np.int64)

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct pieces in one array, where each piece's begin in it, and how many they are."""
        text = b"\n".join([*pieces, b""]).decode("utf-8", "replace")
        if slow := {text[text.rfind("\n", 0, m.start()) + 1 : text.index("\n", m.start())].encode() for m in RULED.finditer(text)}:
            kept: dict[bytes, bytes] = {}
            self.shorten()
            self.rules.learn(slow, kept, self.known, self.ask)
            self.known.pop("\n", None)
        flat, sizes = self.plain([b"" if p in slow else p for p in pieces] if slow else pieces) if pieces else (np.empty(0, "<u4"), np.empty(0, np.int64))
        begins = np.cumsum(sizes) - sizes
        if slow:
            at = [k for k, p in enumerate(pieces) if p in slow]
            own = [kept[pieces[k]] for k in at]
            sizes[at] = [len(x) // 4 for x in own]
            begins[at] = len(flat) + np.cumsum(sizes[at]) - sizes[at]
            flat = np.append(flat, np.frombuffer(b"".join(own), "<u4"))
        return flat, begins, sizes

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        return [x.tobytes() for x in self.arrays(texts)]

    def arrays(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text."""
        if len(texts) == 1 and len(texts[0]) > TEXT:
            return [np.concatenate([self._joined([part])[0] for part in slices(texts[0], TEXT)])]
        return self._joined(texts)

    def _joined(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's ids from those of the distinct pieces of all."""
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        coded = cut.flatten().dictionary_encode()
        flat, begins, sizes = self.learn(coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        ids, counts = _gather(flat, begins, sizes, coded.indices.to_numpy(zero_copy_only=False))
        ends = np.cumsum(counts)
        bounds = np.append(0, ends)[cut.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in pairwise(bounds)]


@functools.lru_cache(maxsize=1)
def library(path: str) -> Library:
    return Library(path)


def write(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = END, block: int = rangecoder.BLOCK) -> DataFrame:
    """Encodes every text, appends the end id, and writes the files; returns their table.

    Files are in ascending order of doc_id (nulls first; rows of one id by a hash of the text, then the text), so file
    and block numbers give the order of the corpus. Blocks hold whole documents, about ``block`` ids; a
    longer document is a block of its own. Null texts are empty: the end id alone.
    """
    path = path or public_path()
    out = StructType.fromDDL(FILES)
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True)

        def blocks() -> Iterator[tuple[list, list[np.ndarray]]]:
            names, held, size = [], [], 0
            coder = library(path)
            for part in batched(pairs(), TEXT):
                for (i, _), ids in zip(part, coder.arrays([t for _, t in part]), strict=True):
                    own = np.append(ids, np.uint32(end))
                    if held and size + len(own) > block:
                        yield names, held
                        names, held, size = [], [], 0
                    names.append(i)
                    held.append(own)
                    size += len(own)
            if held:
                yield names, held

        def rows() -> Iterator[tuple]:
            file, number, place, waiting = TaskContext.get().partitionId(), 0, 0, []

            def coded() -> Iterator[tuple]:
                nonlocal number, place
                for (names, held), data in zip(waiting, rangecoder.encode([np.concatenate(h).astype(np.int64) for _, h in waiting]), strict=True):
                    lengths = [len(h) for h in held]
                    yield file, number, place, names, lengths, data
                    number, place = number + 1, place + sum(lengths)

            for one in blocks():
                waiting.append(one)
                if len(waiting) == rangecoder.SIDE:
                    yield from coded()
                    waiting = []
            if waiting:
                yield from coded()

        yield from pack(rows(), kinds)
        release()

    ordered = docs.select(F.col(doc_id).cast("bigint").alias("_id"), utf8(text).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    ordered = ordered.repartitionByRange("_id", "_hash").sortWithinPartitions("_id", "_hash", "_text").drop("_hash")
    return materialize(ordered.mapInArrow(run, out), "tokens", compression="none")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids): every document's ids from the files, with the number of ids before it in the corpus."""
    sizes = files.groupBy("file").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n)).alias("_n"))
    # one row per file: a running sum over the files' sizes gives where each begins
    begins = sizes.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_begin"))
    placed = join_small(files, begins, "file").select((F.col("_begin") + F.col("place")).alias("start"), "doc_ids", "lengths", "data")
    out = StructType.fromDDL("doc_id bigint, start bigint, ids binary")
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                columns = [batch.column(k) for k in range(4)]
                for a in range(0, batch.num_rows, rangecoder.SIDE):
                    part = [c[a : a + rangecoder.SIDE].to_pylist() for c in columns]
                    for start, names, lengths, ids in zip(*part[:3], rangecoder.decode(part[3]), strict=True):
                        if sum(lengths) != len(ids):
                            raise ValueError("damaged block")
                        at = 0
                        for i, n in zip(names, lengths, strict=True):
                            yield i, start + at, ids[at : at + n].tobytes()
                            at += n

        yield from pack(rows(), kinds)
        release()

    return placed.mapInArrow(run, out)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
