"""Substring dedup by joining indexed phrases, in place of a relative Lempel-Ziv parse.

The reference is the whole corpus, indexed by its phrases of WINDOW words: each phrase with the
smallest document that has it. A phrase belongs to the block that its anchor names: the smallest hash
among the short word runs inside the phrase, so every copy of a phrase, in any document, lands in the
same block. Every phrase of a document is looked up; a factor is a run of neighbouring phrases with
the same earliest document. Factors are at least WINDOW words long and are the duplicate spans. No
place in the source is kept and no longest match is sought, so they are not Lempel-Ziv factors: one
may join passages from several places of its source, and one ends where the earliest document changes.

Word hashes only choose anchors; in the index a phrase is a BLAKE2 digest of its words, so that no
other phrase passes for it. Phrases whose anchor stands in one document alone cannot repeat. That is found
first, from one row per anchor, and only the rest is indexed. Identical texts are parsed once: all
words of a later copy are covered by the first one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinsift.llm.text import pack, utf8
from kinsift.storage import materialize

WINDOW, ANCHOR = 13, 4

#: A phrase is hot if at least 1/HOT_SHARE of all distinct texts have it, and as many as leave at most HOT_ROWS such
#: phrases, as there are no more phrases than half the bytes of all texts. Their table is broadcast, at 20 bytes a phrase.
HOT_SHARE, HOT_ROWS = 200, 100_000

NULL_ID = (1 << 63) - 1

MIXER, FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

#: Bytes of a word that are mixed eight at a time; longer words are hashed one by one.
STEPWISE = 64
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Phrases:
    """Hashes of words, of anchors and of whole phrases, for a whole text at a time."""

    def __init__(self, window: int = WINDOW, anchor: int = ANCHOR):
        self.window, self.anchor = window, anchor

    def hashes(self, text: bytes) -> np.ndarray:
        """A hash of every word, eight bytes mixed in at a time."""
        letters = np.frombuffer(text, np.uint8)
        blank = (letters == 32) | ((letters >= 9) & (letters <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([1], blank.view(np.int8), [1]))))
        start, size = edge[::2], edge[1::2] - edge[::2]
        eight = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))  # the eight bytes from each place on
        h = size.astype(np.uint64) * FINAL
        each, done = np.flatnonzero(size <= STEPWISE), 0
        while len(each):
            left = size[each] - done
            mixed = (h[each] ^ (eight[start[each] + done] & MASKS[np.minimum(left, 8)])) * MIXER
            h[each] = mixed ^ (mixed >> np.uint64(29))
            each, done = each[left > 8], done + 8
        for k in np.flatnonzero(size > STEPWISE).tolist():
            h[k] = xxhash.xxh64_intdigest(text[start[k] : start[k] + size[k]], 1)
        return h * MIXER

    def digests(self, words: list[bytes], places: np.ndarray) -> np.ndarray:
        """64 bits of a BLAKE2 digest of the words of the phrase at each place."""
        each = (hashlib.blake2b(b" ".join(words[p : p + self.window]), digest_size=8).digest() for p in places.tolist())
        return np.frombuffer(b"".join(each), "<i8")

    @staticmethod
    def runs(h: np.ndarray, size: int) -> np.ndarray:
        """A hash of every ``size`` consecutive words."""
        n = len(h) - size + 1
        out = np.zeros(max(0, n), np.uint64)
        for k in range(size if n > 0 else 0):
            out ^= h[k : k + n]
            out *= MIXER
            out ^= out >> np.uint64(29)
        return out * FINAL

    def anchors(self, h: np.ndarray) -> np.ndarray:
        """The anchor of every phrase, 48 bits: a sliding minimum, by doubling."""
        if len(h) < self.window:
            return np.zeros(0, np.int64)
        least, size, wide = self.runs(h, self.anchor) >> np.uint64(16), 1, self.window - self.anchor + 1
        while 2 * size <= wide:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        n = len(h) - self.window + 1
        return np.minimum(least[:n], least[wide - size : wide - size + n]).astype(np.int64)


def factors(place: np.ndarray, source: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and source of each factor; of each indexed phrase, from the left: its place and earliest document."""
    first = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 1) | (np.diff(source) != 0)))[: len(place)])
    last = np.append(first[1:], len(place)) - 1
    return place[first], place[last[: len(first)]] - place[first] + window, source[first]


def _long(batches_schema: str, each):
    """For mapInArrow: ``each`` gives arrays of a row; they leave in batches of about 50,000 rows."""
    kinds = to_arrow_schema(StructType.fromDDL(batches_schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, held, size = Phrases(), [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                got = each(phrases, *(batch.column(c)[k] for c in range(batch.num_columns)))
                if len(got[0]):
                    held.append(got)
                    size += len(got[0])
                if size >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    return run


def parse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, kept, factors) for every row: the words that stay, joined by one space, in UTF-8,
    and the duplicate spans (first word, words, source document).

    A word goes if a phrase that covers it also starts in a document with a smaller id. Null texts have
    no words. Null ids count as larger than all others and as one document. Rows that repeat an id are
    parsed one by one and are no sources for each other. Texts shorter than a phrase stay whole. Other
    columns are not looked at. An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NULL_ID)).alias("id"), utf8(text).alias("body"), F.col(doc_id).isNull().alias("nameless"))
    taken = not docs.filter(F.col(doc_id) == NULL_ID).isEmpty()  # the id that stands for none is a real one, too
    plain = rows.groupBy("id").count().filter("count > 1").isEmpty()
    rows = rows.withColumn("own", F.lit(0).cast("bigint") if plain else F.xxhash64("body"))  # tells rows of one id apart
    key = ["id"] if plain else ["id", "own"]
    kinds = "id bigint" if plain else "id bigint, own bigint"
    # the first row of each distinct text
    texts = rows.select("id", "own", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("bigint").alias("size"))
    kept = materialize(texts.groupBy("digest").agg(F.min(F.struct("id", "own")).alias("f"), F.max("size").alias("size")).select("f.*", "size"), "first")
    number, size = kept.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    first = kept.select(*key).distinct()
    # all passes read the same columns, so that texts are shuffled once
    rows = rows.select(*key, "body", *(["nameless"] if taken else []))

    def spread(ids: list, n: int) -> list[np.ndarray]:
        return [np.full(n, x.as_py(), np.int64) for x in ids]

    def anchors_of(phrases: Phrases, *row) -> list[np.ndarray]:
        found = np.unique(phrases.anchors(phrases.hashes(row[-1].as_py())))
        return [found, *spread(row[:-1], len(found))]

    def indexed_of(phrases: Phrases, *row) -> list[np.ndarray]:
        body, shared = row[-2].as_py(), row[-1].values.to_numpy(zero_copy_only=False)
        anchors = phrases.anchors(phrases.hashes(body))
        later = np.isin(anchors, ~shared[shared < 0])
        place = np.flatnonzero(later | np.isin(anchors, shared[shared >= 0]))
        keys, once = np.unique(phrases.digests(body.split(), place), return_index=True)  # a phrase once per document
        place = place[once]
        return [(anchors[place] & 0xFFFFFFFF).astype(np.uint32).view(np.int32), keys, *spread(row[:-2], len(keys)), later[place]]

    found = f"anchor bigint, {kinds}"
    anchors = rows.join(first, key).select(*key, "body").mapInArrow(_long(found, anchors_of), found)
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("lo"), F.count("*").alias("n")).filter("n > 1").select(F.col("anchor").alias("both"), "lo")
    # of a document's shared anchors, those that an earlier one has too are negated: only their phrases can be copies
    lists = anchors.join(shared, F.col("anchor") == F.col("both")).groupBy(*key).agg(F.collect_list(F.when(F.col("lo") < F.col("id"), F.bitwise_not("anchor")).otherwise(F.col("anchor"))).alias("anchors"))
    found = f"block int, phrase bigint, {kinds}, later boolean"
    index = rows.join(lists, key).select(*key, "body", "anchors").mapInArrow(_long(found, indexed_of), found)
    phrase = [F.col("block").alias("b"), F.col("phrase").alias("p")]
    earliest = index.groupBy("block", "phrase").agg(F.min("id").alias("source"), F.count("*").alias("n")).select(*phrase, "source", "n")
    # a phrase of very many documents is looked up in a broadcast table, its rows dealt out evenly
    least = max(2, -(-number // HOT_SHARE), -(-size // (2 * HOT_ROWS)))
    hot = earliest.filter(F.col("n") >= least).select(F.col("b").alias("hot_b"), F.col("p").alias("hot_p"), F.col("source").alias("hot_source"))
    seek = index.filter("later").drop("later").join(F.broadcast(hot), (F.col("block") == F.col("hot_b")) & (F.col("phrase") == F.col("hot_p")), "left")
    seek = seek.withColumn("way", F.when(F.col("hot_source").isNotNull(), F.xxhash64("id", "phrase")).otherwise(F.col("phrase")))
    cold = earliest.filter((F.col("n") < least) & (F.col("n") > 1)).drop("n")
    hits = seek.join(cold, (F.col("block") == F.col("b")) & (F.col("way") == F.col("p")), "left").withColumn("source", F.coalesce("hot_source", "source")).filter("source < id")
    spans = hits.groupBy(*key).agg(F.collect_list(F.struct("phrase", "source")).alias("hits"))
    todo = first.join(spans, key, "left").select(*key, F.coalesce("hits", F.array().cast("array<struct<phrase:bigint,source:bigint>>")).alias("hits"))
    whole = rows.join(todo, key, "left").select(F.when(~F.col("nameless") if taken else F.col("id") != NULL_ID, F.col("id")).alias("id"), "body", "hits")  # no list at all: a later copy
    out = StructType.fromDDL("doc_id bigint, n_words bigint, n_kept bigint, kept binary, factors array<struct<start:bigint,words:bigint,source:bigint>>")
    shape = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases()

        def tuples() -> Iterator[tuple]:
            for batch in batches:
                for i, body, hits in zip(*batch.columns, strict=True):
                    words = body.as_py().split()
                    if not hits.is_valid:
                        spans = [(0, len(words), None)] if len(words) >= WINDOW else []
                    elif len(hits):
                        known, source = (hits.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                        order, keys = np.argsort(known), phrases.digests(words, np.arange(len(words) - WINDOW + 1))
                        at = order[np.minimum(np.searchsorted(known, keys, sorter=order), len(known) - 1)]
                        place = np.flatnonzero(known[at] == keys)
                        spans = list(zip(*(x.tolist() for x in factors(place, source[at[place]])), strict=True))
                    else:
                        spans = []
                    stays, size = bytearray(b"\1") * len(words), len(words)
                    for start, n, _ in spans:
                        stays[start : start + n] = bytes(n)
                    words = list(compress(words, stays)) if spans else words
                    yield i.as_py(), size, len(words), b" ".join(words), [{"start": a, "words": n, "source": x} for a, n, x in spans]

        yield from pack(tuples(), shape)

    return whole.mapInArrow(run, out)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", (F.col("n_words") - F.col("n_kept")).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select doc_id, unnest(range(1, len(w) - 11)) as i, w from d where len(w) >= 13),
h as (select doc_id, i, array_to_string(w[i:i+12], ' ') as p from g),
f as (select p, min(doc_id) as source from h group by p),
r as (select distinct doc_id, unnest(range(i, i + 13)) as i from h join f using (p) where source < doc_id),
k as (select doc_id, list(i) as gone from r group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(array_to_string(list_filter(w, lambda x, j: not list_contains(coalesce(gone, []), j)), ' ')) as kept_sha256
from d left join k using (doc_id)
"""
