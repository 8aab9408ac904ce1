"""Near-dedup of whole texts by SimHash, MinHash and shared rare shingles: five-word shingles, Jaccard similarity of at least 0.8.

Every pair of texts that is near is found, or its texts are linked without it. First, cheap candidates link most of what is near:
fingerprints of the shingle sets that multi-index hashing finds within two bits, and 20 keys of five minima each, which two texts at
0.8 share with probability 0.9996. The members of a key are compared with one of them only, so a large group of copies costs one
comparison for each member and key.

What these miss is found exactly, by prefix filtering. Two sets of similarity 0.8 share four fifths of the larger one. So if
all shingles are put in one order, the first of those that they share is among the first fifth (and one more) of each. Texts that
have such a shingle in common are compared, unless earlier links join them, or sizes, places or odd sketches (whose distance is never
larger than that of the sets) rule the similarity out. The order puts shingles last that a sample finds frequent: it decides how many pairs are compared, never what is found. A pair
counts only when the similarity of its shingle sets, computed in full, is high enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.llm import simhash
from kinsift.llm.text import LOWER, map_texts, renamed, restored
from kinsift.operators.components import connected_components
from kinsift.operators.skew import attach, join_small
from kinsift.storage import materialize

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42

#: Keys of a text, and minima in each.
BANDS, MINIMA = 20, 5

#: Members of a shingle's bucket beyond which all are compared with one of them, and then with another, before the pairs that are left.
ALL_PAIRS, LAST_PAIRS = 32, 256

#: One text in so many is looked at for frequent shingles, of which the order knows at most so many.
SAMPLE, FREQUENT = 8, 200_000

#: 64-bit words of an odd sketch.
WORDS = 8

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * MINIMA, 1), np.uint32)
XOR, TIMES = _DRAWN[0], _DRAWN[1] | np.uint32(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, "<u8")
    each = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in each), "<u8"))


def band_keys(grams: np.ndarray, step: int = 2048) -> list[int]:
    """Keys of a shingle set as signed 64-bit integers; none for an empty set."""
    if not len(grams):
        return []
    low, least = (grams >> np.uint64(32)).astype(np.uint32), np.full(BANDS * MINIMA, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), step):
        mixed = (low[None, start : start + step] ^ XOR) * TIMES
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        np.minimum(least, mixed.min(1), out=least)
    rows = least.reshape(BANDS, MINIMA)
    return [_signed(xxhash.xxh64_intdigest(rows[k].tobytes(), k)) for k in range(BANDS)]


def fingerprint(grams: np.ndarray, step: int = 1 << 15) -> int:
    """SimHash of a shingle set; 0 for an empty one."""
    return simhash.majority(sum((simhash.bit_sums(grams[k : k + step]) for k in range(0, len(grams), step)), np.zeros(64, np.int64)), len(grams))


def _signed(h: int) -> int:
    return h - (h >> 63 << 64)


def frequent(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes that several texts of a sample have, sorted, with how many do: at most FREQUENT of them, the most frequent."""

    def sets(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, x in rows:
            yield (shingles(x).view("<i8").tolist(),)

    whole = F.coalesce(F.col(text), F.lit(""))
    some = docs.filter(F.pmod(F.xxhash64(whole), F.lit(SAMPLE)) == 0).select(F.lit(0).alias("_none"), text)
    grams = map_texts(some, "_none", text, "grams array<bigint>", sets).select(F.explode("grams").alias("gram"))
    counted = materialize(grams.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "frequent")
    least, total = None, 0
    for n, shared in sorted(map(tuple, counted.groupBy("n").count().collect()), reverse=True):
        total += shared
        if total > FREQUENT:
            break
        least = n
    if least is None:
        return np.empty(0, "<u8"), np.empty(0, np.int64)
    found = counted.filter(F.col("n") >= least).toArrow()
    grams, n = found["gram"].to_numpy().astype("<i8").view("<u8"), found["n"].to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def first_grams(grams: np.ndarray, known: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first fifth (and one more) of a shingle set, rare ones first: a set that is near shares one of its own first fifth with it."""
    n = len(grams)
    if not n:
        return grams
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        grams = grams[np.argsort(np.where(known[at] == grams, often[at], 0), kind="stable")]
    return grams[: n + 1 + -4 * n // 5]


def odd_sketch(grams: np.ndarray) -> np.ndarray:
    """Bits that an odd number of shingles fall on. Two sketches differ in no more bits than their sets do in shingles."""
    hit = np.bincount((grams % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(hit.astype(np.uint8), bitorder="little").view("<i8")


def sketches(docs: DataFrame, doc_id: str, text: str, known: np.ndarray | None = None, often: np.ndarray | None = None) -> DataFrame:
    """(doc_id, own, node, fp, bands, size, odd, first) of every row: Spark's xxhash64 of the text, a hash of its shingle set, its
    fingerprint, its keys, the number of its shingles, their odd sketch and the first of them in an order by how often they occur."""
    known, often = (np.empty(0, "<u8"), np.empty(0, np.int64)) if known is None else (known, often)

    def rows(pairs: Iterator[tuple]) -> Iterator[tuple]:
        for i, x in pairs:
            grams = shingles(x)
            node, first = _signed(xxhash.xxh64_intdigest(grams.tobytes(), SEED)), first_grams(grams, known, often)
            yield i, _signed(xxhash.xxh64_intdigest(x, 42)), node, fingerprint(grams), band_keys(grams), len(grams), odd_sketch(grams).tolist(), first.view("<i8").tolist()

    return map_texts(docs, doc_id, text, "doc_id bigint, own bigint, node bigint, fp bigint, bands array<bigint>, size bigint, odd array<bigint>, first array<bigint>", rows)


def near_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough, by the sets themselves."""

    def sets(rows: Iterator[tuple]) -> Iterator[tuple]:
        for node, x in rows:
            yield node, shingles(x).view("<i8").tolist()

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("uses"))
    wanted = materialize(nodes.select("node", "own").join(ends, "node"), "ends")
    texts = join_small(docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own"), F.col(text).alias("text")), wanted.select("own", "node"), "own").dropDuplicates(["node"])
    grams = map_texts(texts, "node", "text", "node bigint, grams array<bigint>", sets)
    grams = materialize(grams.join(wanted.select("node", "uses"), "node"), "grams")
    total = 2 * pairs.count()
    for end, other in (("a", "b"), ("b", "a")):
        pairs = attach(pairs, grams.withColumnRenamed("node", end), end, F.col(other), "uses", ["grams"], total).withColumnRenamed("grams", f"grams_{end}")
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    return pairs.filter(9 * both >= 4 * (F.size("grams_a") + F.size("grams_b"))).select("a", "b")  # both of all at SIMILARITY, in whole numbers


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): candidates of op 6. Nodes of one fingerprint with the smallest of them, and the smallest of linked fingerprints."""
    at = F.struct("rank", "node").alias("at")
    leads = materialize(nodes.filter(F.size("bands") > 0).select("fp", at).groupBy("fp").agg(F.min("at").alias("lead"), F.count("*").alias("n")), "leads")
    total = leads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    same = attach(nodes.select("fp", at), leads.filter("n > 1"), "fp", F.col("at.node"), "n", ["lead"], total).filter("at <> lead").select(F.col("lead").alias("a"), F.col("at").alias("b"))
    found = simhash.links(leads.select("fp"))
    for end in ("a", "b"):
        found = found.join(leads.select(F.col("fp").alias(end), F.col("lead").alias(f"lead_{end}")), end)
    across = found.select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b"))
    return same.union(across)


def may_be_near(a: str, b: str) -> Column:
    """Whether sizes and odd sketches of two nodes allow the similarity: a ninth of both sizes may be apart."""
    x, y = (lambda name, end=end: F.col(f"{end}.{name}") for end in (a, b))
    apart = sum((F.bit_count(x("odd")[k].bitwiseXOR(y("odd")[k])) for k in range(1, WORDS)), F.bit_count(x("odd")[0].bitwiseXOR(y("odd")[0])))
    return (5 * F.least(x("size"), y("size")) >= 4 * F.greatest(x("size"), y("size"))) & (9 * apart <= x("size") + y("size"))


def still_open(rows: DataFrame, joined: DataFrame | None, lead: Column) -> DataFrame:
    """rows (key, node, ...) of keys whose nodes are not all linked yet, with each node's part and that member of the key
    for which ``lead`` is smallest."""
    rows = rows.withColumn("part", F.col("node")) if joined is None else rows.join(joined, F.col("node") == F.col("_node"), "left").withColumn("part", F.coalesce("part", "node")).drop("_node")
    rows = materialize(rows, "live")
    lead = F.min(F.struct(lead.alias("order"), "node", "part")).alias("lead")
    found = rows.groupBy("key").agg(F.min("part").alias("one"), F.max("part").alias("other"), lead).filter("one <> other")
    return rows.join(materialize(found.select("key", "lead"), "open"), "key")


def linked(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(_node, part): the smallest node that near pairs lead to, for nodes (node, own, rank, fp, bands, size, odd, first) that have any."""
    firsts = nodes.select("node", "size", F.posexplode("first").alias("place", "key"))
    held = materialize(firsts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = materialize(firsts.join(held, "key"), "shared")
    looks = nodes.select("node", "size", "odd")

    def plausible(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")
        both = pairs.join(looks.alias("x"), F.col("a") == F.col("x.node")).join(looks.alias("y"), F.col("b") == F.col("y.node"))
        return both.filter(may_be_near("x", "y")).select("a", "b")

    def join(pairs: DataFrame, joined: DataFrame | None) -> DataFrame:
        found = near_pairs(materialize(pairs, "pairs"), nodes, docs, text)
        if joined is not None:  # what was linked before goes in as stars, so that only new pairs cost rounds
            found = joined.filter("part <> _node").select(F.col("part").alias("a"), F.col("_node").alias("b")).union(found)
        return materialize(connected_components(found, "a", "b").select(F.col("node").alias("_node"), F.col("component").alias("part")), "joined")

    large = lambda least: shared.filter(F.col("n") > least).select("key", "node")
    stars = lambda rows, joined, lead: still_open(rows, joined, lead).filter("lead.part <> part").select(F.col("lead.node").alias("a"), F.col("node").alias("b"))
    cheap = stars(nodes.select(F.explode("bands").alias("key"), "node").union(large(ALL_PAIRS)), None, F.col("node"))
    joined = join(plausible(cheap.union(by_fingerprint(nodes).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))), None)
    joined = join(plausible(stars(large(LAST_PAIRS), joined, F.xxhash64("node", "key"))), joined)
    # all that is left: pairs not linked yet that share one of their first shingles, at places that allow the similarity
    left = still_open(shared.select("key", "node", "place"), joined, F.col("node")).drop("lead")
    left = materialize(left.join(looks, "node"), "left")
    a, b = left.alias("a"), left.alias("b")
    after = 9 * F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place")) >= 4 * (F.col("a.size") + F.col("b.size"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.part") != F.col("b.part")) & after & may_be_near("a", "b"))
    return join(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), joined)


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, own, component_id) of every row: the smallest id that near pairs lead to."""
    rows = materialize(sketches(docs, doc_id, text, *frequent(docs, text)), "sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min("own").alias("own"), *(F.first(c).alias(c) for c in ("fp", "bands", "size", "odd", "first")))
    nodes = materialize(nodes.withColumn("rank", F.coalesce("least", F.lit((1 << 63) - 1))), "nodes")
    parts = nodes.join(linked(nodes, docs, text), F.col("node") == F.col("_node"), "left").select("node", "least", "n", F.coalesce("part", "node").alias("part"))
    ids = parts.groupBy("part").agg(F.min("least").alias("component_id"))
    table = materialize(parts.join(ids, "part").select("node", "n", "component_id"), "components")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return attach(rows.select("doc_id", "own", "node"), table, "node", F.col("doc_id"), "n", ["component_id"], total).select("doc_id", "own", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component of near texts: the one with the smallest id. Rows with a null id stay.

    Texts without words are near each other. Rows go by id and text, so that of an id with several
    texts only the near copies leave; rows repeated whole stay together. All columns pass through, whatever
    their names. An empty table gives no rows.
    """
    drop = components(docs, doc_id, text).filter("component_id < doc_id").select(F.col("doc_id").alias("_drop"), F.col("own").alias("_own")).distinct()
    docs, names = renamed(docs)
    same = (F.col(names[doc_id]) == F.col("_drop")) & (F.xxhash64(F.coalesce(F.col(names[text]), F.lit(""))) == F.col("_own"))
    return docs.join(drop, same, "left_anti").select(restored(names))
