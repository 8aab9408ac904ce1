"""Digests of byte ranges of any length: a tree of two levels, whose chunks are hashed by many tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk, and of one read.
CHUNK, READ = 64 << 20, 1 << 20


def chunks(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, start, end, number, from, to): the ranges of (path, start, end), cut into chunks; an empty range is one."""
    last = F.greatest(F.lit(0), F.ceil((F.col("end") - F.col("start")) / chunk) - 1).cast("bigint")
    rows = files.select("path", "start", "end").withColumn("number", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    begin = F.col("start") + F.col("number") * chunk
    return rows.withColumn("from", begin).withColumn("to", F.least(F.col("end"), begin + chunk))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the SHA-256 of each chunk, read in pieces; null where the file cannot be read or is shorter."""
    for batch in batches:
        out = []
        for path, start, stop in zip(*(batch[n].to_pylist() for n in ("path", "from", "to")), strict=True):
            sha, left = hashlib.sha256(), stop - start
            try:
                with open(path, "rb") as f:
                    f.seek(start)
                    while left and (data := f.read(min(READ, left))):
                        sha.update(data)
                        left -= len(data)
            except OSError:
                left = 1
            out.append(None if left else sha.digest())
        yield batch.append_column("digest", pa.array(out, pa.binary()))


def tree_digests(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, start, end, digest) of byte ranges (path, start, end): hex SHA-256 over the length and the chunks' SHA-256 in order.

    Ranges are equal under this digest exactly when they are under a plain one, for one size of chunk. A file
    is read by as many tasks as it has chunks; a range that cannot be read whole has a null digest. Null
    starts and ends give null digests; repeated rows count once; an empty table gives no rows.
    """
    known = files.filter("start is not null and end >= start").select("path", "start", "end").distinct()
    cut = chunks(known, chunk).repartition("path", "number")
    kinds = "path string, start bigint, end bigint, number bigint, from bigint, to bigint, digest binary"
    parts = cut.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in kinds.split(", ")[:-1]))).mapInArrow(hashed, kinds)
    whole = parts.groupBy("path", "start", "end").agg(F.array_sort(F.collect_list(F.struct("number", "digest"))).alias("all"), F.count_if(F.col("digest").isNull()).alias("missing"))
    text = F.concat((F.col("end") - F.col("start")).cast("string"), F.lit(":"), F.array_join(F.transform("all", lambda x: F.hex(x["digest"])), ""))
    found = whole.select("path", "start", "end", F.when(F.col("missing") == 0, F.sha2(text, 256)).alias("digest"))
    rest = files.select("path", "start", "end").distinct().filter("start is null or end is null or end < start").withColumn("digest", F.lit(None).cast("string"))
    return found.unionByName(rest.select(*(F.col(c).cast(t).alias(c) for c, t in found.dtypes)))
