"""Words and columns that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words of the contracts, as a Java and RE2 pattern. bytes.split() splits UTF-8 at the same six bytes.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Lower-cases the ASCII letters of UTF-8 and leaves every other byte.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def utf8(text: str) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns under names that no operator uses for its own, and those names by the old ones."""
    names = {name: f"in_{k}" for k, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(names: dict[str, str]) -> list[Column]:
    """The columns of renamed() under their own names again."""
    return [F.col(new).alias(old) for old, new in names.items()]


def map_texts(docs: DataFrame, doc_id: str, text: str, schema: str, rows: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Runs ``rows`` over (id, UTF-8 bytes) of every document, in Arrow batches, without a shuffle.

    ``rows`` gets one iterator for the partition and yields tuples in the schema's order; its state
    lives for the partition. Output leaves in batches of at most 2,000 rows or about 16 MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True)

        yield from pack(rows(pairs()), kinds)
        release()

    out = StructType.fromDDL(schema)
    kinds = to_arrow_schema(out)
    return docs.select(F.col(doc_id).cast("bigint").alias("_id"), utf8(text).alias("_text")).mapInArrow(run, out)


def release() -> None:
    """Gives what a partition has freed back to the system: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def pack(rows: Iterator[tuple], kinds: pa.Schema, most: int = 2000, heavy: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples to record batches of bounded size."""

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, type=k.type) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str, list)))
        if len(held) >= most or weight >= heavy:
            yield batch(held)
            held, weight = [], 0
    if held:
        yield batch(held)
