"""Where a media file's content lies between its tags, and digests of that region.

One Arrow job reads each file once, in the task that has it, and gives start, end and digest. A file
that is damaged, unknown or too short has no region and never fails the job.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Least bytes of a region; bytes read at a time.
LEAST, CHUNK = 4096, 1 << 20

Region = tuple[int, int] | None


class Bytes:
    """Random access to a file's bytes: held in memory, or opened by path and read piece by piece."""

    def __init__(self, source: bytes | str):
        self.file = io.BytesIO(source) if isinstance(source, bytes) else open(source, "rb")  # noqa: SIM115
        self.size = self.file.seek(0, 2)

    def at(self, place: int, n: int) -> bytes:
        self.file.seek(max(0, place))
        return self.file.read(n)

    def number(self, place: int, n: int, order: str) -> int:
        return int.from_bytes(self.at(place, n), order)

    def quick(self, window: int = 65536) -> str:
        """Digest of the length and of the first and last ``window`` bytes; the tail only beyond twice the window."""
        tail = self.at(self.size - window, window) if self.size > 2 * window else b""
        return hashlib.sha256(str(self.size).encode() + self.at(0, window) + tail).hexdigest()

    def digest(self, start: int, end: int) -> str:
        h = hashlib.sha256()
        for a in range(start, end, CHUNK):
            h.update(self.at(a, min(CHUNK, end - a)))
        return h.hexdigest()


def mpeg(data: Bytes) -> Region:
    """Between an ID3v2 tag before and ID3v1, APEv2 and Lyrics3v2 tags behind, which are taken off in this order."""
    start, end = 0, data.size
    head = data.at(0, 10)
    if len(head) == 10 and head.startswith(b"ID3"):
        length = sum((b & 127) << shift for b, shift in zip(head[6:], (21, 14, 7, 0), strict=True))
        start = length + (20 if head[5] & 16 else 10)
    if end - start > 128 and data.at(end - 128, 3) == b"TAG":
        end -= 128
    if end - start > 32 and data.at(end - 32, 8) == b"APETAGEX":
        header = 32 if data.number(end - 12, 4, "little") >> 31 else 0
        taken = data.number(end - 20, 4, "little") + header
        end -= taken if 0 < taken < end - start else 0
    if end - start > 15 and data.at(end - 9, 9) == b"LYRICS200":
        digits = data.at(end - 15, 6)
        if digits.strip().isdigit() and 0 < (taken := int(digits) + 15) < end - start:
            end -= taken
    return start, end


def flac(data: Bytes, most: int = 256) -> Region:
    """Behind the metadata block that is marked as the last."""
    place = 4 if data.at(0, 4) == b"fLaC" else data.size
    for _ in range(most):
        head = data.at(place, 4)
        if len(head) < 4:
            return None
        place += 4 + int.from_bytes(head[1:], "big")
        if head[0] & 128:
            return place, data.size
    return None


def mp4(data: Bytes, most: int = 64) -> Region:
    """Inside the first ``mdat`` box."""
    place = 0
    for _ in range(most):
        head = data.at(place, 16)
        if len(head) < 8:
            return None
        size, skip = int.from_bytes(head[:4], "big"), 8
        if size == 1:
            size, skip = int.from_bytes(head[8:], "big"), 16
        elif size == 0:
            size = data.size - place
        if head[4:8] == b"mdat":
            return place + skip, min(place + size, data.size)
        if size < 8:
            return None
        place += size
    return None


def wav(data: Bytes, most: int = 64) -> Region:
    """Inside the ``data`` chunk; chunks of odd length are followed by a byte of filling."""
    head = data.at(0, 12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    place = 12
    for _ in range(most):
        head = data.at(place, 8)
        if len(head) < 8:
            return None
        size = int.from_bytes(head[4:], "little")
        if head[:4] == b"data":
            return place + 8, min(place + 8 + size, data.size)
        place += 8 + size + size % 2
    return None


#: Rules by extension.
RULES: dict[str, Callable[[Bytes], Region]] = {".mp3": mpeg, ".aac": mpeg, ".flac": flac, ".m4a": mp4, ".m4b": mp4, ".mp4": mp4, ".wav": wav}


def region_of(source: bytes | str, ext: str, digest: bool = True) -> tuple[int, int, str | None] | None:
    """(start, end, digest) of a file's content without tags; None if there is no rule or no region of LEAST bytes."""
    rule = RULES.get(ext)
    try:
        data = Bytes(source) if rule else None
        found = rule(data) if data and data.size else None
        if not found or found[0] < 0 or found[1] > data.size or found[1] - found[0] < LEAST:
            return None
        return *found, data.digest(*found) if digest else None
    except (OSError, ValueError):
        return None


def regions(files: DataFrame, content: str | None = "content", digest: bool = True) -> DataFrame:
    """(file_id, start, end, digest), null without a region, of files (file_id, ext, and content or path).

    Without a content column each task opens the paths it has, which must be on a file system that
    executors mount; large files are read in pieces. Without ``digest`` only what tells the bounds is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [region_of(source.as_py(), ext.as_py(), digest) if source.is_valid else None for ext, source in zip(batch.column(1), batch.column(2), strict=True)]
            cells = [[None if f is None else f[k] for f in found] for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.int64()), pa.array(cells[2], pa.string())], names=["file_id", "start", "end", "digest"])

    source = F.col(content).cast("binary") if content else F.col("path")
    return files.select(F.col("file_id").cast("bigint"), "ext", source.alias("source")).mapInArrow(run, "file_id bigint, start bigint, end bigint, digest string")


def read_survivors(files: DataFrame, same: list[str], name: str = "digest") -> DataFrame:
    """Files (file_id, path, size, ...) that share ``same`` with another, with one more column: ``quick``, the
    quick signature, or ``digest``, of the whole file, null if it cannot be read. The others are never opened."""
    if name not in ("quick", "digest"):
        raise ValueError(f"no such signature: {name}")
    shared = files.groupBy(*same).count().filter("count > 1").drop("count")
    left = files.join(shared, same, "left_semi").select("file_id", "path", "size", *(c for c in same if c != "size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(1).to_pylist():
                try:
                    data = Bytes(path)
                    found.append(data.quick() if name == "quick" else data.digest(0, data.size))
                except OSError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, name])

    return left.mapInArrow(run, StructType([*left.schema.fields, StructField(name, StringType())]))
