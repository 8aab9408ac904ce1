"""Audio features: media columns, polyphase resampling, overlapped log-mel filterbanks, hysteresis segments.

Media are stored once, as a table of WAV files with 8-bit samples, and read back. Features of a
recording leave its task as an Arrow stream whose tensor column has a fixed shape, each tensor with
its time span.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kinsift.llm.text import map_texts, pack
from kinsift.storage import materialize

RATE, UNIT = 16_000, 576
UP, DOWN, TAPS = 5, 8, 8
FRAME, HOP, MELS, TILE = 320, 160, 24, 32
OPEN_DB, CLOSE_DB = 1.5, 0.5

#: Samples or frames that are worked on at a time, so that a long recording needs little more than itself.
STEP = 1 << 15


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of one channel of unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) % 2)


def samples_of(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a RIFF file, chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        if name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    """payload with bytes 255 up to a positive multiple of unit."""
    return payload + b"\xff" * (max(unit, -(-len(payload) // unit) * unit) - len(payload))


@functools.lru_cache(maxsize=4)
def polyphase(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """Weights from the window of inputs around a block of ``down`` samples to its ``up`` outputs.

    Output m stands at input m * down / up; it takes the inputs within ``taps`` periods of the lower
    rate, weighted by a Hann-windowed sinc. Column m of the result is one phase of the filter.
    """
    wide = taps * max(1, -(-down // up))
    at = np.arange(-wide, down + wide)[:, None] - np.arange(up)[None, :] * down / up
    cut = min(1.0, up / down)
    reach = taps / cut
    h = np.sinc(at * cut) * np.where(abs(at) < reach, 0.5 + 0.5 * np.cos(np.pi * at / reach), 0)
    return (h / h.sum(0)).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up/down of its rate: every block of ``down`` samples times the phases, a matrix product."""
    h = polyphase(up, down)
    wide = (len(h) - down) // 2
    blocks = -(-len(x) // down)
    x = np.pad(x, (wide, blocks * down - len(x) + wide))
    out = np.empty((blocks, up), np.float32)
    view = np.lib.stride_tricks.sliding_window_view(x, len(h))[::down]
    for a in range(0, blocks, STEP):
        out[a : a + STEP] = np.ascontiguousarray(view[a : a + STEP], np.float32) @ h
    return out.reshape(-1)


@functools.lru_cache(maxsize=4)
def filterbank(rate: float, size: int, mels: int) -> tuple[np.ndarray, np.ndarray]:
    """Hann window and triangular filters, evenly spaced on the mel scale, over the spectrum's bins."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(size // 2 + 1)[:, None] * rate / size
    up, down = (f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])
    return np.hanning(size + 1)[:-1].astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray, rate: float, size: int = FRAME, hop: int = HOP, mels: int = MELS) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and each frame's energy in dB, both rounded to 1/64; the last frame is filled with zeros."""
    window, bank = filterbank(rate, size, mels)
    n = 1 + max(0, -(-(len(x) - size) // hop))
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, max(0, (n - 1) * hop + size - len(x)))), size)[::hop]
    out, energy = np.empty((n, mels), np.float32), np.empty(n, np.float32)
    for a in range(0, n, STEP // 8):
        part = view[a : a + STEP // 8]
        power = np.abs(np.fft.rfft(part * window, axis=1)) ** 2
        out[a : a + len(part)] = np.log(power @ bank + 1e-6)
        energy[a : a + len(part)] = 10 * np.log10(np.square(part).mean(1) + 1e-9)
    return np.round(out * 64) / 64, np.round(energy * 64) / 64


def active(energy: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB) -> list[tuple[int, int]]:
    """Runs of frames that begin above the median by open_db and end when they fall below it by less than close_db."""
    over = energy - np.median(energy)
    sign = np.where(over >= open_db, 1, np.where(over < close_db, -1, 0))
    last = np.maximum.accumulate(np.where(sign != 0, np.arange(len(sign)), -1))
    on = (last >= 0) & (sign[last] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tensors(frames: np.ndarray, seconds: float, tile: int = TILE) -> bytes:
    """An Arrow stream of fixed-shape tensors (tile x mels), each with its time span and its number of real frames."""
    n, mels = frames.shape
    tiles = -(-n // tile)
    full = np.zeros((tiles * tile, mels), np.float32)
    full[:n] = frames
    kind = pa.fixed_shape_tensor(pa.float32(), [tile, mels])
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), tile * mels)
    first = np.arange(tiles) * tile
    held = np.minimum(tile, n - first)
    batch = pa.record_batch({"start_s": first * seconds, "end_s": (first + held) * seconds, "frames": held.astype(np.int32), "log_mel": pa.ExtensionArray.from_storage(kind, storage)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def analyse(media: bytes, up: int = UP, down: int = DOWN) -> tuple[bytes, bytes, int, list[tuple[float, float]]]:
    """Samples, tensor stream, number of frames and active spans in seconds of one WAV file."""
    rate, samples = samples_of(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    frames, energy = log_mel(resample(x, up, down), rate * up / down)
    seconds = HOP * down / (up * rate)
    return samples, tensors(frames, seconds), len(frames), [(a * seconds, b * seconds) for a, b in active(energy)]


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as a WAV file in a Parquet table that is
    written to the shared folder and read back. Null texts are empty; nothing is shuffled."""

    def rows(pairs: Iterator[tuple]) -> Iterator[tuple]:
        for i, x in pairs:
            yield i, len(x), wav(padded(x))

    return materialize(map_texts(docs, doc_id, text, "doc_id bigint, n_bytes bigint, media binary", rows), "media")


def features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, n_frames, segments, tensors).

    segments: active spans in seconds; tensors: the Arrow stream of ``tensors()``. Recordings are
    analysed one by one, so equal media have equal values whatever stands beside them.
    """
    out = StructType.fromDDL("doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, n_frames bigint, segments array<struct<start_s:double,end_s:double>>, tensors binary")
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (v.as_py() for v in batch.column(2)), strict=True):
                    samples, stream, frames, spans = analyse(x)
                    yield i, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(x), hashlib.sha256(x).hexdigest(), frames, [{"start_s": a, "end_s": b} for a, b in spans], stream

        yield from pack(rows(), kinds)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, out)


def op1_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature: frames, active segments and the digest of the tensor stream."""
    found = features(store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    name = F.concat_ws(":", F.col("n_frames").cast("string"), F.size("segments").cast("string"), F.sha2("tensors", 256))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", name.alias("feature"), "n_frames", F.size("segments").cast("bigint").alias("n_segments"))
