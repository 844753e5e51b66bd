"""Media columns: payloads stored as WAV, read back by the wave module, with spectral-peak pair fingerprints.

A short-time Fourier transform gives a magnitude for each frame and frequency. In each block of BLOCK frames the PEAKS
strongest local maxima over frequency stay; of equally strong ones the first by frame, then by bin. Magnitudes count to
DIGITS decimal places, so that builds of numpy that differ in the last bits agree. Each peak is paired with the next FAN ones
in time; a pair of two frequencies and the frames between them is one fingerprint, stored as (pair << 32) | first frame.

Each row stands alone, so nothing is shuffled and a media column may be of any number of rows. Samples are transformed in
passes of bounded length, so a long recording needs little more memory than its bytes.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.common import each

RATE, FRAME, HOP, BLOCK, PEAKS, FAN, DIGITS = 8_000, 192, 96, 16, 4, 3, 6
#: Blocks of frames transformed in one pass.
PASS = 64
_WINDOW = np.hanning(FRAME)


def to_wav(payload: bytes) -> bytes:
    """Mono, 8 bits a sample."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        if (file.getnchannels(), file.getsampwidth()) != (1, 1):
            raise ValueError("mono WAV with 8-bit samples expected")
        return file.readframes(file.getnframes())


def pad(text: bytes, to: int = FRAME) -> bytes:
    """text and spaces up to the next positive multiple of to."""
    return text + b" " * (max(1, -(-len(text) // to)) * to - len(text))


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, frequency bin) of the strongest local maxima of each block, by frame, then bin."""
    n = (len(samples) - FRAME) // HOP + 1
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    at, bins = [], []
    for first in range(0, n, BLOCK * PASS):
        part = frames[first : first + BLOCK * PASS]
        magnitude = np.round(np.abs(np.fft.rfft((part.astype(np.float64) - 128) * _WINDOW, axis=1)), DIGITS)
        inner = magnitude[:, 1:-1]
        inner = np.where((inner > magnitude[:, :-2]) & (inner >= magnitude[:, 2:]), inner, 0)
        short = -len(inner) % BLOCK
        if short:
            inner = np.concatenate([inner, np.zeros((short, inner.shape[1]))])
        flat = inner.reshape(len(inner) // BLOCK, -1)
        best, height = np.empty((len(flat), PEAKS), np.int64), np.empty((len(flat), PEAKS))
        rows = np.arange(len(flat))
        for k in range(PEAKS):  # argmax gives the first of equals
            best[:, k] = flat.argmax(axis=1)
            height[:, k] = flat[rows, best[:, k]]
            flat[rows, best[:, k]] = 0
        order = np.argsort(best, axis=1, kind="stable")
        best, height = np.take_along_axis(best, order, axis=1), np.take_along_axis(height, order, axis=1)
        block, column = np.nonzero(height > 0)
        place = best[block, column]
        at.append(first + block * BLOCK + place // inner.shape[1])
        bins.append(place % inner.shape[1] + 1)
    return np.concatenate(at).astype(np.int64), np.concatenate(bins).astype(np.int64)


def fingerprints(payload: bytes) -> np.ndarray:
    """Time-coded peak pairs of 8-bit samples, in order of time."""
    frame, bin_ = peaks(np.frombuffer(payload, np.uint8))
    out = [((bin_[:-k] << 24 | bin_[k:] << 16 | np.minimum(frame[k:] - frame[:-k], 0xFFFF)) << 32) | frame[:-k] for k in range(1, FAN + 1) if len(frame) > k]
    if not out:
        return np.zeros(0, np.int64)
    joined = np.concatenate(out)
    return joined[np.argsort(joined & 0xFFFFFFFF, kind="stable")]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in each(batches):
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            raw = [x.as_py().encode() for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(pad(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary) for each row of docs (doc_id, text): the UTF-8 bytes as a WAV payload, padded with spaces
    to a positive multiple of 192; n_bytes is the length before. Null text counts as empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in each(batches):
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            media = part.column(part.num_columns - 1)
            payloads = [from_wav(x.as_py()) for x in media]
            prints = [fingerprints(x) for x in payloads]
            ends = np.cumsum([0, *map(len, prints)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prints)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary()), lists], [*part.schema.names, "payload", "fingerprints"])


def read_media(stored: DataFrame) -> DataFrame:
    """stored (doc_id, n_bytes, media) with payload binary, as read back, and fingerprints array<long>."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, media binary, payload binary, fingerprints array<long>")


def media_digest(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text) that sums up its media column; further columns are ignored, an empty table
    gives an empty result, equal texts give equal values."""
    kept = F.length("payload").cast("long")
    return read_media(store_texts(docs)).select(
        "doc_id",
        "n_bytes",
        kept.alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.size("fingerprints").cast("string"), F.lit(":"), F.sha2(F.array_join(F.col("fingerprints").cast("array<string>"), ",").cast("binary"), 256)).alias("feature"),
    )
