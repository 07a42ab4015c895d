"""Media columns: texts stored as WAV, short-time spectra, spectral-peak pair fingerprints.

`to_media` stores each document's bytes, padded with 255 to a positive multiple of `FRAME`, as unsigned 8-bit mono
samples through the `wave` module, reads the stored form back and fingerprints what it read: a Hann-windowed Fourier
transform of `WINDOW` samples every `HOP`, the `PEAKS` strongest bins of each from `LOWEST` on, and pairs of a frame's strongest bin (the anchor) with
the peaks of the next `FAN` frames. Fingerprints are two arrays: the anchor's frame number and the packed pair.

Null text counts as empty; an empty text is 576 bytes of padding. Equal texts give equal columns, in any batch.
Repeated rows stay repeated. Long texts are transformed `CHUNK` frames at a time.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table

FRAME, WINDOW, HOP, RATE, LOWEST, PEAKS, FAN, CHUNK = 576, 288, 192, 8000, 4, 3, 2, 4096
SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, fp_time array<int>, fp_code array<int>"


def store(data: bytes) -> bytes:
    """A WAV file of the padded bytes."""
    pad = FRAME if not data else -len(data) % FRAME
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data + b"\xff" * pad)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(payload: bytes) -> np.ndarray:
    """The strongest bins of each frame, strongest first, ties to the lower bin: frames x PEAKS."""
    x = np.lib.stride_tricks.sliding_window_view(np.frombuffer(payload, np.uint8), WINDOW)[::HOP]
    window = np.hanning(WINDOW).astype(np.float32)
    out = np.empty((len(x), PEAKS), np.int32)
    for i in range(0, len(x), CHUNK):
        part = x[i : i + CHUNK].astype(np.float32)
        part -= part.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(part * window, axis=1))[:, LOWEST:]
        # Rounded, with the bin's number below, so that ties are ties.
        level = np.round(power * 16).astype(np.int64) * 512 + (511 - LOWEST - np.arange(power.shape[1]))
        best = np.partition(level, -PEAKS, axis=1)[:, -PEAKS:]
        out[i : i + CHUNK] = 511 - (np.sort(best, axis=1)[:, ::-1] % 512)
    return out


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and packed (anchor bin, target bin, frames between) in order of time."""
    p = peaks(payload)
    times, codes = [], []
    for dt in range(1, FAN + 1):
        if len(p) > dt:
            pair = (p[:-dt, :1] << 16) | (p[dt:] << 4) | dt
            times.append(np.repeat(np.arange(len(p) - dt, dtype=np.int32), PEAKS))
            codes.append(pair.ravel())
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.argsort(t, kind="stable")
    return t[order], c[order].astype(np.int32)


def _batches(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("fp_time", pa.list_(pa.int32())), ("fp_code", pa.list_(pa.int32()))])
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        for i in range(0, b.num_rows, 256):
            rows = []
            for t in texts[i : i + 256]:
                data = (t.as_py() or "").encode()
                media = store(data)
                payload = load(media)
                rows.append((len(data), media, payload, *fingerprint(payload)))
            n, media, payload, times, codes = map(list, zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([ids[i : i + 256].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(payload, pa.binary()), pa.array(times, pa.list_(pa.int32())), pa.array(codes, pa.list_(pa.int32()))], schema=schema)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the WAV file), payload (read back), fp_time, fp_code."""
    return documents(docs).mapInArrow(_batches, SCHEMA)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = to_media(table(spark, sf_dir, "documents"))
    return m.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 31, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fp_code").cast("string"), F.lpad(F.lower(F.hex(F.xxhash64("fp_time", "fp_code"))), 16, "0")).alias("feature"),
    )
