"""Media columns: 8-bit WAV containers, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, map_batches, stored

#: The payload is padded with spaces to a positive multiple of this many bytes, also the frame of the transform.
UNIT = 192
HOP = UNIT // 2
RATE = 8000
#: Frames transformed at once: bounds memory for very long media.
BLOCK_FRAMES = 8192
#: A peak is a bin that no other one surpasses among those as near as these, in frames and in bins, and LOUD times its frame's mean.
REACH = 2
REACH_BINS = 8
LOUD = 4.0
#: Each peak is paired with this many following peaks, at most SPAN frames away.
FAN = 3
SPAN = 63

_WINDOW = np.hanning(UNIT).astype(np.float32)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    return data + b" " * (max(1, -(-len(data) // unit)) * unit - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono 8-bit WAV whose samples are the payload's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("expected mono 8-bit samples")
        return r.readframes(r.getnframes()), r.getframerate()


def spectrogram(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Power of the short-time Fourier transform's bins above 0 in frames ``first`` to ``last``."""
    part = samples[first * HOP : (last - 1) * HOP + UNIT]
    frames = np.lib.stride_tricks.sliding_window_view(part, UNIT)[::HOP]
    spectrum = np.fft.rfft((frames.astype(np.float32) - 128.0) * _WINDOW, axis=1)[:, 1:]
    return (spectrum.real**2 + spectrum.imag**2).astype(np.float32)


def _highest_around(power: np.ndarray, reach: int, axis: int) -> np.ndarray:
    out = power.copy()
    for step in range(1, reach + 1):
        ahead, behind = (slice(step, None), slice(None, -step))
        a, b = ((ahead, slice(None)), (behind, slice(None))) if axis == 0 else ((slice(None), ahead), (slice(None), behind))
        np.maximum(out[b], power[a], out=out[b])
        np.maximum(out[a], power[b], out=out[a])
    return out


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks, by frame and bin. Works on BLOCK_FRAMES frames and those within reach of them."""
    n = (len(samples) - UNIT) // HOP + 1
    frames, bins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, n, BLOCK_FRAMES):
        first, last = max(0, at - REACH), min(n, at + BLOCK_FRAMES + REACH)
        power = spectrogram(samples, first, last)
        high = _highest_around(_highest_around(power, REACH_BINS, 1), REACH, 0)
        peak = (power >= high) & (power > LOUD * power.mean(axis=1, keepdims=True))
        f, b = np.nonzero(peak[at - first : at - first + BLOCK_FRAMES])
        frames.append(f + at)
        bins.append(b + 1)
    return np.concatenate(frames), np.concatenate(bins)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame of the anchor, code) arrays; a code holds both bins (7 bits each) and the distance in frames (6 bits)."""
    frames, bins = spectral_peaks(samples)
    times, codes = [], []
    for step in range(1, FAN + 1):
        gap = frames[step:] - frames[:-step]
        near = gap <= SPAN
        times.append(frames[:-step][near])
        codes.append((bins[:-step] << 13 | bins[step:] << 6 | gap)[near])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def describe(payload: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """A short feature text, and the fingerprint's arrays."""
    t, c = fingerprint(np.frombuffer(payload, np.uint8))
    digest = hashlib.sha1(t.astype("<i8").tobytes() + c.astype("<i8").tobytes()).hexdigest()
    return f"stft{UNIT}/{HOP}:pairs={len(c)}:{digest}", t, c


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, peak_times array<int>, peak_codes array<int>"
)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [as_bytes(x) for x in batch.column(1).to_pylist()]
        media = pa.array([to_wav(pad(x)) for x in data], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), media], names=["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes`` (of the text) and a binary ``media`` column (the WAV files), to be stored as a table.

    Map-only. Null text counts as empty (one unit of spaces); a null ``doc_id`` stays null; repeated rows repeat; other columns
    are ignored; an empty table gives an empty table.
    """
    return map_batches(docs.select(docs["doc_id"].cast("long"), docs["text"]), _encode, "doc_id long, n_bytes long, media binary")


def _describe_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n_bytes, media in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            payload, _ = from_wav(media)
            feature, t, c = describe(payload)
            rows.append(
                (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                 len(media), hashlib.sha256(media).hexdigest(), feature, t.astype(np.int32), c.astype(np.int32))
            )
        cols = list(zip(*rows, strict=True)) or [[]] * 10
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def describe_media(media: DataFrame) -> DataFrame:
    """Features of a table with a media column (see ``media_column``), from the bytes read back out of each file."""
    return map_batches(media.select("doc_id", "n_bytes", "media"), _describe_media, SCHEMA)


def media_features(docs: DataFrame) -> DataFrame:
    """The texts' media column, stored as a table and read again, and the features of what is read.

    No shuffle, and a worker holds one batch of texts. See ``media_column`` for nulls, repeated rows and other columns.
    """
    return describe_media(stored(media_column(docs), "media"))
