"""Media columns: WAV read by the wave module, short-time Fourier transforms, and spectral-peak pair fingerprints as time-coded arrays.

A payload is kept losslessly as the samples of an 8-bit mono WAV. Fingerprints pair spectral peaks that follow each other within a few frames: each is one
64-bit number, the anchor's frame in the upper 32 bits and both frequencies and their distance in the lower ones. Frames are transformed in blocks that
overlap by the pairs' reach, so memory doesn't grow with a text.

Edge cases: a null text is empty; an empty text has one block of zero bytes as payload, which is a constant without peaks, so its array is empty. Of equal
magnitudes the lower bin is the peak. Equal texts have equal media, whatever their ids, null and repeated ones included; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import io
import wave
import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from noticeflow.llm.common import map_arrow

UNIT = 64
RATE = 8000
WINDOW, HOP = 256, 128
BANDS = ((1, 8), (8, 32), (32, 128))
REACH = 3
FRAMES = 2048


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the UTF-8 bytes with zeros up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0")


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Peak bin of each band in frames first .. first + count (0: none): the band's largest magnitude, if it stands out in its frame."""
    start = first * HOP
    part = samples[start : start + (count - 1) * HOP + WINDOW]
    part = np.pad(part, (0, (count - 1) * HOP + WINDOW - len(part)), constant_values=128)
    signal = (part.astype(np.float32) - 128) / 128
    frames = np.lib.stride_tricks.sliding_window_view(signal, WINDOW)[::HOP] * np.hanning(WINDOW).astype(np.float32)
    frames -= frames.mean(axis=1, keepdims=True)
    size = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32)
    floor = 2 * size.mean(axis=1)
    out = np.zeros((count, len(BANDS)), np.int64)
    for b, (low, high) in enumerate(BANDS):
        at = size[:, low:high].argmax(axis=1)
        most = np.take_along_axis(size[:, low:high], at[:, None], 1)[:, 0]
        out[:, b] = np.where((most > floor) & (most > 1e-3), at + low, 0)
    return out


def fingerprints(payload: bytes) -> np.ndarray:
    """Time-coded pair hashes of a payload's samples, by time."""
    samples = np.frombuffer(payload, np.uint8)
    frames = max(1, -(-(len(samples) - WINDOW) // HOP) + 1)
    out = []
    for at in range(0, frames, FRAMES):
        own = min(FRAMES, frames - at)
        found = peaks(samples, at, min(own + REACH, frames - at))
        for apart in range(1, REACH + 1):
            anchors = found[: min(own, len(found) - apart)]
            later = found[apart : apart + len(anchors)]
            for b in range(len(BANDS)):
                for c in range(len(BANDS)):
                    good = np.flatnonzero((anchors[:, b] > 0) & (later[:, c] > 0))
                    out.append((at + good) << 32 | anchors[good, b] << 12 | later[good, c] << 2 | apart)
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


def media_columns(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media (the WAV), fingerprints array<long>."""

    def make():
        def apply(cols):
            made = [payload_of(x) for x in cols[text]]
            media = [to_wav(p) for _, p in made]
            return {key: cols[key], "n_bytes": [n for n, _ in made], "media": media, "fingerprints": [fingerprints(from_wav(m)) for m in media]}

        return apply

    return map_arrow(docs.select(key, text), f"{key} {dict(docs.dtypes)[key]}, n_bytes long, media binary, fingerprints array<long>", make, rows=64)


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What media_columns() holds, as digests made where the media are; the payload's digests are of the bytes read back from the WAV."""

    def make():
        def apply(cols):
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_fingerprints")
            out = {key: cols[key]} | {k: [] for k in names}
            for x in cols[text]:
                n, payload = payload_of(x)
                media = to_wav(payload)
                back = from_wav(media)
                marks = fingerprints(back)
                values = (n, len(back), sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), sha256(media).hexdigest(), sha256(marks.astype("<i8").tobytes()).hexdigest(), len(marks))
                for name, value in zip(names, values):
                    out[name].append(value)
            return out

        return apply

    schema = f"{key} {dict(docs.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_fingerprints long"
    return map_arrow(docs.select(key, text), schema, make)
