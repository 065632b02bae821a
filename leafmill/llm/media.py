"""Media columns: WAV in binary columns, short-time Fourier transforms, peak-pair fingerprints.

``store_bytes`` puts bytes losslessly into a WAV of 8-bit samples: UTF-8 of a
text, padded with spaces to a positive multiple of ``BLOCK``. ``read_media``
reads a WAV column with the wave module. ``fingerprint`` takes a Hann-windowed
Fourier transform of every frame, keeps the strongest bin of each band in each
stretch of frames, and pairs every such peak with the next ones in time; a pair
is one long, ``time << 32 | first bin << 20 | second bin << 8 | distance``.

Defined results: null and empty texts are ``BLOCK`` spaces. Bytes that are no
WAV, and WAVs that are not PCM of 8 or 16 bits, give nulls and a status and fail
nothing. Long recordings are transformed in pieces of bounded size; every row is
on its own, so repeated rows, null ids and extra columns need no care.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import text_batches

BLOCK = 192
RATE = 8000
FRAME, HOP = 192, 96
STRETCH, AHEAD = 16, 3
#: Bands of Fourier bins, without the constant part.
BANDS = ((1, 12), (12, 24), (24, 48), (48, 97))
FRAMES_AT_ONCE = STRETCH * 1024

_HANN = np.hanning(FRAME + 1)[:-1]


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + b" " * (-len(text) % BLOCK or (BLOCK if not text else 0))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int, int, int]:
    """(sample bytes, channels, bytes a sample, rate)."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getnchannels(), w.getsampwidth(), w.getframerate()


def samples_of(data: bytes, channels: int, width: int) -> np.ndarray:
    """Mean over the channels, in [-1, 1)."""
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif width == 2:
        x = np.frombuffer(data[: len(data) // 2 * 2], "<i2") / 32768
    else:
        raise ValueError("only 8 and 16 bits a sample")
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1)


def power(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Power spectra of frames ``first`` to ``first + count``, rounded so that equal sounds give equal numbers."""
    view = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[:: HOP][first : first + count]
    return np.round(np.abs(np.fft.rfft(view * _HANN, axis=1)) ** 2, 6)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the strongest bin of every band in every stretch, in order of time."""
    if len(samples) < FRAME:
        samples = np.r_[samples, np.zeros(FRAME - len(samples))]
    total = (len(samples) - FRAME) // HOP + 1
    times, bins = [], []
    for first in range(0, total, FRAMES_AT_ONCE):
        spectrum = power(samples, first, FRAMES_AT_ONCE)
        rows = -(-len(spectrum) // STRETCH)
        spectrum = np.r_[spectrum, np.zeros((rows * STRETCH - len(spectrum), spectrum.shape[1]))].reshape(rows, STRETCH, -1)
        for low, high in BANDS:
            band = spectrum[:, :, low:high].reshape(rows, -1)
            top = band.argmax(1)
            some = band[np.arange(rows), top] > 0
            times.append((first + np.arange(rows) * STRETCH + top // (high - low))[some])
            bins.append((low + top % (high - low))[some])
    t, b = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((b, t))
    return t[order], b[order]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs of peaks, as longs in order of time."""
    t, b = peaks(samples)
    out = []
    for k in range(1, AHEAD + 1):
        gap = t[k:] - t[:-k] if len(t) > k else np.empty(0, np.int64)
        near = gap < 256
        n = len(gap)
        out.append(((t[:n] << 32) | (b[:n] << 20) | (b[k:] << 8) | gap)[near] if n else gap)
    return np.sort(np.concatenate(out).astype(np.int64))


def store_bytes(docs: DataFrame) -> DataFrame:
    """The other columns of ``docs`` in struct ``row``, n_bytes, and media: the text's WAV."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            media = [to_wav(payload_of(t)) for t in texts]
            yield pa.record_batch([batch["row"], pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], ["row", "n_bytes", "media"])

    rows = text_batches(docs).select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, media binary")


MEDIA_FIELDS = (
    "status string, channels int, sample_bytes int, rate int, payload_bytes long, payload_sha256 string, "
    "tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<bigint>, feature string"
)


def read_media(media: DataFrame, column: str = "media") -> DataFrame:
    """The other columns in struct ``row``, and what the WAV bytes of ``column`` hold.

    ``feature`` is the number of pairs and the SHA-256 of their little-endian longs.
    """

    def read(data: bytes | None) -> tuple:
        try:
            if data is None:
                return ("null",) + (None,) * 10
            payload, channels, width, rate = from_wav(data)
            pairs = fingerprint(samples_of(payload, channels, width))
        except (wave.Error, EOFError, ValueError) as e:
            return (f"unreadable: {e}"[:200], *[None] * 6, len(data), hashlib.sha256(data).hexdigest(), None, None)
        feature = f"{len(pairs)}:{hashlib.sha256(pairs.astype('<i8').tobytes()).hexdigest()}"
        return (
            "ok", channels, width, rate, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
            len(data), hashlib.sha256(data).hexdigest(), pairs, feature,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]
        names = [f.split()[0] for f in MEDIA_FIELDS.split(", ")]
        for batch in batches:
            got = list(zip(*map(read, batch["media"].to_pylist()), strict=True)) or [()] * len(kinds)
            yield pa.record_batch([batch["row"], *[pa.array(list(v), k) for v, k in zip(got, kinds, strict=True)]], ["row", *names])

    rows = text_batches(media).select(F.struct(*[F.col(f"`{c}`") for c in media.columns if c != column]).alias("row"), F.col(f"`{column}`").alias("media"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {MEDIA_FIELDS}")
