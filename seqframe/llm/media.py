"""Audio columns: lossless 8-bit samples, log-mel features of speech-like segments, time spans.

Method: polyphase resampling, overlapped log-mel filterbanks and hysteresis energy segmentation.
Segments are cut into windows of `SHAPE` frames x bands that hold every frame of the segment.  The windows
of a text, with their time spans, are stored as one Arrow record batch whose ``mel`` column is a fixed-shape
tensor array (`stored`, `read`); Spark, which has no such type, carries the batch's IPC bytes.
"""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens as tk

STORED_RATE, RATE = 16_000, 8_000
FRAME, HOP, FFT, MELS, WINDOW = 200, 80, 256, 24, 64
SHAPE = (WINDOW, MELS)
#: Log-mel value of silence; it fills the last window of a segment.
FLOOR = -10.0
UNIT = 64
#: Frames that one step transforms.
STEP = 8192

TENSOR = pa.fixed_shape_tensor(pa.float32(), SHAPE)
WINDOWS = pa.schema([("start", pa.float64()), ("end", pa.float64()), ("segment", pa.int32()), ("frames", pa.int32()), ("mel", TENSOR)])
SCHEMA = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, windows binary"


def payload_of(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of 64."""
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def encode_wav(payload: bytes) -> bytes:
    """Mono 8-bit PCM: one sample a byte."""
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(STORED_RATE)
            w.writeframes(payload)
        return out.getvalue()


def decode_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


#: Zero crossings of the low pass on either side.
HALF = 6


@cache
def _phases(up: int, down: int) -> np.ndarray:
    """Rows of a windowed-sinc low pass, one for each phase of the upsampled grid."""
    n = HALF * max(up, down)
    t = np.arange(-n, n + 1)
    h = np.sinc(t / max(up, down)) * np.hamming(2 * n + 1)
    h *= up / h.sum()
    taps = -(-len(h) // up)
    return np.pad(h, (0, taps * up - len(h))).reshape(taps, up).T.astype(np.float32).copy()


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Rational-rate polyphase resampling; ``len(x) * to / rate`` samples, rounded up."""
    g = int(np.gcd(rate, to))
    up, down = to // g, rate // g
    rows = _phases(up, down)
    taps = rows.shape[1]
    delay = HALF * max(up, down)
    total = -(-len(x) * up // down)
    padded = np.pad(x.astype(np.float32), (taps, taps + delay // up + 1))
    view = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(total, np.float32)
    for a in range(0, total, 1 << 16):
        at = np.arange(a, min(total, a + (1 << 16))) * down + delay
        out[a : a + len(at)] = np.einsum("ij,ij->i", view[at // up + 1][:, ::-1], rows[at % up])
    return out


@cache
def _mel() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = hz(np.linspace(mel(60.0), mel(RATE / 2), MELS + 2))
    f = np.fft.rfftfreq(FFT, 1 / RATE)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (frames x MELS) and frame energies in dB; at least one frame."""
    count = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    y = np.pad(y, (0, (count - 1) * HOP + FRAME - len(y)))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    window, bank = np.hanning(FRAME), _mel()
    mels, energy = np.empty((count, MELS)), np.empty(count)
    for a in range(0, count, STEP):
        part = frames[a : a + STEP]
        power = np.abs(np.fft.rfft(part * window, FFT)) ** 2
        mels[a : a + STEP] = np.log10(power @ bank + 1e-10)
        energy[a : a + STEP] = 10 * np.log10((part**2).mean(axis=1) + 1e-10)
    return mels, energy


def segments(energy: np.ndarray, high: float = 6.0, low: float = 12.0) -> list[tuple[int, int]]:
    """Frame ranges that reach the peak less ``high`` dB and last while above the peak less ``low`` dB."""
    peak = energy.max()
    active = energy >= peak - low
    edge = np.flatnonzero(np.diff(np.r_[False, active, False].astype(np.int8)))
    loud = np.r_[0, np.cumsum(energy >= peak - high)]
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if loud[b] > loud[a]]


def features(payload: bytes, rate: int) -> list[dict]:
    """Windows of the segments, in order: start and end in seconds, number of the segment, frames filled, and
    a log-mel tensor of shape `SHAPE`.  Every frame of a segment is in one window."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32)
    y = resample((x - x.mean()) / 128, rate, RATE)
    mels, energy = log_mel(y)
    out = []
    for k, (first, last) in enumerate(segments(energy)):
        for a in range(first, last, WINDOW):
            b = min(last, a + WINDOW)
            mel = np.full(SHAPE, FLOOR, np.float32)
            mel[: b - a] = mels[a:b]
            out.append({"start": a * HOP / RATE, "end": min(len(y), (b - 1) * HOP + FRAME) / RATE, "segment": k, "frames": b - a, "mel": mel.ravel()})
    return out


def stored(found: list[dict]) -> bytes:
    """The windows as Arrow IPC bytes: time span, number of the segment, frames filled, log-mel tensor."""
    flat = np.concatenate([w["mel"] for w in found]) if found else np.zeros(0, np.float32)
    mel = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float32()), WINDOW * MELS))
    batch = pa.RecordBatch.from_arrays([*[pa.array([w[f.name] for w in found], f.type) for f in list(WINDOWS)[:-1]], mel], schema=WINDOWS)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, WINDOWS) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def read(data: bytes) -> pa.RecordBatch:
    """The windows of one text as `stored` wrote them."""
    with pa.ipc.open_stream(data) as reader:
        return reader.read_next_batch()


def audio(docs: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """Store each text as audio, read it back, and describe what was read.

    Needs ``doc_id`` and ``text``; other columns are ignored.  The payload is the UTF-8 text (null:
    empty) with zero bytes up to a positive multiple of 64, stored as a mono 8-bit WAV file in
    ``media``.  Returns one row per input row: ``doc_id, n_bytes`` (unpadded), ``media,
    payload_bytes, payload_sha256, tail_crc32`` (last 64 bytes; all of the payload as read back) and
    ``windows``: those of the segments as `features` gives them, to be read by `read`.

    Each row depends on its text alone: rows may repeat, ids may be null, and equal texts give equal
    values.  A silent text (all bytes equal) is one segment.  An empty table gives an empty result.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "windows"]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in tk.small(batches):
            ids = batch.column("doc_id").to_pylist()
            raw, off = tk.utf8(batch.column("text"))
            rows, held = [], 0
            for i, doc_id in enumerate(ids):
                text = raw[off[i] : off[i + 1]].tobytes()
                media = encode_wav(payload_of(text))
                payload, rate = decode_wav(media)
                rows.append((doc_id, len(text), media, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), stored(features(payload, rate))))
                held += len(media) + len(rows[-1][-1])
                if held >= batch_bytes:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def spoken(data: bytes) -> str:
    """The windows read back, in short: time span and mean log-mel value of the frames filled."""
    w = read(data)
    mel = w.column("mel").storage.flatten().to_numpy().reshape(-1, *SHAPE)
    spans = zip(*(w.column(c).to_pylist() for c in ("start", "end", "frames")))
    return ";".join(f"{a:.3f}-{b:.3f}:{mel[i, :n].mean(dtype=np.float64):.2f}" for i, (a, b, n) in enumerate(spans))


def digest(result: DataFrame) -> DataFrame:
    slim = result.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "windows")
    names = slim.columns[:-1]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small(batches):
            said = pa.array([spoken(x.as_py()) for x in batch.column("windows")], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], said], [*names, "feature"])

    return slim.mapInArrow(describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
