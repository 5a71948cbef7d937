"""Audio features of byte payloads.

A payload is stored losslessly as 8-bit mono PCM in a WAV container, read back, resampled from 24 to 16 kHz by a
polyphase filter, cut into overlapping frames, and turned into log-mel energies; a two-threshold (hysteresis) rule on
the frame energies gives the active spans. Log-mels are stored as an Arrow IPC stream of fixed-shape tensors
(FRAMES x MELS) with the time span of each, the last one padded with the floor value.

Defined results: a null text is the empty payload; payloads are padded with zero bytes to a positive multiple of 64, so
every row has at least one frame; equal texts have equal results; rows are independent, so repeated rows repeat; a text
of any length is worked through in blocks; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, small_batches

RATE, TARGET = 24_000, 16_000
UNIT = 64
#: Filter taps of each phase.
TAPS = 12
#: Frame, hop and transform length in samples at TARGET; mel bands.
FRAME, HOP, NFFT, MELS = 400, 160, 512, 40
#: Frames of a tensor, and frames worked on at once.
FRAMES, BLOCK = 50, 2000
#: Decibels over the median frame energy at which a span opens, and below which it closes.
OPEN_DB, CLOSE_DB = 1.5, 0.0
FLOOR = 1e-6


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def wav(payload: bytes) -> bytes:
    """Unsigned 8-bit mono PCM."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The payload of a WAV file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at < len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def phases() -> tuple[int, int, np.ndarray]:
    """Up, down and the filter of each phase (reversed for correlation): a Hamming-windowed sinc at the lower Nyquist."""
    from math import gcd

    up, down = TARGET // gcd(RATE, TARGET), RATE // gcd(RATE, TARGET)
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    h *= up / h.sum()
    return up, down, np.ascontiguousarray(h.reshape(TAPS, up).T[:, ::-1], np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """ceil(len(x) * up / down) samples; each phase is one strided product, no zeros are stuffed."""
    up, down, h = phases()
    n = -(-len(x) * up // down)
    x = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(down, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    y = np.empty(n, np.float32)
    for r in range(up):
        out = y[r::up]
        first, phase = r * down // up, r * down % up
        out[:] = windows[first : first + (len(out) - 1) * down + 1 : down] @ h[phase] if len(out) else 0
    return y


@lru_cache
def filterbank() -> tuple[np.ndarray, np.ndarray]:
    """Hann window and triangular mel filters (NFFT/2+1 x MELS)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(TARGET / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(NFFT, 1 / TARGET)[:, None]
    bank = np.clip(np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])), 0, None)
    return np.hanning(FRAME + 1)[:FRAME].astype(np.float32), bank.astype(np.float32)


def logmel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies of each frame, and the frames' energy in decibels."""
    if len(y) < FRAME:
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    window, bank = filterbank()
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out, energy = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    for at in range(0, len(frames), BLOCK):
        spectrum = np.fft.rfft(frames[at : at + BLOCK] * window, NFFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[at : at + BLOCK] = np.log(power @ bank + np.float32(FLOOR))
        energy[at : at + BLOCK] = 10 * np.log10(power.sum(1) / NFFT + np.float32(FLOOR))
    return out, energy


def active(energy: np.ndarray) -> np.ndarray:
    """(first, last) frames of the runs above the closing level that reach the opening level."""
    middle = np.median(energy)
    low = np.concatenate([[False], energy >= middle + CLOSE_DB, [False]])
    edge = np.nonzero(low[1:] != low[:-1])[0].reshape(-1, 2)
    high = np.concatenate([[0], np.cumsum(energy >= middle + OPEN_DB)])
    return edge[high[edge[:, 1]] > high[edge[:, 0]]] - [0, 1]


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow IPC stream: start_ms, end_ms, frames (not padding), logmel as fixed-shape tensors."""
    n = -(-len(mel) // FRAMES)
    full = np.full((n * FRAMES, MELS), np.log(np.float32(FLOOR)), np.float32)
    full[: len(mel)] = mel
    start = np.arange(n, dtype=np.int64) * FRAMES
    count = np.minimum(FRAMES, len(mel) - start)
    ms = lambda samples: samples * 1000 // TARGET
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
    array = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), FRAMES * MELS))
    batch = pa.RecordBatch.from_arrays([pa.array(ms(start * HOP)), pa.array(ms((start + count - 1) * HOP + FRAME)), pa.array(count.astype(np.int32)), array], names=["start_ms", "end_ms", "frames", "logmel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every payload as a WAV file in a table of the shared folder."""
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for batch in small_batches(batches, 256):
            data = as_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([wav(padded(x)) for x in data], pa.binary())], names=["key", "n_bytes", "media"])

    return materialize(plain.mapInArrow(run, f"key {plain.schema['key'].dataType.simpleString()}, n_bytes long, media binary"), "media").withColumnRenamed("key", key)


FEATURES = [
    ("payload_bytes", pa.int64(), "long"),
    ("payload_sha256", pa.string(), "string"),
    ("tail_crc32", pa.int64(), "long"),
    ("media_bytes", pa.int64(), "long"),
    ("media_sha256", pa.string(), "string"),
    ("frames", pa.int64(), "long"),
    ("spans_ms", pa.list_(pa.int64()), "array<long>"),
    ("tensors", pa.binary(), "binary"),
]


def describe(media: bytes) -> tuple:
    payload = samples(media)
    y = resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128)
    mel, energy = logmel(y)
    spans = active(energy) * HOP
    spans[:, 1] += FRAME
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), len(mel), (spans * 1000 // TARGET).reshape(-1).tolist(), tensors(mel)


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """The stored bytes' digests, active spans (start and end in ms, one after the other) and tensors of each row."""
    plain = media.select(F.col(key).alias("key"), "n_bytes", "media")

    def run(batches):
        for batch in small_batches(batches, 64):
            made = [describe(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([m[k] for m in made], f[1]) for k, f in enumerate(FEATURES))], names=["key", "n_bytes", *(f[0] for f in FEATURES)])

    return plain.mapInArrow(run, f"key {plain.schema['key'].dataType.simpleString()}, n_bytes long, " + ", ".join(f"{n} {ddl}" for n, _, ddl in FEATURES)).withColumnRenamed("key", key)
