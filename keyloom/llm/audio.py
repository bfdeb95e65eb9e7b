"""Audio columns: lossless 8-bit media, resampled log-mel features, energy segments, fixed-shape tensors."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_table, sub_batches

RATE, UP, DOWN, TAPS = 8000, 3, 4, 16  # 8 kHz samples become 6 kHz ones
FRAME, HOP, MELS, PATCH = 256, 128, 24, 16
ALIGN = 192
_WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")


def to_wav(payload: bytes) -> bytes:
    """Bytes as the samples of a mono 8-bit PCM file."""
    return _WAV.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of such a file; other chunks before the data are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@functools.cache
def _polyphase() -> np.ndarray:
    """The low-pass filter's UP phases side by side: DOWN input samples in, UP output samples out."""
    width = TAPS + DOWN
    out = np.zeros((width, UP), np.float32)
    for phase in range(UP):
        centre = TAPS / 2 + phase * DOWN / UP
        t = np.arange(width) - centre
        window = np.where(np.abs(t) < TAPS / 2, 0.5 + 0.5 * np.cos(2 * np.pi * t / TAPS), 0)
        h = np.sinc(t * UP / DOWN) * window
        out[:, phase] = h / h.sum()
    return out


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP / DOWN; the ends are held."""
    filters = _polyphase()
    n = -(-len(x) // DOWN)
    padded = np.pad(x, (TAPS // 2, filters.shape[0] + DOWN), mode="edge")
    windows = np.lib.stride_tricks.as_strided(padded, (n, filters.shape[0]), (DOWN * padded.itemsize, padded.itemsize))
    return (windows @ filters).ravel()


@functools.cache
def _mel() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray, block: int = 2048) -> np.ndarray:
    """Decibels per frame and band; frames overlap by half, and a block of them at a time is held as spectra."""
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1) if len(y) > FRAME else 1
    y = np.pad(y, (0, max(0, (n - 1) * HOP + FRAME - len(y))))
    frames = np.lib.stride_tricks.as_strided(y, (n, FRAME), (HOP * y.itemsize, y.itemsize))
    window, mel = np.hanning(FRAME).astype(np.float32), _mel()
    out = np.empty((n, MELS), np.float32)
    for i in range(0, n, block):
        spectrum = np.fft.rfft(frames[i : i + block] * window, axis=1)
        out[i : i + block] = 10 * np.log10((spectrum.real**2 + spectrum.imag**2) @ mel + 1e-6)
    return out


def segments(energy: np.ndarray, width: float = 0.25) -> list[tuple[int, int]]:
    """Runs of frames that begin above the mean by ``width`` deviations and end where the energy is below it by as much."""
    mean, spread = float(energy.mean()), float(energy.std())
    state = np.where(energy >= mean + width * spread, 1, np.where(energy < mean - width * spread, 0, -1))
    at = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.concatenate([[0], np.where(at >= 0, state[at], 0), [0]])
    edges = np.flatnonzero(np.diff(on))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def tensors(payload: bytes) -> pa.Table:
    """start_s, end_s and patch of PATCH frames by MELS bands, for the loud segments of the samples.

    A segment's last patch is filled up with its own last frame; its span tells where the sound ends.
    """
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mels = log_mel(resample(x))
    hop_s = HOP * DOWN / (RATE * UP)
    starts, ends, patches = [], [], []
    for a, b in segments(mels.mean(axis=1)):
        for i in range(a, b, PATCH):
            rows = np.minimum(np.arange(i, i + PATCH), b - 1)
            starts.append(i * hop_s)
            ends.append(min(i + PATCH, b) * hop_s)
            patches.append(rows)
    values = mels[np.array(patches)] if patches else np.empty((0, PATCH, MELS), np.float32)
    kind = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS), dim_names=("frame", "band"))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel(), pa.float32()), PATCH * MELS)
    return pa.table([pa.array(starts, pa.float64()), pa.array(ends, pa.float64()), pa.ExtensionArray.from_storage(kind, flat)], ["start_s", "end_s", "patch"])


def to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def digest(table: pa.Table) -> str:
    """Number of patches, loud seconds and a hash of the patches in half decibels."""
    spans = np.stack([table.column("start_s").to_numpy(), table.column("end_s").to_numpy()])
    column = table.column("patch")
    values = np.concatenate([x.storage.flatten().to_numpy() for x in column.chunks]) if column.num_chunks else np.empty(0, np.float32)
    steps = np.round(values * 2).astype("<i2")
    return f"{table.num_rows}:{float((spans[1] - spans[0]).sum()):.4f}:{hashlib.sha256(steps.tobytes() + np.round(spans * RATE).astype('<i8').tobytes()).hexdigest()[:32]}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every whole text (null: empty), written to the shared folder and read again.

    Texts of any length are stored whole, a batch of a few million characters at a time; nulls and repeats of doc_id and
    repeated rows stay, with equal media for equal texts; other columns are ignored; no rows give none.
    """

    def run(batches):
        for batch in batches:
            for rows, texts in sub_batches(batch, "text", 4_000_000):
                raw = [x.encode() for x in texts]
                media = [to_wav(x + b" " * (max(ALIGN, -(-len(x) // ALIGN) * ALIGN) - len(x))) for x in raw]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return as_table(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


_FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def tensor_table(media: DataFrame) -> DataFrame:
    """Reads media (doc_id, n_bytes, media) back, and stores what it found: sizes and hashes, and ``tensors``, an Arrow stream of the fixed-shape tensors with their time spans. Without a shuffle; a row of very long media is a batch by itself."""

    def run(batches):
        for batch in batches:
            doc_ids, lengths = batch.column("doc_id"), batch.column("n_bytes")
            rows, out, held = [], [], 0
            for i, data in enumerate(batch.column("media")):
                data = data.as_py()
                payload = from_wav(data)
                rows.append(i)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), to_ipc(tensors(payload))))
                held += len(data)
                if held > 4_000_000 or i == batch.num_rows - 1:
                    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                    own = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([doc_ids.take(own), lengths.take(own), *(pa.array(x, t) for x, t in zip(zip(*out), types))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensors"])
                    rows, out, held = [], [], 0

    return as_table(media.select("doc_id", "n_bytes", "media").mapInArrow(run, _FACTS + ", tensors binary"), "tensors")


def features(stored: DataFrame) -> DataFrame:
    """A ``tensor_table`` read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, the digest of the stored tensors. Equal texts have equal values; no rows give none."""

    def digests(column):
        return pa.array([digest(from_ipc(x.as_py())) for x in column], pa.string())

    digests.__annotations__ = {"column": pa.Array, "return": pa.Array}
    names = [c.split(" ")[0] for c in _FACTS.split(", ")]
    return stored.select(*names, F.arrow_udf(digests, "string")("tensors").alias("feature"))
