"""Media columns: audio stored losslessly as 8-bit PCM WAV, and its features.

Features: polyphase resampling, log-mel filterbanks over overlapped frames, and segments found by their energy with
hysteresis (a segment starts above the upper threshold and ends below the lower one). A segment has a time span and a
tensor of fixed shape, held in an Arrow fixed-shape tensor column (an IPC stream a document).

Each document's features come from its own bytes alone, block by block, so equal payloads (repeated rows, ties) give
equal features. Null text counts as empty, which is stored as 64 zero bytes; texts of any length are taken whole. An
empty payload has no frames and no segments, an empty table no rows. Other columns are ignored.

The query writes the media column to the shared folder and reads it back; files and tensors are computed once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE_IN, RATE_OUT = 16_000, 12_000
FRAME, HOP, MELS, TAPS = 256, 128, 20, 16
#: Shape of a segment's tensor: frames (means over equal shares of the segment) by mel bands.
SHAPE = (8, MELS)
ALIGN, BLOCK = 64, 1 << 18


def wav(payload: bytes, rate: int = RATE_IN) -> bytes:
    """A mono 8-bit PCM WAV file; its samples are the payload's bytes (an odd payload gets the format's pad byte)."""
    pad = len(payload) & 1
    return b"".join([struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)), payload, b"\0" * pad])


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples; chunks other than fmt and data are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is stored here")
        elif kind == b"data":
            if rate is None or at + 8 + size > len(media):
                raise ValueError("cut off or without a format")
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@lru_cache(maxsize=4)
def polyphase(up: int, down: int) -> np.ndarray:
    """Sub-filters (up, TAPS) of a windowed-sinc low-pass filter."""
    n = up * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hamming(n) * up
    return np.ascontiguousarray((h / h.sum() * up).reshape(TAPS, up).T, dtype=np.float32)


def resample(x: np.ndarray, up: int, down: int, ahead: np.ndarray) -> np.ndarray:
    """Every output sample is one sub-filter over TAPS inputs; outputs of one sub-filter are `up` apart, their inputs `down`.
    ahead: the TAPS - 1 inputs before x, whose length is a multiple of down but at the end."""
    h, x = polyphase(up, down), np.concatenate([ahead, x])
    n = (len(x) - TAPS + 1) * up
    if n <= 0:
        return np.empty(0, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    out = np.empty(-(-n // down), np.float32)
    for k in range(min(up, len(out))):
        place, phase = divmod(k * down, up)
        out[k::up] = windows[place::down] @ h[phase, ::-1]
    return out


@lru_cache(maxsize=2)
def filterbank(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and triangular mel filters (bins, MELS)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(payload: bytes, rate: int = RATE_IN, rate_out: int = RATE_OUT) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel bands (frames, MELS) and energy in dB (frames). Blocks of the payload bound what is held at once."""
    g = int(np.gcd(rate, rate_out))
    up, down = rate_out // g, rate // g
    window, bank = filterbank(rate_out)
    block = BLOCK // down * down
    ahead, rest, mels, energy = np.zeros(TAPS - 1, np.float32), np.empty(0, np.float32), [], []
    for i in range(0, len(payload), block):
        x = (np.frombuffer(payload, np.uint8, min(block, len(payload) - i), i).astype(np.float32) - 128) / 128
        y = np.concatenate([rest, resample(x, up, down, ahead)])
        ahead = np.concatenate([ahead, x])[-(TAPS - 1) :]
        if i + block >= len(payload) and len(y) % HOP or len(y) < FRAME and i + block >= len(payload):
            y = np.concatenate([y, np.zeros(max(FRAME, -(-len(y) // HOP) * HOP) - len(y), np.float32)])  # the last frame is filled with silence
        if len(y) >= FRAME:
            frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
            power = np.square(np.abs(np.fft.rfft(frames * window, axis=1))).astype(np.float32)
            mels.append(np.log(power @ bank + np.float32(1e-6)))
            energy.append(10 * np.log10(np.square(frames).mean(axis=1) + np.float32(1e-9)))
            rest = y[len(frames) * HOP :]
        else:
            rest = y
    if not mels:
        return np.empty((0, MELS), np.float32), np.empty(0, np.float32)
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, upper: float = 0.5, lower: float = 0.25) -> np.ndarray:
    """(first frame, end frame) of each segment; thresholds in standard deviations above and below the mean energy."""
    if not len(energy):
        return np.empty((0, 2), np.int64)
    mean, spread = float(energy.mean()), float(energy.std())
    on, off = energy >= mean + upper * spread, energy < mean - lower * spread
    last = np.maximum.accumulate(np.where(on | off, np.arange(len(energy)), -1))
    active = np.where(last >= 0, on[last], False)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], active, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


def tensors(mel: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """(segments, *SHAPE): means over equal shares of each segment's frames."""
    if not len(spans):
        return np.empty((0, *SHAPE), np.float32)
    total = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, axis=0, dtype=np.float64)])
    share = np.arange(SHAPE[0])
    size = (spans[:, 1] - spans[:, 0])[:, None]
    first = spans[:, :1] + share * size // SHAPE[0]
    end = np.maximum(spans[:, :1] + (share + 1) * size // SHAPE[0], first + 1)
    return ((total[end] - total[first]) / (end - first)[..., None]).astype(np.float32)


def tensor_ipc(values: np.ndarray, spans: np.ndarray) -> bytes:
    """An Arrow stream with columns start_s, end_s and a fixed-shape tensor."""
    kind = pa.fixed_shape_tensor(pa.float32(), list(SHAPE))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), int(np.prod(SHAPE)))
    seconds = spans * (HOP / RATE_OUT)
    batch = pa.RecordBatch.from_arrays([pa.array(seconds[:, 0], pa.float64()), pa.array(seconds[:, 1], pa.float64()), pa.ExtensionArray.from_storage(kind, flat)], names=["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text's UTF-8 bytes, padded to a positive multiple of 64, as a WAV file."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = b.column(1).to_pylist()
        media = [wav(x + bytes(-len(x) % ALIGN or (0 if x else ALIGN))) for x in raw]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    out = common.map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), common.utf8(text_col)), f, "id long, n_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


def described(media: bytes | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Samples, mel bands, spans (frames) and tensors of a stored file."""
    rate, payload = read_wav(media) if media else (RATE_IN, b"")
    mel, energy = log_mel(payload, rate)
    spans = segments(energy)
    return payload, mel, spans, tensors(mel, spans)


def features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_frames, segments array<struct<start_s, end_s, log_mel array<float>>>, tensors binary) of each stored file; null media has none."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        n, found, ipc = [], [], []
        for media in b.column(1).to_pylist():
            _, mel, spans, values = described(media)
            n.append(len(mel))
            found.append([{"start_s": s * HOP / RATE_OUT, "end_s": e * HOP / RATE_OUT, "log_mel": v.ravel().tolist()} for (s, e), v in zip(spans.tolist(), values, strict=True)])
            ipc.append(tensor_ipc(values, spans))
        kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", pa.list_(pa.float32()))]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(ipc, pa.binary())], names=["id", "n_frames", "segments", "tensors"])

    out = common.map_arrow(stored.select(F.col(id_col).cast("long").alias("id"), "media"), f, "id long, n_frames long, segments array<struct<start_s: double, end_s: double, log_mel: array<float>>>, tensors binary")
    return out.withColumnRenamed("id", id_col)


def summary(mel: np.ndarray, spans: np.ndarray, values: np.ndarray) -> str:
    """Frames, segments, mean log-mel bands and a digest of the segments' spans and tensors (rounded, so that the last bits don't count)."""
    rounded = np.round(values * 16).astype(np.int16)
    mean = ",".join(f"{x:.2f}" for x in mel.mean(axis=0).tolist()) if len(mel) else ""
    digest = hashlib.blake2b(spans.astype("<i8").tobytes() + rounded.astype("<i2").tobytes(), digest_size=8).hexdigest()
    return f"frames={len(mel)};segments={len(spans)};mel={mean};tensors={digest}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, tensors binary"


def digest(stored: DataFrame) -> DataFrame:
    """Reads stored files back: sizes, digests, the features' summary, and the tensors with their time spans (an Arrow stream)."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, n, media in zip(*(c.to_pylist() for c in b.columns), strict=True):
            payload, mel, spans, values = described(media)
            rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), summary(mel, spans, values), len(mel), tensor_ipc(values, spans)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return common.map_arrow(stored.select("doc_id", "n_bytes", "media"), f, SCHEMA)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(common.table(spark, sf_dir, "documents"))
    return digest(common.Scratch(spark, "media").keep(stored, "files", "zstd"))
