"""Media columns: byte payloads kept as 8-bit PCM WAV; polyphase resampling, overlapped log-mel frames, hysteresis segments as fixed-shape tensors."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, slices, table

RATE, UP, DOWN, TAPS = 12000, 2, 3, 8
FRAME, HOP, MELS, TENSOR = 256, 128, 20, 8
BLOCK = 1 << 18  # input samples read at a time, a multiple of DOWN * HOP / gcd is not needed: state is carried


def pad64(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono unsigned 8-bit PCM; the payload's bytes are the samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples, found by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _filters() -> np.ndarray:
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) * np.hamming(n)
    h *= UP / h.sum()
    return np.stack([h[p::UP][::-1] for p in range(UP)]).astype(np.float32)


def _mel_bank(rate: float) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * rate / FRAME
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - lo) / (mid - lo), (hi - bins) / (hi - mid))).T.astype(np.float32)


class Features:
    """Blockwise, so memory does not grow with a clip beyond its frames (1/128 of its samples each)."""

    def __init__(self) -> None:
        self.h, self.rate = _filters(), RATE * UP / DOWN
        self.bank, self.window = _mel_bank(self.rate), np.hanning(FRAME).astype(np.float32)

    def resample(self, x: np.ndarray) -> np.ndarray:
        """Polyphase by UP/DOWN: output 2q+r is filter phase r over the TAPS samples up to input 3q+r."""
        n = -(-len(x) * UP // DOWN)
        q = -(-n // UP)
        padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN * q + UP + DOWN - len(x), np.float32)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
        return np.stack([windows[r : r + DOWN * q : DOWN] @ self.h[r] for r in range(UP)], 1).ravel()[:n]

    def logmel(self, samples: bytes) -> np.ndarray:
        """Frames x MELS; at least one frame, the last padded with zeros."""
        raw, out, tail = np.frombuffer(samples, np.uint8), [], np.zeros(0, np.float32)
        step = BLOCK * DOWN
        for i in range(0, max(len(raw), 1), step):
            x = raw[max(0, i - TAPS * DOWN) : i + step].astype(np.float32) / 128 - 1
            y = self.resample(x)[TAPS * UP if i else 0 :]
            tail = np.concatenate([tail, y])
            last = i + step >= len(raw)
            if last:
                short = FRAME if len(tail) < FRAME else len(tail) + -(len(tail) - FRAME) % HOP
                tail = np.concatenate([tail, np.zeros(short - len(tail), np.float32)])
            frames = np.lib.stride_tricks.sliding_window_view(tail, FRAME)[::HOP] if len(tail) >= FRAME else np.zeros((0, FRAME), np.float32)
            for j in range(0, len(frames), 4096):
                f = frames[j : j + 4096]
                s = np.fft.rfft((f - f.mean(1, keepdims=True)) * self.window, axis=1)
                out.append(np.log((s.real**2 + s.imag**2).astype(np.float32) @ self.bank + 1e-6))
            tail = tail[len(frames) * HOP :]
        return np.concatenate(out) if out else np.zeros((0, MELS), np.float32)

    def segments(self, mel: np.ndarray, low: float = 0.25, gap: int = 8) -> list[tuple[int, int]]:
        """Hysteresis on the frames' log energy: runs above mean - low * sd that reach the mean; gaps under `gap` frames are closed."""
        e = np.log(np.exp(mel).sum(1))
        mean, sd = float(e.mean()), float(e.std())
        over = np.flatnonzero(e >= mean - low * sd - 1e-6)
        if not len(over):
            return []
        cuts = np.flatnonzero(np.diff(over) > gap)
        begins, ends = over[np.concatenate([[0], cuts + 1])], over[np.concatenate([cuts, [len(over) - 1]])] + 1
        return [(int(a), int(b)) for a, b in zip(begins, ends, strict=True) if (e[a:b] >= mean - 1e-6).any()]

    def tensor(self, mel: np.ndarray, a: int, b: int) -> np.ndarray:
        """Segment frames averaged into TENSOR equal parts: shape (TENSOR, MELS)."""
        edges = a + (b - a) * np.arange(TENSOR + 1) / TENSOR
        sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel[a:b], 0, dtype=np.float64)])
        at = lambda t: (lambda k: sums[k] + (t - a - k)[:, None] * (sums[np.minimum(k + 1, b - a)] - sums[k]))(np.minimum((t - a).astype(int), b - a))
        return np.round((at(edges[1:]) - at(edges[:-1])) * TENSOR / (b - a), 3).astype(np.float32)

    def clip(self, media: bytes) -> list[tuple[float, float, np.ndarray]]:
        mel = self.logmel(from_wav(media)[1])
        span = lambda k: round(k * HOP / self.rate, 6)
        return [(span(a), span(b), self.tensor(mel, a, b)) for a, b in self.segments(mel)]


SEGMENTS = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("logmel", pa.fixed_shape_tensor(pa.float32(), (TENSOR, MELS)))])


def store_segments(clips: list[list[tuple[float, float, np.ndarray]]]) -> list[bytes]:
    """The segments of each clip as an Arrow IPC stream of SEGMENTS: time spans and a fixed-shape tensor column."""
    flat = [r for x in clips for r in x]
    tensors = np.stack([t for _, _, t in flat]) if flat else np.zeros((0, TENSOR, MELS), np.float32)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel()), TENSOR * MELS)
    every = pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.float64()), pa.array([r[1] for r in flat], pa.float64()), pa.ExtensionArray.from_storage(SEGMENTS.field(2).type, storage)], schema=SEGMENTS)
    out, at = [], 0
    for x in clips:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, SEGMENTS) as w:
            w.write_batch(every.slice(at, len(x)))
        out.append(sink.getvalue().to_pybytes())
        at += len(x)
    return out


def read_segments(stored: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and tensors (segments x TENSOR x MELS) of a stored clip's segments."""
    t = pa.ipc.open_stream(stored).read_all().combine_chunks()
    tensors = [c.to_numpy_ndarray() for c in t.column("logmel").chunks if len(c)]
    return t.column("start_s").to_numpy(), t.column("end_s").to_numpy(), np.concatenate(tensors) if tensors else np.zeros((0, TENSOR, MELS), np.float32)


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the stored WAV and its segments, an Arrow IPC stream (see read_segments) of time spans and log-mel
    tensors of the fixed shape TENSOR x MELS, a type that Spark's own columns do not have.

    Null and empty texts give 64 zero samples (one silent segment). Equal texts give equal media and tensors, since each clip is
    read in blocks that depend on nothing else. Repeated rows each get a row; no rows give no rows; other columns are not read.
    A map over the scan without shuffle."""

    def make():
        own = Features()

        def f(_, texts):
            data = [t.encode("utf-8", "replace") for t in texts]
            media = [to_wav(pad64(d)) for d in data]
            return {"n_bytes": pa.array([len(d) for d in data], pa.int64()), "media": pa.array(media, pa.binary()), "segments": pa.array(store_segments([own.clip(m) for m in media]), pa.binary())}

        return f

    return map_texts(docs, id_col, text_col, "n_bytes bigint, media binary, segments binary", make, rows=64)


def read_back(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of audio_features read again from what they store: the payload found by walking the WAV's chunks (size, SHA-256,
    CRC-32 of its last 64 bytes), size and SHA-256 of the media, and a digest of the segments' spans and tensors. Null media
    give null figures. A map without shuffle."""
    kind = stored.schema[id_col].dataType.simpleString()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_segments"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def figures(media: bytes | None, segments: bytes) -> tuple:
        if media is None:
            return (None,) * len(names)
        samples = from_wav(media)[1]
        start, end, tensors = read_segments(segments)
        feature = f"{len(start)}:{float((end - start).sum()):.4f}:{zlib.crc32(tensors.tobytes()):08x}"
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(start)

    def run(batches):
        for b in slices(batches, 64):
            rows = [figures(m.as_py(), s.as_py()) for m, s in zip(b.column(2), b.column(3), strict=True)]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], [id_col, "n_bytes", *names])

    return stored.select(id_col, "n_bytes", "media", "segments").mapInArrow(run, f"{id_col} {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_segments bigint")


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(audio_features(table(spark, sf_dir, "documents")))
