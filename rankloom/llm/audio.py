"""Media columns: texts stored as 8-bit sound, and the features read back from it."""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Samples a second as stored and as analysed; the resampler's factors.
STORED_RATE, UP, DOWN = 16_000, 3, 4
#: Payloads are padded with spaces to a positive multiple of this: one hop of the analysis.
UNIT = 192
HOP = UNIT * UP // DOWN
FRAME, BANDS, TAPS = 2 * HOP, 20, 8
#: Shape of a stored tensor: frames by bands.
PATCH = (16, BANDS)
#: A segment opens this far (dB) above the median energy and closes that far below it.
OPEN_DB, CLOSE_DB = 0.25, -0.1
#: Frames analysed at a time.
STEP = 4096


def _filters() -> np.ndarray:
    """The low-pass filter's taps by phase (UP x TAPS): a Hann-windowed sinc."""
    n = UP * TAPS
    t = (np.arange(n) - (n - 1) / 2) / max(UP, DOWN)
    taps = np.sinc(t) * np.hanning(n + 2)[1:-1]
    taps *= UP / taps.sum()
    return np.stack([taps[p::UP][::-1] for p in range(UP)])


def _bank() -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale (bins x BANDS)."""
    rate = STORED_RATE * UP / DOWN
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    return np.maximum(0, np.minimum((f - hz[:-2]) / (hz[1:-1] - hz[:-2]), (hz[2:] - f) / (hz[2:] - hz[1:-1])))


FILTERS, BANK, WINDOW = _filters(), _bank(), np.hanning(FRAME + 1)[:-1]


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(STORED_RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def resample(samples: np.ndarray) -> np.ndarray:
    """UP / DOWN times as many samples, by one short filter for each phase of the output."""
    n = len(samples) * UP // DOWN
    padded = np.concatenate((np.zeros(TAPS - 1), samples, np.zeros(DOWN)))
    view = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n)
    for p in range(min(UP, n)):
        m = np.arange(p, n, UP)
        at = m[0] * DOWN // UP
        out[m] = view[at :: DOWN][: len(m)] @ FILTERS[m[0] * DOWN % UP]
    return out


def log_mel(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel bands (frames x BANDS) and energy in dB of each frame, STEP frames at a time with their overlap."""
    frames = len(payload) // UNIT
    mel, energy = np.empty((frames, BANDS), np.float32), np.empty(frames)
    raw = np.frombuffer(payload, np.uint8)
    for a in range(0, frames, STEP):
        b = min(frames, a + STEP)
        lead = min(a, 1) * UNIT  # the filter's history
        some = (raw[a * UNIT - lead : (b + 1) * UNIT].astype(np.float64) - 128) / 128
        sound = resample(some)[lead * UP // DOWN :]
        sound = np.pad(sound, (0, (b - a) * HOP + HOP - len(sound))) if len(sound) < (b - a + 1) * HOP else sound
        view = np.lib.stride_tricks.sliding_window_view(sound, FRAME)[::HOP][: b - a]
        view = view - view.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(view * WINDOW, axis=1)) ** 2
        mel[a:b] = np.log10(power @ BANK + 1e-6)
        energy[a:b] = 10 * np.log10((view * view).mean(axis=1) + 1e-9)
    return mel, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames from an energy above the opening threshold up to one below the closing threshold."""
    middle = np.median(energy)
    event = np.where(energy >= middle + OPEN_DB, 1, np.where(energy < middle + CLOSE_DB, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.concatenate(([0], np.where(last >= 0, event[last], -1) > 0, [0])).astype(np.int8)
    edge = np.diff(on)
    return list(zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()))


def tensors(mel: np.ndarray, spans: list[tuple[int, int]]) -> pa.Table:
    """(start_s, end_s, tensor): the segments cut into patches of PATCH, the last of each padded with zeros."""
    second = STORED_RATE / UNIT
    cut = [(a, min(a + PATCH[0], end)) for start, end in spans for a in range(start, end, PATCH[0])]
    data = np.zeros((len(cut), *PATCH), np.float32)
    for i, (a, b) in enumerate(cut):
        data[i, : b - a] = mel[a:b]
    kind = pa.fixed_shape_tensor(pa.float32(), PATCH)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(data.reshape(-1)), PATCH[0] * PATCH[1])
    times = [pa.array([x[i] / second for x in cut], pa.float64()) for i in (0, 1)]
    return pa.table([*times, pa.ExtensionArray.from_storage(kind, flat)], names=["start_s", "end_s", "tensor"])


def to_ipc(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 bytes, padded with spaces, as a WAV file of 8-bit samples.

    A null text is empty; an empty text is UNIT spaces. Repeated rows give equal media.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                sizes.append(len(data))
                media.append(to_wav(data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")))
                if len(media) >= 256:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[len(sizes) - len(media) : len(sizes)], pa.array(sizes[-len(media) :], pa.int64()), pa.array(media, pa.binary())], names=names)
                    media = []
            if media:
                yield pa.RecordBatch.from_arrays([batch.column(0)[len(sizes) - len(media) : len(sizes)], pa.array(sizes[-len(media) :], pa.int64()), pa.array(media, pa.binary())], names=names)

    names = ["doc_id", "n_bytes", "media"]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """``media(doc_id, n_bytes, media)`` with what is read back from the stored file.

    payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes); n_frames; spans: the loud segments in seconds;
    tensors: an Arrow stream of (start_s, end_s, fixed-shape tensor), see ``tensors``; feature: counts, a digest of all
    bands and segments, and one of the tensors and their times as read back from that stream, at two decimals. Equal
    media give equal values, repeated rows repeated rows, and an empty table none. A file of any length is analysed STEP
    frames at a time, its bands held once; other columns than these three are left out.
    """

    def one(data: bytes) -> tuple:
        payload = from_wav(data)
        mel, energy = log_mel(payload)
        spans = segments(energy)
        stored = to_ipc(tensors(mel, spans))
        back = from_ipc(stored)
        patches = back["tensor"].combine_chunks().storage.flatten().to_numpy() if back.num_rows else np.zeros(0)
        times = np.rint(np.stack((back["start_s"].to_numpy(), back["end_s"].to_numpy())) * STORED_RATE).astype("<i8").tobytes()
        held = hashlib.sha256(np.rint(patches * 100).astype("<i2").tobytes() + times).hexdigest()[:32]
        coarse = np.rint(mel * 100).astype("<i2").tobytes()
        loud = sum(b - a for a, b in spans)
        feature = f"frames={len(mel)};segments={len(spans)};loud={loud};mel={hashlib.sha256(coarse + struct.pack(f'<{2 * len(spans)}q', *[x for s in spans for x in s])).hexdigest()[:32]};tensors={back.num_rows}:{held}"
        second = STORED_RATE / UNIT
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(mel), [{"start_s": a / second, "end_s": b / second} for a, b in spans], stored, feature

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.binary(), pa.string()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "n_frames", "spans", "tensors", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = [one(m.as_buffer().to_pybytes()) for m in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=["doc_id", "n_bytes", "media", *names])

    return media.mapInArrow(run, "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, n_frames long, spans array<struct<start_s: double, end_s: double>>, tensors binary, feature string")
