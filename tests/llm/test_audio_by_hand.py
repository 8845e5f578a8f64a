"""The audio features against a second computation: zero-stuffing and one long filter, and transforms by their definition."""

import cmath
import hashlib
import math
import random
import struct

import numpy as np

from rankloom.llm import audio


def resampled(x):
    """Three times the rate by zeros between the samples, one filter over all of it, every fourth value."""
    n = audio.UP * audio.TAPS
    t = (np.arange(n) - (n - 1) / 2) / max(audio.UP, audio.DOWN)
    taps = np.array([(math.sin(math.pi * v) / (math.pi * v) if v else 1.0) * (0.5 - 0.5 * math.cos(2 * math.pi * (i + 1) / (n + 1))) for i, v in enumerate(t)])
    taps *= audio.UP / taps.sum()
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    return np.convolve(up, taps)[: len(up)][:: audio.DOWN]


def bands(payload):
    sound = resampled((np.frombuffer(payload, np.uint8).astype(float) - 128) / 128)
    frames = len(payload) // audio.UNIT
    sound = np.concatenate((sound, np.zeros(audio.FRAME)))
    rate, n = audio.STORED_RATE * audio.UP / audio.DOWN, audio.FRAME
    top = 2595 * math.log10(1 + rate / 2 / 700)
    hz = [700 * (10 ** (top * i / (audio.BANDS + 1) / 2595) - 1) for i in range(audio.BANDS + 2)]
    out, energy = [], []
    for f in range(frames):
        part = sound[f * audio.HOP : f * audio.HOP + n]
        part = part - part.mean()
        shaped = part * np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)])
        power = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / n) for i, v in enumerate(shaped))) ** 2 for k in range(n // 2 + 1)]
        row = []
        for b in range(audio.BANDS):
            lo, mid, hi = hz[b : b + 3]
            row.append(sum(p * max(0, min((k * rate / n - lo) / (mid - lo), (hi - k * rate / n) / (hi - mid))) for k, p in enumerate(power)))
        out.append([math.log10(v + 1e-6) for v in row])
        energy.append(10 * math.log10((part * part).mean() + 1e-9))
    return np.array(out), np.array(energy)


def test_bands_and_energy_by_definition():
    r = random.Random(2)
    payload = bytes(r.choice(b"etaoin shrdlu,.ABC\n") for _ in range(audio.UNIT * 6))
    mel, energy = audio.log_mel(payload)
    want, loud = bands(payload)
    # the last frame reaches beyond the sound in both
    assert np.abs(mel - want).max() < 1e-4 and np.abs(energy - loud).max() < 1e-6


def test_feature_depends_on_the_stored_tensors(spark):
    r = random.Random(3)
    text = "".join(r.choice("abc ") for _ in range(9000)) + "Z" * 3000 + "".join(r.choice("xyz,. ") for _ in range(9000))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, text)], "doc_id long, text string")
    rows = {x.doc_id: x for x in audio.features(audio.encode(docs)).collect()}
    assert rows[1].feature == rows[4].feature and rows[2].feature == rows[3].feature
    for x in rows.values():
        mel, energy = audio.log_mel(audio.from_wav(bytes(x.media)))
        spans = audio.segments(energy)
        back = audio.from_ipc(bytes(x.tensors))
        second = audio.STORED_RATE / audio.UNIT
        cut = [(a, min(a + audio.PATCH[0], end)) for begin, end in spans for a in range(begin, end, audio.PATCH[0])]
        assert back["start_s"].to_pylist() == [a / second for a, _ in cut] and back["end_s"].to_pylist() == [b / second for _, b in cut]
        flat = []
        for (a, b), t in zip(cut, back["tensor"].combine_chunks().to_numpy_ndarray() if cut else []):
            assert t.shape == audio.PATCH and (t[: b - a] == mel[a:b]).all() and not t[b - a :].any()
            flat.append(t.ravel())
        data = np.rint(np.concatenate(flat) * 100).astype("<i2").tobytes() if flat else b""
        times = [round(a * audio.UNIT) for a, _ in cut] + [round(b * audio.UNIT) for _, b in cut]
        digest = hashlib.sha256(data + struct.pack(f"<{len(times)}q", *times)).hexdigest()[:32]
        assert x.feature.endswith(f";tensors={len(cut)}:{digest}")
