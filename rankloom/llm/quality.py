"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common

#: Kernel features, their width in standard deviations, ridge penalty a row, and bins of the calibration.
FEATURES, WIDTH, PENALTY, BINS, SEED = 384, 6.0, 1e-4, 256, 11
STATISTICS = 22

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
for _c in b"&*%$#^~@_=+<>\\{}[]":
    _CLASS[_c] = 4
_CLASS[33] = 5
_CLASS[124] = 6
for _c in b".,;:?'\"()-/":
    _CLASS[_c] = 7
_CLASS[10] = 8
_CLASS[[9, 11, 12, 13, 32]] = 9
_CLASS[128:] = 10


def _share(counts, total):
    return counts / np.maximum(total, 1)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS numbers for each text: sizes, kinds of characters, word lengths, and repetition."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row_of = np.repeat(np.arange(n), size)
    kinds = np.bincount(row_of * 11 + _CLASS[raw], minlength=n * 11).reshape(n, 11)
    starts, ends, row = common.words_of(raw, offsets)
    words = np.bincount(row, minlength=n)
    length = (ends - starts).astype(float)
    mean = _share(np.bincount(row, length, n), words)
    square = _share(np.bincount(row, length * length, n), words)
    h = common.spans(common.prefix_hash(common.fold(raw)), starts, ends) if len(raw) else np.zeros(0, np.uint64)

    def variety(of: np.ndarray, at: np.ndarray, total: np.ndarray):
        """Share of distinct values, and of the commonest, by text."""
        if not len(of):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((of, at))
        o, a = of[order], at[order]
        begins = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (a[1:] != a[:-1]))))
        runs = np.diff(np.append(begins, len(o)))
        top = np.zeros(n)
        np.maximum.at(top, a[begins], runs)
        return _share(np.bincount(a[begins], minlength=n), total), _share(top, total)

    distinct, top = variety(h, row, words)
    pair = row[1:] == row[:-1]
    again = np.bincount(row[1:][pair & (h[1:] == h[:-1])], minlength=n) if len(h) > 1 else np.zeros(n)
    grams = common.mix(h[1:] + common.mix(h[:-1]))[pair] if len(h) > 1 else h[:0]
    of = row[1:][pair] if len(h) > 1 else row[:0]
    pairs, _ = variety(grams, of, np.bincount(of, minlength=n))
    last = raw[ends - 1] if len(ends) else raw[:0]
    noisy = np.bincount(row[np.isin(_CLASS[last], (4, 5, 6))], minlength=n)
    upper = np.bincount(row[(_CLASS[raw[starts]] == 1) & (length > 2) & (_CLASS[raw[np.minimum(starts + 1, max(len(raw) - 1, 0))]] == 1)], minlength=n) if len(starts) else np.zeros(n)
    breaks = np.flatnonzero((raw[:-1] == 10)) + 1 if len(raw) > 1 else np.zeros(0, np.int64)
    line = np.unique(np.concatenate((offsets[:-1][size > 0], breaks)))
    stop = np.append(line[1:], len(raw))
    at = np.searchsorted(offsets, line, "right") - 1
    lines = np.bincount(at, minlength=n)
    distinct_lines, _ = variety(common.spans(common.prefix_hash(raw), line, np.minimum(stop, offsets[at + 1])) if len(line) else h[:0], at, lines)
    shares = [_share(kinds[:, k], size) for k in (1, 3, 4, 5, 6, 7, 8, 9, 10)]
    columns = [np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(square - mean * mean, 0)), *shares, distinct, top, _share(again, words), pairs, _share(noisy, words), _share(upper, words), distinct_lines, np.log1p(_share(size, lines)), _share(kinds[:, 7], words)]
    return np.stack(columns, axis=1)


def describe(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, stats): the statistics of each whole text; null reads as empty."""
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(raw, offsets) for _, _, raw, offsets in common.slices(batch)]
            flat = np.concatenate(rows) if rows else np.zeros((0, STATISTICS))
            lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, STATISTICS, dtype=np.int32), pa.array(flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], lists], names=["doc_id", *carry, "stats"])

    return docs.select("doc_id", "text", *carry).mapInArrow(common.tidy(run), f"doc_id long, {kinds}stats array<double>")


def _summed(rows: DataFrame, part, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over partitions of ``part(frame)``, an array of one shape: partitions add up, then about their root."""
    size = int(np.prod(shape))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for f in frames:
            total += part(f)
        yield pd.DataFrame({"sum": [total.astype("<f8").tobytes()]})

    def then(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for f in frames:
            for x in f["sum"]:
                total += np.frombuffer(x, "<f8")
        yield pd.DataFrame({"sum": [total.tobytes()]})

    partial = rows.mapInPandas(common.tidy(first), "sum binary")
    few = max(1, round(rows.rdd.getNumPartitions() ** 0.5))
    total = np.zeros(size)
    for r in partial.repartition(few).mapInPandas(then, "sum binary").toLocalIterator():
        total += np.frombuffer(r[0], "<f8")
    return total.reshape(shape)


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing means of neighbouring bins, by pooling adjacent violators; empty bins take their left's."""
    level: list[list[float]] = []
    for w, t in zip(weight.tolist(), total.tolist()):
        level.append([w, t, 1])
        while len(level) > 1 and level[-2][1] * level[-1][0] >= level[-1][1] * level[-2][0]:
            w2, t2, n2 = level.pop()
            level[-1] = [level[-1][0] + w2, level[-1][1] + t2, level[-1][2] + n2]
    return np.concatenate([np.full(int(n), t / w if w else 0.5) for w, t, n in level])


class Model:
    """mean, scale: of the statistics; draw, phase: the kernel features; beta: ridge; low, high, curve: calibration."""

    def __init__(self, mean, scale, beta, low, high, curve):
        draw = np.random.default_rng(SEED)
        self.draw = draw.normal(size=(STATISTICS, FEATURES)) / WIDTH
        self.phase = draw.uniform(0, 2 * np.pi, FEATURES)
        self.mean, self.scale, self.beta, self.low, self.high, self.curve = mean, scale, beta, low, high, curve

    def kernel(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.draw + self.phase) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.beta

    def bin(self, s: np.ndarray) -> np.ndarray:
        return np.clip((s - self.low) / (self.high - self.low) * BINS, 0, BINS - 1).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.curve[self.bin(self.raw(x))]


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["stats"].to_list()) if len(frame) else np.zeros((0, STATISTICS))


def fit(train: DataFrame) -> Model:
    """A model from ``train(doc_id, stats, label)``, over all its rows.

    Four fifths of the rows (by a hash of doc_id) give the ridge fit, from normal equations summed by partition; one
    fifth, unseen by it, gives the calibration: label means in BINS bins of the raw score, made monotonic, with a weak
    pull towards the raw score where bins have few rows. Without rows the score is 0.5 everywhere.
    """
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    rows = common.cut(train.withColumn("fold", fold))

    def moments(f: pd.DataFrame) -> np.ndarray:
        x = _matrix(f)
        return np.concatenate([[len(x), f["label"].sum()], x.sum(0), (x * x).sum(0)])

    m = _summed(rows, moments, (2 + 2 * STATISTICS,))
    n = m[0]
    if not n:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES + 1), -1.0, 1.0, np.full(BINS, 0.5))
    mean = m[2 : 2 + STATISTICS] / n
    scale = np.sqrt(np.maximum(m[2 + STATISTICS :] / n - mean**2, 1e-12))
    model = Model(mean, np.where(scale < 1e-5, 1, scale), np.zeros(FEATURES + 1), -0.5, 1.5, np.full(BINS, 0.5))

    def normal(f: pd.DataFrame) -> np.ndarray:
        z = model.kernel(_matrix(f))
        return np.vstack([z.T @ z, z.T @ f["label"].to_numpy(float)])

    k = FEATURES + 1

    def solved(part: DataFrame) -> np.ndarray:
        total = _summed(part, normal, (k + 1, k))
        return np.linalg.solve(total[:k] + np.eye(k) * PENALTY * max(total[k - 1, k - 1], 1), total[k])

    def binned(f: pd.DataFrame) -> np.ndarray:
        at = model.bin(model.raw(_matrix(f)))
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, f["label"].to_numpy(float), BINS)])

    model.beta = solved(rows.filter("NOT fold"))
    weight, total = _summed(rows.filter("fold"), binned, (2, BINS))
    prior = m[1] / n
    # a weak pull towards the raw score keeps bins without rows in order
    middle = np.clip(model.low + (np.arange(BINS) + 0.5) / BINS * (model.high - model.low), 0, 1)
    pull = 0.02 * max(weight.sum(), 1) / BINS
    model.curve = np.clip(isotonic(weight + pull, total + pull * (0.98 * middle + 0.02 * prior)), 0, 1)
    return model


def apply(stats: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, score)."""
    kinds = "".join(f"`{c}` {stats.schema[c].dataType.simpleString()}, " for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(model.score(x))], names=["doc_id", *carry, "score"])

    return stats.select("doc_id", *carry, "stats").mapInArrow(run, f"doc_id long, {kinds}score double")


def held_out(doc_id):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, held_out, score): the chance that a document's quality label is 1.

    Learns from labelled rows that are not held out (crc32 of doc_id mod 3 is not 1); of labels that repeat a doc_id the
    mean counts, null labels count for nothing. A null doc_id has no label and is not held out. Null and empty texts are
    scored as empty, very long ones whole; equal texts have equal scores, and repeated rows are scored each. Inputs of
    the score are statistics of the text alone. ``carry`` names columns to pass through (none of the result's names);
    all others are left out. An empty table gives an empty result.
    """
    if clash := {"doc_id", "text", "stats", "held_out", "score", "label", "fold"} & {*carry}:
        raise ValueError(f"carried columns clash with the result's: {sorted(clash)}")
    stats = common.cut(describe(docs, carry))
    known = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("label")).filter(~held_out("doc_id"))
    model = fit(stats.select("doc_id", "stats").join(known, "doc_id"))
    return apply(stats, model, carry).select("doc_id", *carry, held_out("doc_id").alias("held_out"), "score")
