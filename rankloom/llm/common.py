"""Helpers shared by the corpus operators: lineage cuts and vectorised text passes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's word pattern: runs of anything but space and bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)

#: Python passes work on slices of about so many bytes of text.
SLICE_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``. Only a local session may be without one: it gets a temporary folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="rankloom-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run``, a function of one or two tables or of batches, handing back at its end the memory that it has freed.

    Workers wait for their next task; what they still hold would count against the executor all the while.
    """

    def done(out):
        if not isinstance(out, Iterator):
            _give_back()
            return out

        def passed():
            yield from out
            _give_back()

        return passed()

    def one(a):
        return done(run(a))

    def two(a, b):
        return done(run(a, b))

    return one if run.__code__.co_argcount == 1 else two


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a few numbers that one task takes.
ROWS = 1 << 18


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a checkpoint or a written table of at most ``rows`` rows of a few numbers, in no more partitions than they are worth.

    What is joined or grouped after that has as few tasks, and a table of ROWS rows is not shuffled at all.
    """
    return df.coalesce(max(1, -(-rows // ROWS)))


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a new folder in the shared one, and read back."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts(df: DataFrame) -> int:
    """A number of shuffle buckets that follows the input: at least the session's, and one a scan split."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())


def lowered(text):
    """A-Z (and nothing else) in lower case; null reads as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """(first row, rows, bytes, offsets) of the batch's texts, about ``limit`` bytes at a time; null reads as empty.

    ``offsets`` has rows + 1 entries into ``bytes``.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last - first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words_of(raw: np.ndarray, offsets: np.ndarray):
    """Start and end of every word in the bytes, and the row it belongs to; no word crosses rows."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~_SPACE[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def fold(raw: np.ndarray) -> np.ndarray:
    return _FOLD[raw]


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, 0 to n."""
    have = _powers.get(0)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 2)
        up, down = np.full(size, _R, np.uint64), np.full(size, _R_INV, np.uint64)
        up[0] = down[0] = 1
        have = _powers[0] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * multiplier**position, modulo 2**64; spans() takes hashes of any span from them."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal values wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spaced(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each followed by one space, as bytes, and where each begins (with the total length at the end)."""
    sizes = ends - starts + 1
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    if not len(sizes):
        return raw[:0], at
    take = np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])
    out = raw[np.minimum(take, len(raw) - 1)]
    out[at[1:] - 1] = 32
    return out, at

