"""Stores of embeddings in .npy buffers, read by ranges of bytes: one matrix, or a flat buffer of several vectors an item."""

from __future__ import annotations

import ast
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A partition holds about so many bytes of vectors, and a batch of it.
PARTITION, BATCH = 64 << 20, 4 << 20
SCHEMA_ID = "embedding-store.v1"


@dataclass(frozen=True)
class Array:
    """What a .npy file's header says, and where its data begin."""

    path: str
    dtype: str
    shape: tuple[int, ...]
    begins: int

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.dtype).itemsize * int(np.prod(self.shape[1:], dtype=np.int64))


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def npy_header(path: str) -> Array:
    """The header of a .npy file in C order; a shape that the file's size does not hold is refused."""
    with _open(path) as f:
        start = f.read(12)
        if start[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} is no .npy file")
        size, begins = (struct.unpack_from("<H", start, 8)[0], 10) if start[6] == 1 else (struct.unpack_from("<I", start, 8)[0], 12)
        f.seek(begins)
        said = ast.literal_eval(f.read(size).decode("latin1"))
        if said["fortran_order"]:
            raise ValueError(f"{path} is not in C order")
        out = Array(path, said["descr"], tuple(said["shape"]), begins + size)
        if f.size() < out.begins + int(np.prod(out.shape, dtype=np.int64)) * np.dtype(out.dtype).itemsize:
            raise ValueError(f"{path} is cut short: it does not hold {out.shape} of {out.dtype}")
        return out


def npy_rows(array: Array, first: int, last: int, file=None) -> np.ndarray:
    """Rows ``first`` to before ``last``: only their bytes are read."""
    with file or _open(array.path) as f:
        f.seek(array.begins + first * array.row_bytes)
        data = f.read((last - first) * array.row_bytes)
    return np.frombuffer(data, array.dtype).reshape(last - first, *array.shape[1:])


@dataclass
class _Range(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, vectors: Array, offsets: Array | None, size: int):
        self.vectors, self.offsets, self.size = vectors, offsets, size

    def partitions(self) -> list[InputPartition]:
        items = self.vectors.shape[0] if self.offsets is None else self.offsets.shape[0] - 1
        each = max(1, self.size * items // max(1, self.vectors.shape[0] * self.vectors.row_bytes)) if items else 1
        return [_Range(a, min(items, a + each)) for a in range(0, items, each)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        v = self.vectors
        kind = pa.float64() if np.dtype(v.dtype).itemsize == 8 else pa.float32()
        width = v.shape[1]

        def batch(first: int, rows: np.ndarray, ends: np.ndarray | None) -> pa.RecordBatch:
            values = pa.array(rows.reshape(-1).astype(kind.to_pandas_dtype()), kind)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), values)
            if ends is not None:
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lists)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(lists))), lists], names=["item", "vector"])

        if self.offsets is None:
            step = max(1, BATCH // max(1, v.row_bytes))
            for a in range(partition.first, partition.last, step):
                b = min(partition.last, a + step)
                yield batch(a, npy_rows(v, a, b), None)
            return
        if partition.last == partition.first:
            return
        at = npy_rows(self.offsets, partition.first, partition.last + 1).astype(np.int64)
        if (np.diff(at) < 0).any() or at[0] < 0 or at[-1] > v.shape[0]:
            raise ValueError(f"{self.offsets.path}: offsets that fall or leave the buffer")
        a = 0
        while a < len(at) - 1:
            b = max(a + 1, int(np.searchsorted(at, at[a] + BATCH // max(1, v.row_bytes), "right")) - 1)
            b = min(b, len(at) - 1)
            yield batch(partition.first + a, npy_rows(v, int(at[a]), int(at[b])), at[a : b + 1] - at[a])
            a = b


class VectorSource(DataSource):
    """Format ``rankloom_vectors``: (item, vector) of one side of a store; options ``path``, ``side``, ``partition`` (bytes).

    ``path`` holds ``<side>.npy`` and, for several vectors an item, ``<side>_offsets.npy`` with ``ragged`` set.
    """

    @classmethod
    def name(cls) -> str:
        return "rankloom_vectors"

    def _arrays(self) -> tuple[Array, Array | None]:
        base = f"{self.options['path'].rstrip('/')}/{self.options.get('side', 'corpus')}"
        vectors = npy_header(f"{base}.npy")
        if len(vectors.shape) != 2 or np.dtype(vectors.dtype).kind != "f":
            raise ValueError(f"{vectors.path} holds no vectors: {vectors.shape} of {vectors.dtype}")
        if self.options.get("ragged", "false").lower() != "true":
            return vectors, None
        offsets = npy_header(f"{base}_offsets.npy")
        if len(offsets.shape) != 1 or offsets.shape[0] < 1 or np.dtype(offsets.dtype).kind not in "iu":
            raise ValueError(f"{offsets.path} holds no offsets")
        ends = [int(npy_rows(offsets, i, i + 1)[0]) for i in (0, offsets.shape[0] - 1)]
        if ends != [0, vectors.shape[0]]:
            raise ValueError(f"{offsets.path}: offsets from {ends[0]} to {ends[1]} over {vectors.shape[0]} vectors")
        return vectors, offsets

    def schema(self) -> str:
        vectors, offsets = self._arrays()
        one = "array<double>" if np.dtype(vectors.dtype).itemsize == 8 else "array<float>"
        return f"item long, vector {one if offsets is None else f'array<{one}>'}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._arrays(), int(self.options.get("partition", PARTITION)))


def read_store(spark: SparkSession, folder: str, side: str = "corpus", partition: int = PARTITION) -> DataFrame:
    """(id, vector) of a store's ``corpus`` or ``queries``: its record names the ids, the layout, the width and the kind of number.

    ``store.json`` has layout (``single`` or ``ragged``), full_width, dtype, count and query_count, doc_ids and query_ids. A
    store whose arrays differ from its record is refused, by headers alone, before any vector is read. Vectors come in
    partitions of byte ranges; ids are one JSON line, exploded by Spark and joined by place.
    """
    ids, count = ("doc_ids", "count") if side == "corpus" else ("query_ids", "query_count")
    record = spark.read.option("multiLine", "true").schema(
        "layout string, full_width int, dtype string, count long, query_count long, doc_ids array<string>, query_ids array<string>"
    ).json(f"{folder}/store.json")
    said = record.select("layout", "full_width", "dtype", F.col(count).alias("n"), F.size(ids).alias("ids")).first()
    if said is None or said.layout not in ("single", "ragged"):
        raise ValueError(f"{folder}/store.json is no record of a store")
    ragged = said.layout == "ragged"
    spark.dataSource.register(VectorSource)
    options = {"path": folder, "side": side, "ragged": str(ragged).lower(), "partition": str(partition)}
    vectors, offsets = VectorSource(options)._arrays()
    held = vectors.shape[0] if offsets is None else offsets.shape[0] - 1
    if vectors.shape[1] != said.full_width or np.dtype(vectors.dtype) != np.dtype(said.dtype) or not held == said.n == said.ids:
        raise ValueError(f"{folder}: the record says {said.n} of {said.full_width} {said.dtype} and names {said.ids}; {side} holds {held} of {vectors.shape[1]} {vectors.dtype}")
    rows = spark.read.format("rankloom_vectors").options(**options).load()
    named = record.select(F.posexplode(ids).alias("item", "id")).withColumn("item", F.col("item").cast("long"))
    return rows.join(named, "item").select("id", "vector")


def write_store(folder: str, doc_ids: list[str], corpus, query_ids: list[str], queries, ragged: bool) -> None:
    """A small store from arrays at hand, the record last: what is written is what ``read_store`` takes. Local folders only."""
    from pathlib import Path

    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    for side, items in (("corpus", corpus), ("queries", queries)):
        if ragged:
            np.save(root / f"{side}_offsets.npy", np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(np.int64))
        np.save(root / f"{side}.npy", np.concatenate(items) if ragged else np.asarray(items))
    sample = np.concatenate(corpus) if ragged else np.asarray(corpus)
    record = {"schema": SCHEMA_ID, "layout": "ragged" if ragged else "single", "full_width": sample.shape[1], "dtype": str(sample.dtype), "count": len(doc_ids), "query_count": len(query_ids), "doc_ids": doc_ids, "query_ids": query_ids}
    (root / "store.json").write_text(json.dumps(record))
