"""Folders of images, videos and frames as documents; sizes from file headers, identity from content."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes read as media, and the type each is sent under.
IMAGES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".tif": "image/tiff", ".tiff": "image/tiff", ".bmp": "image/bmp", ".gif": "image/gif"}
VIDEOS = {".mp4": "video/mp4", ".m4v": "video/mp4", ".mov": "video/quicktime", ".webm": "video/webm", ".mkv": "video/x-matroska", ".avi": "video/x-msvideo"}
HEADER = "width int, height int, frames long, seconds double, fps double"
_NONE = (None, None, None, None, None)


def _size(width: int, height: int) -> tuple:
    return (width, height, None, None, None) if 0 < width < 1 << 31 and 0 < height < 1 << 31 else _NONE


def _jpeg(b: bytes) -> tuple:
    at = 2
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return _NONE
        kind = b[at + 1]
        if kind == 0xFF:  # fill
            at += 1
            continue
        if kind in (0x01, *range(0xD0, 0xD9)):
            at += 2
            continue
        (length,) = struct.unpack_from(">H", b, at + 2)
        if kind == 0xDA or length < 2:  # the picture's data begin: no frame was declared
            return _NONE
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return _size(*struct.unpack_from(">HH", b, at + 5)[::-1]) if at + 9 <= len(b) and length >= 8 else _NONE
        at += 2 + length
    return _NONE


def _webp(b: bytes) -> tuple:
    kind = b[12:16]
    if kind == b"VP8X" and len(b) >= 30:
        return _size(1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little"))
    if kind == b"VP8 " and len(b) >= 30 and b[23:26] == b"\x9d\x01\x2a":
        return _size(*(x & 0x3FFF for x in struct.unpack_from("<HH", b, 26)))
    if kind == b"VP8L" and len(b) >= 25 and b[20] == 0x2F:
        bits = int.from_bytes(b[21:25], "little")
        return _size(1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
    return _NONE


def _tiff(b: bytes) -> tuple:
    e = "<" if b[:2] == b"II" else ">"
    (at,) = struct.unpack_from(e + "I", b, 4)
    if at + 2 > len(b):
        return _NONE
    (n,) = struct.unpack_from(e + "H", b, at)
    found = {}
    for i in range(n):
        if at + 14 + 12 * i > len(b):
            return _NONE
        tag, kind = struct.unpack_from(e + "HH", b, at + 2 + 12 * i)
        if tag in (256, 257) and kind in (3, 4):
            (found[tag],) = struct.unpack_from(e + ("H" if kind == 3 else "I"), b, at + 10 + 12 * i)
    return _size(found.get(256, 0), found.get(257, 0))


def _boxes(b: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the boxes in a stretch; a box that claims more than its stretch ends the walk."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", b, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            (size,) = struct.unpack_from(">Q", b, start + 8)
            body = start + 16
        size = end - start if size == 0 else size
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


def _inside(b: bytes, at: tuple[int, int], *path: bytes) -> tuple[int, int] | None:
    for kind in path:
        at = next(((x, y) for k, x, y in _boxes(b, *at) if k == kind), None)
        if at is None:
            return None
    return at


def _timed(b: bytes, at: tuple[int, int] | None) -> float | None:
    """Seconds that a header of scale and duration states; the version sets its fields' width."""
    if at is None or at[0] + 4 > at[1]:
        return None
    long = b[at[0]] == 1
    place = at[0] + 4 + (16 if long else 8)
    if place + (12 if long else 8) > at[1]:
        return None
    scale, duration = struct.unpack_from(">IQ" if long else ">II", b, place)
    return duration / scale if scale and duration and duration < (1 << 64 if long else 1 << 32) - 1 else None


def _movie(b: bytes) -> tuple:
    top = _inside(b, (0, len(b)), b"moov")
    if top is None:
        return _NONE
    for kind, x, y in _boxes(b, *top):
        handler = _inside(b, (x, y), b"mdia", b"hdlr") if kind == b"trak" else None
        if handler is None or b[handler[0] + 8 : handler[0] + 12] != b"vide":
            continue
        width = height = frames = None
        head = _inside(b, (x, y), b"tkhd")
        if head and head[1] - head[0] >= 84:
            width, height = (v >> 16 or None for v in struct.unpack_from(">II", b, head[1] - 8))
        sizes = _inside(b, (x, y), b"mdia", b"minf", b"stbl", b"stsz")
        if sizes and sizes[1] - sizes[0] >= 12:
            one, frames = struct.unpack_from(">II", b, sizes[0] + 4)
            if not one and sizes[0] + 12 + 4 * frames > sizes[1]:  # it claims more frames than it lists
                frames = None
        seconds = _timed(b, _inside(b, (x, y), b"mdia", b"mdhd")) or _timed(b, _inside(b, top, b"mvhd"))
        return width, height, frames or None, seconds, frames / seconds if frames and seconds else None
    return _NONE


def header(b: bytes | None) -> tuple:
    """(width, height, frames, seconds, fps) that a file's own header states; what it does not state, or cannot be true, is None.

    PNG, JPEG, GIF, BMP, WebP and TIFF have a size; MP4 and MOV and AVI a track's size, frames and length. Anything else,
    a header cut short and a size of zero are nothing. No pixel is decoded.
    """
    b = b or b""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return _size(*struct.unpack_from(">II", b, 16)) if b[12:16] == b"IHDR" and len(b) >= 24 else _NONE
        if b[:6] in (b"GIF87a", b"GIF89a"):
            return _size(*struct.unpack_from("<HH", b, 6))
        if b[:2] == b"\xff\xd8":
            return _jpeg(b)
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            return _webp(b)
        if b[:4] == b"RIFF" and b[8:16] == b"AVI LIST" and b[20:28] == b"hdrlavih":
            per, frames, width, height = *struct.unpack_from("<I", b, 32), *struct.unpack_from("<I", b, 48), *struct.unpack_from("<II", b, 64)
            fps = 1e6 / per if per else None
            return (*_size(width, height)[:2], frames or None, frames / fps if frames and fps else None, fps)
        if b[:2] == b"BM":
            return _size(*struct.unpack_from("<HH", b, 18)) if struct.unpack_from("<I", b, 14)[0] == 12 else _size(struct.unpack_from("<i", b, 18)[0], abs(struct.unpack_from("<i", b, 22)[0]))
        if b[:4] in (b"II*\x00", b"MM\x00*"):
            return _tiff(b)
        if b[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"wide"):
            return _movie(b)
    except struct.error:  # cut short
        pass
    return _NONE


def probed(files: DataFrame) -> DataFrame:
    """``files(path, content, ...)`` with sha256 and the header's fields instead of the content: read once, where the file is."""
    columns = [c for c in files.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header(x.as_py()) for x in batch.column(len(columns))]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]], names=[*columns, *[c.split()[0] for c in HEADER.split(", ")]])

    named = files.select(*columns, F.sha2("content", 256).alias("sha256"), "content")
    columns = [*columns, "sha256"]
    kinds = ", ".join(f"`{c}` {named.schema[c].dataType.simpleString()}" for c in columns)
    return named.mapInArrow(run, f"{kinds}, {HEADER}")


def _files(spark: SparkSession, folder: str, types: dict[str, str]) -> DataFrame:
    """Files of the given suffixes below a folder, whatever their suffix's case; ``below`` is the path from it on."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    root = re.sub(r"^\w+:/*", "/", folder.rstrip("/"))
    rows = rows.withColumn("mime", F.element_at(F.create_map(*[F.lit(x) for kv in types.items() for x in kv]), suffix)).filter("mime IS NOT NULL")
    # what stands behind the folder's own name in the file's address
    return rows.withColumn("below", F.regexp_replace(F.substring_index("path", f"{root}/", -1), r"\.[^./]+$", ""))


def read_media(spark: SparkSession, folder: str, types: dict[str, str] | None = None, hashed: bool = False) -> DataFrame:
    """(doc_id, uri, mime, num_bytes), with ``hashed`` sha256 and the header's fields too: a document a file below ``folder``.

    doc_id is the path from the folder on, without the suffix; two files of one id are refused. Without ``hashed`` only the
    listing is read: Spark leaves the content column out of the scan.
    """
    rows = _files(spark, folder, IMAGES if types is None else types)
    keep = [F.col("below").alias("doc_id"), F.col("path").alias("uri"), "mime", F.col("length").alias("num_bytes")]
    ids = rows.groupBy("below").agg(F.count("*").alias("n")).filter("n > 1").orderBy("below").limit(5).collect()
    if ids:
        raise ValueError(f"several files of one document: {[r.below for r in ids]}")
    return probed(rows.select(*keep, "content")) if hashed else rows.select(*keep)


def natural(name):
    """A key that orders names by their numbers' values: every run of digits is led by its length."""
    bare = F.regexp_replace(name, r"(?<!\d)0+(?=\d)", "")
    return F.transform(F.regexp_extract_all(bare, F.lit(r"\d+|\D+"), F.lit(0)), lambda p: F.struct(F.when(p.rlike(r"^\d"), F.length(p)).otherwise(0).alias("digits"), p.alias("part")))


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, uris, num_bytes): a document a folder of frames below ``folder``, its images in the natural order of their names.

    frame_2 stands before frame_10; equal numbers go by the name itself. Images that stand in ``folder`` itself are no
    document's frames.
    """
    rows = _files(spark, folder, IMAGES).filter(F.instr("below", "/") > 0)
    name = F.substring_index("below", "/", -1)
    frames = F.sort_array(F.collect_list(F.struct(natural(name).alias("key"), name.alias("name"), F.col("path").alias("uri"))))
    rows = rows.groupBy(F.regexp_replace("below", "/[^/]*$", "").alias("doc_id")).agg(frames.alias("f"), F.sum("length").alias("num_bytes"))
    return rows.select("doc_id", F.transform("f", lambda x: x["uri"]).alias("uris"), "num_bytes")
