"""Headers of files made here byte by byte, whole, cut short and lying; folders as documents."""

import hashlib
import struct
import zlib

import pytest

from rankloom.sources import media


def png(w, h):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0")) + chunk(b"IEND", b"")


def jpeg(w, h, sof=0xC2):
    part = lambda k, d: bytes((0xFF, k)) + struct.pack(">H", len(d) + 2) + d
    return b"\xff\xd8" + part(0xE0, b"JFIF\0" + bytes(9)) + b"\xff" + part(0xC4, bytes(30)) + part(sof, struct.pack(">BHHB", 8, h, w, 3) + bytes(9)) + part(0xDA, bytes(6)) + b"\0\0\xff\xd9"


def box(kind, *body, wide=False):
    d = b"".join(body)
    return struct.pack(">I4sQ", 1, kind, len(d) + 16) + d if wide else struct.pack(">I4s", len(d) + 8, kind) + d


def mp4(w=640, h=360, frames=50, scale=1000, duration=2000, listed=None, version=0, handler=b"vide", wide=False):
    times = struct.pack(">B3xQQIQ", 1, 0, 0, scale, duration) if version else struct.pack(">B3xIIII", 0, 0, 0, scale, duration)
    sizes = struct.pack(">III", 0, 0, frames) + bytes(4 * (frames if listed is None else listed))
    track = box(b"trak", box(b"tkhd", bytes(76), struct.pack(">II", w << 16, h << 16)), box(b"mdia", box(b"mdhd", times, bytes(4)), box(b"hdlr", bytes(8), handler, bytes(12)), box(b"minf", box(b"stbl", box(b"stsz", sizes)))))
    sound = box(b"trak", box(b"mdia", box(b"hdlr", bytes(8), b"soun", bytes(12))))
    return box(b"ftyp", b"isom", bytes(4)) + box(b"mdat", bytes(100), wide=wide) + box(b"moov", box(b"mvhd", times, bytes(80)), sound, track)


def avi(w, h, frames, per):
    body = struct.pack("<IIIIIIIIII", per, 0, 0, 0, frames, 0, 1, 0, w, h) + bytes(16)
    return b"RIFF" + struct.pack("<I", 200) + b"AVI LIST" + struct.pack("<I", 100) + b"hdrlavih" + struct.pack("<I", 56) + body


WEBP = {
    "VP8X": b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (639).to_bytes(3, "little") + (359).to_bytes(3, "little"),
    "VP8 ": b"RIFF\0\0\0\0WEBPVP8 \x0a\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 640 | 1 << 14, 360),
    "VP8L": b"RIFF\0\0\0\0WEBPVP8L\x0a\0\0\0\x2f" + (639 | 359 << 14).to_bytes(4, "little"),
}
TIFF = {e: {"<": b"II", ">": b"MM"}[e] + struct.pack(e + "HI", 42, 8) + struct.pack(e + "H", 2) + struct.pack(e + "HHIHH", 256, 3, 1, 640, 0) + struct.pack(e + "HHII", 257, 4, 1, 360) + bytes(4) for e in "<>"}
STILL = [png(640, 360), jpeg(640, 360), jpeg(640, 360, 0xC0), b"GIF89a" + struct.pack("<HH", 640, 360) + b"\0\0\0", b"BM" + bytes(12) + struct.pack("<Iii", 40, 640, -360), *WEBP.values(), *TIFF.values()]


@pytest.mark.parametrize("data", STILL)
def test_sizes(data):
    assert media.header(data) == (640, 360, None, None, None)
    for n in range(len(data)):  # cut anywhere, a header gives its own size or nothing
        assert media.header(data[:n]) in ((640, 360, None, None, None), (None,) * 5)
    assert media.header(data[:7]) == (None,) * 5


def test_videos():
    whole = (640, 360, 50, 2.0, 25.0)
    assert media.header(mp4()) == media.header(mp4(version=1)) == media.header(mp4(wide=True)) == whole
    assert media.header(avi(640, 360, 50, 40_000)) == whole
    assert media.header(mp4(listed=3)) == (640, 360, None, 2.0, None)  # claims more frames than it lists
    assert media.header(mp4(scale=0)) == (640, 360, 50, None, None) and media.header(mp4(duration=0xFFFFFFFF)) == (640, 360, 50, None, None)
    assert media.header(mp4(handler=b"text")) == (None,) * 5 and media.header(mp4()[:-40]) == (None,) * 5
    lying = bytearray(mp4())
    lying[16:20] = struct.pack(">I", 1 << 30)  # a box longer than the file
    assert media.header(bytes(lying)) == (None,) * 5
    for bad in (None, b"", b"text", png(0, 5), png(5, 0), jpeg(0, 3), b"\xff\xd8\xff\xda\0\2", b"\xff\xd8\xff\xc0\0\0"):
        assert media.header(bad) == (None,) * 5


def test_folders_are_documents(spark, tmp_path):
    root = tmp_path / "pages"
    for name, data in {"a/page_2.PNG": png(3, 4), "a/page_10.jpg": jpeg(5, 6), "b.webp": WEBP["VP8X"], "broken.png": b"x", "note.txt": b"no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    plain = media.read_media(spark, str(root))
    assert sorted((r.doc_id, r.mime, r.num_bytes) for r in plain.collect()) == [("a/page_10", "image/jpeg", len(jpeg(5, 6))), ("a/page_2", "image/png", len(png(3, 4))), ("b", "image/webp", 30), ("broken", "image/png", 1)]
    scan = plain._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert "content" not in scan  # only the listing is read
    got = {r.doc_id: r for r in media.read_media(spark, str(root), hashed=True).collect()}
    assert {k: (r.width, r.height) for k, r in got.items()} == {"a/page_2": (3, 4), "a/page_10": (5, 6), "b": (640, 360), "broken": (None, None)}
    assert got["broken"].sha256 == hashlib.sha256(b"x").hexdigest()
    (root / "b.png").write_bytes(png(1, 1))
    with pytest.raises(ValueError, match=r"one document: \['b'\]"):
        media.read_media(spark, str(root))
    (root / "clip.mp4").write_bytes(mp4())
    clip = media.read_media(spark, str(root), media.VIDEOS, hashed=True).first()
    assert (clip.doc_id, clip.mime, clip.frames, clip.fps) == ("clip", "video/mp4", 50, 25.0)


def test_frames_stand_in_natural_order(spark, tmp_path):
    names = ["f10", "f9", "f2", "f02", "f1a", "f1", "g", "f100", "f99b2", "f99b10"]
    for d in ("one", "deep/two"):
        (tmp_path / d).mkdir(parents=True)
        for n in names:
            (tmp_path / d / f"{n}.png").write_bytes(b"12")
    (tmp_path / "stray.png").write_bytes(b"1")
    got = {r.doc_id: ([u.rsplit("/", 1)[1][:-4] for u in r.uris], r.num_bytes) for r in media.read_frames(spark, str(tmp_path)).collect()}
    want = ["f1", "f1a", "f02", "f2", "f9", "f10", "f99b2", "f99b10", "f100", "g"]
    assert got == {"one": (want, 20), "deep/two": (want, 20)}
