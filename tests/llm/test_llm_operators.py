import collections
import hashlib
import math
import os
import pathlib
import random
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import anchors, audio, common, components, embeddings, fm_dedup, mixing, pieces, pitman_yor, quality, repeats, simhash, suffix_dedup, urls
from tests.llm.conftest import LOW, WORD

BIG = 1 << 62


def reach(links, nodes):
    low = {n: n for n in nodes}
    change = True
    while change:
        change = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                change = True
    return low


# ---- 1: media columns


def test_audio_round_trip(docs, texts):
    rows = audio.features(audio.encode(docs)).collect()
    assert len(rows) == len(texts)
    by_text = collections.defaultdict(set)
    want = collections.Counter()
    for _, t in texts:
        b = (t or "").encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192, b" ")
        want[len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    got = collections.Counter((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows)
    assert got == want
    for r in rows:
        by_text[r.payload_sha256].add((r.feature, bytes(r.media)))
        table = audio.from_ipc(bytes(r.tensors))
        assert table.schema.field("tensor").type.shape == list(audio.PATCH)
        assert audio.from_wav(bytes(r.media)) is not None and r.n_frames == r.payload_bytes // 192
    assert all(len(v) == 1 for v in by_text.values())


def test_audio_blocks_agree_with_one_pass(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 192 * 40, dtype=np.uint8).tobytes()
    mel, energy = audio.log_mel(data)
    monkeypatch.setattr(audio, "STEP", 7)
    again, energy2 = audio.log_mel(data)
    assert np.allclose(mel, again, atol=1e-4) and np.allclose(energy, energy2, atol=1e-6)


def test_resampler_is_a_polyphase_filter():
    x = np.random.default_rng(2).normal(size=96)
    up = np.zeros(96 * 3)
    up[::3] = x
    taps = np.zeros(24)
    for p in range(3):
        taps[p::3] = audio.FILTERS[p][::-1]
    assert np.allclose(np.convolve(up, taps)[: 96 * 3 : 4], audio.resample(x))


def test_hysteresis():
    e = np.array([0, 0, 1, 0, 0, -1, 0, 1, 0, -1, 0.0])
    assert audio.segments(e) == [(2, 5), (7, 9)]


# ---- 2 and 7: repeated passages


def brute_bytes(rows, length):
    first = {}
    last = BIG
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, last), last if i is None else i)
    out = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (last if i is None else i):
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for j in range(len(gone)) if gone[j] and (not j or not gone[j - 1]))
        out[i, len(b), sum(gone), spans, bytes(x for x, y in zip(b, gone) if not y)] += 1
    return out


def brute_words(rows, length):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            first[k] = min(first.get(k, BIG), BIG if i is None else i)
    out = collections.Counter()
    for i, w in split:
        gone = [0] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (BIG if i is None else i):
                gone[s : s + length] = [1] * length
        out[i, len(w), sum(gone), " ".join(x for x, y in zip(w, gone) if not y).encode()] += 1
    return out


@pytest.mark.parametrize("length, hot", [(50, 1 << 14), (31, 1 << 14), (50, 4)])
def test_suffix_dedup(docs, texts, length, hot):
    rows = suffix_dedup.dedup(docs, length, carry=("source", "key"), hot=hot).collect()
    assert collections.Counter((r.doc_id, r.size, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows) == brute_bytes(texts, length)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in rows)


@pytest.mark.parametrize("length, hot", [(13, 1 << 14), (4, 1 << 14), (13, 4)])
def test_fm_dedup(docs, texts, length, hot):
    rows = fm_dedup.dedup(docs, length, hot=hot).collect()
    assert collections.Counter((r.doc_id, r.size, r.n_removed, bytes(r.kept)) for r in rows) == brute_words(texts, length)


def test_hot_anchor_is_split(spark):
    """One gram in very many contexts: its windows are dealt by content, and the result is whole."""
    r = random.Random(8)
    line = "the common line that everyone has"
    rows = [(i, f"{r.randrange(1 << 60):x} {line} {r.randrange(300):x} {r.randrange(3)} and some more of it here") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.Counter((x.doc_id, x.size, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.dedup(docs, hot=64).collect())
    assert got == brute_bytes(rows, 50)
    unit = repeats.Unit(False, 50, 20)
    table = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "block": pa.array([0] * len(rows), pa.int32())})
    seen = repeats._seen(unit, 8, 64)(table)
    named = sum(int.from_bytes(x[:8], "little") // 8 for x in seen["anchor"].to_pylist())
    split = sum(int.from_bytes(x[:8], "little") // 8 for x in seen["hot"].to_pylist())
    assert 0 < split < 30 and named < len(rows) * 20  # the split anchors' contexts do not travel


def test_copies_send_little_for_each_byte(spark):
    """What is shuffled stays well below the bytes of text times two, though every stretch is another document's too."""
    r = random.Random(11)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(500)) for _ in range(300)]
    rows = [(i + 300 * k, t) for k in range(4) for i, t in enumerate(texts)]
    root = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", tempfile.gettempdir())
    shuffles = lambda: {p: p.stat().st_size for p in pathlib.Path(root).glob("**/blockmgr-*/*/shuffle_*.data")}
    before = shuffles()
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), want=("size", "n_removed")).collect()
    assert all(x.n_removed == (x.size if x.doc_id >= 300 else 0) for x in got) and len(got) == len(rows)
    sent = sum(n for p, n in shuffles().items() if p not in before) / sum(x.size for x in got)
    assert 0 < sent < 1.9, sent


def test_spans_that_overlap_or_touch_are_one():
    row, first, end = np.array([1, 0, 0, 0, 1, 0]), np.array([5, 0, 4, 30, 5, 12]), np.array([9, 10, 6, 40, 7, 30])
    got = [x.tolist() for x in repeats._joined(row, first, end)]
    assert got == [[0, 0, 1], [0, 12, 5], [10, 40, 9]]
    assert [len(x) for x in repeats._joined(*[row[:0]] * 3)] == [0, 0, 0]


def test_passages_in_very_long_texts(spark):
    """Texts beyond a slice and a piece, with repeats across their edges."""
    r = random.Random(3)
    long = " ".join(f"{r.randrange(1 << 30):x}" for _ in range(140_000))
    rows = [(1, long), (2, "start " + long[5:]), (3, long[400_000:700_000]), (4, long[-60:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(long) > 2 * common.SLICE_BYTES and len(long) > 2 * anchors.PIECE
    got = {x.doc_id: x for x in suffix_dedup.dedup(docs).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4)] == [0, len(long) - 5, 300_000, 60]
    words = {x.doc_id: x for x in fm_dedup.dedup(docs).collect()}
    n = len(long.split(" "))
    assert words[1].n_removed == 0 and words[2].n_removed == n - 1 and words[4].n_removed == 0
    assert words[3].size - words[3].n_removed <= 2


def test_suffix_blocks_are_in_order(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    r = np.random.default_rng(3)
    parts = [r.integers(97, 99, n).astype(np.uint8) for n in r.integers(50, 90, 40)]
    parts += parts[:10]
    raw, ends = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    windows = np.diff(ends) - 50 + 1
    places = np.concatenate([np.arange(a, a + n) for a, n in zip(ends[:-1], windows)])
    order, same = zip(*suffix_dedup.suffix_blocks(raw, ends, r.integers(0, 20, len(parts)), places, 50))
    assert len(order) > 5
    order, same = np.concatenate(order), np.concatenate(same)
    text = [raw[p : p + 50].tobytes() for p in order]
    assert text == sorted(text) and same.tolist() == [False, *[a == b for a, b in zip(text, text[1:])]]


def shard(seed=4, n=30):
    r = np.random.default_rng(seed)
    sizes = r.integers(4, 12, n)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return r.integers(0, 3, offsets[-1]).astype(np.uint64), offsets, sizes, r.permutation(n).astype(np.int64)


def test_fm_index_finds_earlier_documents():
    symbols, offsets, sizes, doc = shard()
    windows = sizes - 4 + 1
    places = np.concatenate([np.arange(a, a + n) for a, n in zip(offsets[:-1], windows)])
    got = fm_dedup.earlier_document(symbols, offsets, None, doc, windows, 4)
    owner = np.repeat(doc, windows)
    keys = [tuple(symbols[p : p + 4]) for p in places]
    want = {}
    for k, d in zip(keys, owner.tolist()):
        want[k] = min(want.get(k, d), d)
    assert got.tolist() == [want[k] < d for k, d in zip(keys, owner.tolist())]


def test_fm_index_is_what_answers(monkeypatch):
    """With a wrong transform the answers are wrong: nothing beside the index knows them."""
    symbols, offsets, sizes, doc = shard()
    windows = sizes - 4 + 1
    right = fm_dedup.earlier_document(symbols, offsets, None, doc, windows, 4)
    tree = fm_dedup.Wavelet
    monkeypatch.setattr(fm_dedup, "Wavelet", lambda x: tree(x[::-1].copy()))
    assert fm_dedup.earlier_document(symbols, offsets, None, doc, windows, 4).tolist() != right.tolist()


def test_fm_index_takes_foreign_documents():
    """Matching statistics of texts that are not in the shard: the windows that it has, and their smallest document."""
    symbols, offsets, sizes, doc = shard()
    text = np.concatenate([np.append(symbols[a:b] + 1, 0) for a, b in zip(offsets[:-1], offsets[1:])]).astype(np.int32)
    index = fm_dedup.Index(text, np.repeat(doc, sizes + 1), len(doc), int(sizes.max()), 4)
    other = np.random.default_rng(5).integers(1, 4, 400).astype(np.int32)
    want = {}
    for (a, b), d in zip(zip(offsets[:-1], offsets[1:]), doc.tolist()):
        for p in range(a, b - 3):
            k = tuple(symbols[p : p + 4] + 1)
            want[k] = min(want.get(k, d), d)
    got = {int(p): int(d) for hit, place, least in index.statistics(other, np.array([399]), np.array([400]), 4) for p, d in zip(place, least)}
    assert got == {p: want[k] for p in range(397) if (k := tuple(other[p : p + 4])) in want} and 0 < len(got)


def test_wavelet_tree_is_compressed():
    r = np.random.default_rng(6)
    seq = np.minimum(r.zipf(1.3, 50_000), 3000)
    seq = np.unique(seq, return_inverse=True)[1]
    tree = fm_dedup.Wavelet(seq)
    p = tree.counts / len(seq)
    entropy = -(p * np.log2(p)).sum()
    assert sum(64 * len(level[0].words) for level in tree.levels) < len(seq) * (entropy + 0.2)
    symbol, place = r.integers(0, len(p), 500), r.integers(0, len(seq) + 1, 500)
    assert tree.ranks(symbol, place).tolist() == [int((seq[:i] == s).sum()) for s, i in zip(symbol, place)]


# ---- 3: mixing


def test_mixing(docs, texts):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts) and sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    budget = 1.5 * sum(sizes.values())
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.copies in (0, 1, 2)
        taken[r.source] += r.copies * r.size
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in sizes)


# ---- 4: SimHash


def brute_print(text, width=3):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return 0
    s = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, texts):
    rows = simhash.near_duplicates(docs).collect()
    prints = [brute_print(t) for _, t in texts]
    assert collections.Counter((r.doc_id, r.fp % (1 << 64)) for r in rows) == collections.Counter(zip([i for i, _ in texts], prints))
    low = reach([(a, b) for a in set(prints) for b in set(prints) if (a ^ b).bit_count() <= 3], set(prints))
    first = {}
    for (i, _), p in zip(texts, prints):
        first[low[p]] = min(first.get(low[p], BIG), BIG if i is None else i)
    for r in rows:
        assert r.component_id == first[low[r.fp % (1 << 64)]]


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_multi_index_links(spark, distance):
    r = np.random.default_rng(5)
    base = r.integers(-(1 << 63), 1 << 63 - 1, 20)
    fps = [int(b) for b in base]
    for b in base:
        for n in range(1, 8):
            flips = r.choice(64, n, replace=False)
            x = int(b) & ((1 << 64) - 1)
            for f in flips:
                x ^= 1 << int(f)
            fps.append(x - (1 << 64) if x >> 63 else x)
    got = {tuple(x) for x in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), distance).collect()}
    u = sorted(set(fps))
    assert got == {(a, b) for a in u for b in u if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance}


def test_similar_copies(spark):
    """Links up to 11 bits and of similarity 0.8 or more, and no others; planted copies of 0.8 that 5 bits would lose."""
    r = np.random.default_rng(9)
    say = lambda n: [f"w{x}" for x in r.integers(0, 9999, n)]
    texts = []
    for _ in range(60):
        base = say(120)
        texts.append(base)
        for changes in (2, 4, 8):
            w = list(base)
            for at in r.choice(120, changes, replace=False):
                w[at] = "new"
            texts.append(w)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    prints = [brute_print(" ".join(w), 5) for w in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    links = [(a, b) for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 11]
    short = [(a, b) for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 5]
    low = reach(links, range(len(texts)))
    assert low != reach(short, range(len(texts)))
    rows = simhash.similar_copies(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in rows} == low and len(rows) == len(texts)


@pytest.mark.parametrize("distance, radius", [(8, 2), (11, 3)])
def test_wide_links(spark, distance, radius):
    r = np.random.default_rng(5)
    fps = []
    for b in r.integers(0, 1 << 63, 20).tolist():
        for n in range(14):
            x = b
            for f in r.choice(64, n, replace=False):
                x ^= 1 << int(f)
            fps.append(x - (1 << 64) if x >> 63 else x)
    fps += fps[:9]
    part = [i % 7 for i in range(len(fps))]
    frame = spark.createDataFrame(list(zip(range(len(fps)), fps, part)), "node long, fp long, part long")
    got = [tuple(x) for x in simhash.wide_links(frame, distance, radius, 8).collect()]
    near = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if ((fps[a] ^ fps[b]) & ((1 << 64) - 1)).bit_count() <= distance}
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in near if part[a] != part[b]}
    star = [tuple(x) for x in simhash.wide_links(frame, distance, radius, 8, star=1).collect()]
    assert {(min(x), max(x)) for x in star} <= {(a, b) for a, b in near if part[a] != part[b]} and 0 < len(star) == len({b for _, b in star})


def test_dense_group_makes_few_pairs(spark):
    """Near copies of one text: pairs follow the copies, not their square, and nothing of the group is lost."""
    r = np.random.default_rng(2)
    base = [f"w{x}" for x in r.integers(0, 9999, 400)]
    texts = []
    for i in range(300):
        w = list(base)
        w[int(r.integers(0, 400))] = f"new{i}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.component_id for x in simhash.similar_copies(docs).collect()} == {0}
    nodes = simhash.fingerprints(docs, 5).select(F.col("doc_id").alias("node"), "fp", F.lit(0).cast("long").alias("part"))
    assert simhash.wide_links(nodes, 11, 3, 8).count() == 0 and simhash.wide_links(nodes.withColumn("part", F.col("node")), 11, 3, 8, star=0).count() <= 300


def test_half_similar_group(spark, monkeypatch):
    """Near copies of which each is similar to some others only: rows follow the copies, and components are those of all links."""
    r = np.random.default_rng(3)
    texts = []
    for base in range(2):
        words = [f"w{x}" for x in r.integers(0, 9999, 200)]
        for i in range(120):
            w = list(words)
            for at in r.choice(200, int(r.integers(1, 9)), replace=False):
                w[at] = f"new{at}{i}"
            texts.append(w)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    prints = [brute_print(" ".join(w), 5) for w in texts]
    near = [(a, b) for b in range(len(texts)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= 11]
    links = [(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(prints)], "node long, fp long, part long")
    met = simhash.wide_links(nodes, 11, 3, 8, many=4).collect()
    assert len(met) <= 12 * 5 * len(texts) and len(met) < len(near) / 2 and 0 < len(links) < len(near)
    light, heavy = [{(x.a, x.b) for x in met if x.heavy == h} for h in (False, True)]
    joined = reach(list(heavy), range(len(texts)))
    assert light <= set(near) and all((a, b) in light or joined[a] == joined[b] for a, b in near)
    monkeypatch.setattr(simhash, "MANY", 4)
    monkeypatch.setattr(simhash, "TURNS", 1)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    for block in ((16, 64), (256, 8192)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert {x.doc_id: x.component_id for x in simhash.similar_copies(docs).collect()} == reach(links, range(len(texts)))


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 7), (3, 10), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = reach([x for x in links if None not in x and x[0] != x[1]], {n for x in links if None not in x and x[0] != x[1] for n in x})
    assert got == want


# ---- 5: url filters


def test_few_links_make_few_tasks(spark):
    """Partitions follow the links, not the session's number: every task leaves files of shuffles, checkpoints and logs."""
    keep = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keep}
    try:
        for k, v in keep.items():
            spark.conf.set(k, v)
        found = components.components(spark.range(0, 300, 1, 4).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
        assert found.rdd.getNumPartitions() <= 4
        assert found.count() == 301 and {x["component_id"] for x in found.collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_urls(spark):
    urls_ = [None, "", "nothing", "http://www.EXAMPLE.com/en/x?y", "http://a.www.example.com/en/", "https://example.com/en/#f", "https://example.com/english", "http://net/es/", "http://x.net/fr/a", "http://xnet/fr/", "http://b.com", "http://b.com?x", "ftp://q.org/a", "://com/", "http://www.example.com/en/x?y"]
    pages = spark.createDataFrame([(i, u, "h", "c") for i, u in enumerate(urls_)] + [(3, urls_[3], None, None)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark, pages).collect()}

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].translate(LOW), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")
        return host, path, *rule

    assert got == {i: brute(u) for i, u in enumerate(urls_)}
    assert urls.judge(spark, pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(spark, pages, rules=()).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    listed, rest = [f"l{i}" for i in range(3000)], [f"r{i}" for i in range(30000)]
    key = lambda xs: spark.createDataFrame([(x,) for x in xs], "k string").select(F.xxhash64("k").alias("key"))
    levels = urls.cascade(key(listed), key(listed + rest))
    assert len(levels) > 1
    as_keys = lambda xs: np.array([r[0] for r in key(xs).collect()], np.int64).view(np.uint64)
    assert urls.holds(levels, as_keys(listed)).all() and not urls.holds(levels, as_keys(rest)).any()


# ---- 6: quality


def test_quality_learns(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out")
    right = rows.filter("(score >= 0.5) = (quality = 1)").count()
    assert right >= 0.95 * rows.count()


def test_quality_edges(spark, docs, texts, no_docs):
    labels = spark.createDataFrame([(4, None, 0), (5, 1, 0), (5, 1, 0), (81, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(no_docs, labels).count() == 0


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 1, 1, 1]), np.array([1.0, 0, 1, 1])).tolist() == [0.5, 0.5, 1, 1]


# ---- 8: embeddings


def test_embeddings(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(12, 64))
    rows = []
    for c in range(12):
        for k in range(25):
            rows.append(base[c] + r.normal(size=64) * 0.03 * (k % 12))
    rows += [rows[0], rows[0] * 2.0, rows[30]]
    vectors = [(i, [float(np.float32(x)) for x in v], 1, "x") for i, v in enumerate(rows)]
    odd = [(900, None, 1, "x"), (901, [0.0] * 64, 1, "x"), (902, [float("nan")] * 64, 1, "x"), (903, [1.0, None], 1, "x"), (904, [float("inf")] * 64, 1, "x"), (905, [1.0, 2.0], 1, "x"), (906, [], 1, "x"), (None, [1.0, 2.0], 1, "x")]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>, key int, n_links string")
    got = embeddings.near_duplicates(frame).collect()
    x = np.array([v[1] for v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    found = {g.vec_id: g for g in got if g.vec_id is not None and g.vec_id < 900}
    assert sum(g.n_links for g in found.values()) >= 0.9 * link.sum()
    assert all(found[i].n_links <= link[i].sum() for i in found)
    low = reach(list(zip(*map(list, np.nonzero(link)))), range(len(x)))
    assert np.mean([found[i].component_id == low[i] for i in found]) >= 0.9
    assert all(g.n_links == 0 and g.component_id == g.vec_id for g in got if g.vec_id is None or g.vec_id >= 900)
    assert len(got) == len(vectors) + len(odd) and embeddings.near_duplicates(frame.limit(0)).count() == 0


# ---- 9: pieces


ODD = ["", " ", "   ", "a  b   c    ", "x" * 300, "ab" * 200, "日本語" * 50, "\n\n\t x", "naïve é \U0001d518", " " * 60 + "z", "internationalisation" * 20, "\x00\ufffd e\u0301", "The  1234 & 12,5"]


def test_pieces_are_the_librarys(spark):
    """Real texts and odd ones, whole and in chunks: the ids that the model's own library gives."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    frame = spark.createDataFrame(list(enumerate(real + ODD)), "doc_id long, text string").repartition(4)
    want = dict(enumerate(library.encode(real + ODD)))
    for chunk in (1 << 16, 37, 64, 700):
        got = {r.doc_id: r.ids for r in pieces.encode(spark, frame, chunk=chunk).collect()}
        assert got == want, chunk


def test_round_trip_and_chunks(spark, docs, texts):
    rows = pieces.encode(spark, docs, chunk=50, carry=("source",))
    back = pieces.decode(spark, rows, carry=("text",)).collect()
    assert collections.Counter((r.doc_id, r.decoded) for r in back) == collections.Counter((i, t or "") for i, t in texts)
    assert all(r.round_trip for r in pieces.encode(spark, docs, chunk=50, verify=True).collect())
    whole = {r.text: r.ids for r in pieces.encode(spark, docs, chunk=1 << 20).collect()}
    assert all(r.ids == whole[r.text] for r in rows.collect())
    with pytest.raises(ValueError):
        pieces.encode(spark, docs, carry=("ids",))
    with pytest.raises(ValueError):
        pieces.encode(spark, docs, chunk=20)


def test_texts_beyond_a_chunk(spark):
    """Texts longer than the production chunk, with and without spaces."""
    import sentencepiece

    r = random.Random(2)
    say = "".join(r.choice("abcdeé日 ") for _ in range(150_000))
    texts = [say, say.replace(" ", ""), "ab" * 70_000]
    assert min(map(len, texts)) > pieces.CHUNK
    got = {x.doc_id: x.ids for x in pieces.encode(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(texts)))


def test_neighbours_decide():
    """Pieces that meet pairwise are what the merges make of the whole."""
    v = pieces.Vocabulary()
    r = random.Random(1)
    for _ in range(300):
        w = "".join(r.choice("▁aeinrst") for _ in range(r.randint(1, 14)))
        got = v.merged(w)
        assert all(v.meet(a, b) for a, b in zip(["", *got], got))


# ---- 10: language model


def test_pitman_yor_base(docs, texts):
    rows = pitman_yor.score(docs).collect()
    tokens = [(i, [*WORD.findall((t or "").translate(LOW)), None]) for i, t in texts]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, types = sum(count.values()), len(count)
    want = collections.Counter((i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + types + 1)) for w in ws), 6)) for i, ws in tokens)
    assert collections.Counter((*r[:5], round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_pitman_yor_beats_its_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = pitman_yor.score(docs).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert total[1] > total[0]


def test_pitman_yor_knows_the_order_of_words(spark):
    """Held-out texts score higher than the same words in another order."""
    r = random.Random(3)
    chain = [f"w{k}" for k in range(40)]
    texts = {i: " ".join(chain[(i + k) % 40] if r.random() < 0.9 else r.choice(chain) for k in range(30)) for i in range(400)}
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2]
    for i in held:  # the other order is held out too
        j = next(k for k in range(1000 + 20 * i, 9999999) if zlib.crc32(str(k).encode()) % 7 == 2)
        texts[j] = " ".join(r.sample(w := texts[i].split(), len(w)))
    got = {x.doc_id: x for x in pitman_yor.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    mixed = [x.score for i, x in got.items() if i >= 1000]
    assert len(mixed) == len(held) and all(got[i].held_out for i in held)
    assert sum(got[i].score for i in held) / len(held) > sum(mixed) / len(mixed) + 5


def test_pitman_yor_sends_pairs_packed(spark):
    """What is shuffled stays below a few bytes a token, though hardly a pair of words is met twice."""
    r = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(4000)}" for _ in range(1000))) for i in range(300)], "doc_id long, text string")
    root = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", tempfile.gettempdir())
    shuffles = lambda: {p: p.stat().st_size for p in pathlib.Path(root).glob("**/blockmgr-*/*/shuffle_*.data")}
    before = shuffles()
    assert pitman_yor.score(docs).count() == 300
    assert 0 < sum(n for p, n in shuffles().items() if p not in before) < 10 * 300_000


def test_pitman_yor_scores_alike_in_any_buckets(spark, monkeypatch):
    """Neither the number of buckets nor words too frequent for one change a result."""
    r = random.Random(7)
    texts = [" ".join(r.choice(("the", "the", "of", f"w{r.randrange(60)}")) for _ in range(50)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, pitman_yor.score(docs).collect()))
    monkeypatch.setattr(pitman_yor, "BUCKET", sum(map(len, texts)) // 6)  # half of all words are more than a bucket's share
    got = sorted(map(tuple, pitman_yor.score(docs).collect()))
    assert len(got) == 60 and [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-7, atol=1e-7)


def test_seating_follows_its_distribution():
    keys = np.arange(40000, dtype=np.uint64)
    d, new = pitman_yor.SPELL[0], 1.7
    t = pitman_yor.seat(np.full(40000, 3), np.full(40000, new), d, keys, 1)
    # three customers: one table, two tables (three ways), three tables
    weight = np.array([new * (1 - d) * (2 - d), 3 * new**2 * (1 - d), new**3])
    assert np.allclose(np.bincount(t, minlength=4)[1:] / 40000, weight / weight.sum(), atol=0.01)


# ---- all: empty tables


def test_empty_tables(spark, no_docs):
    assert audio.features(audio.encode(no_docs)).count() == 0
    assert suffix_dedup.dedup(no_docs).count() == 0 and fm_dedup.dedup(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0
    assert pieces.decode(spark, pieces.encode(spark, no_docs)).count() == 0 and pitman_yor.score(no_docs).count() == 0
