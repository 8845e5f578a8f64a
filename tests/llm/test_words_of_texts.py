"""Operators 11 to 13 against brute force over odd texts: nulls, empties, blanks, repeated rows and one very long text."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import bpe, queries, runs, variants
from tests.llm.conftest import LOW, WORD

RUN = re.compile("[A-Za-zÀ-ÿ]+")


# --- spelling variants -------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(rows):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    around = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and near(v, w)] for w in n}
    form = {}
    for w, others in around.items():
        if others and n[best := min(others, key=lambda v: (-n[v], v))] >= 10 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(around[w]), n.get(form.get(w))) for w in n}


def word_texts():
    """Chains of forms, ties of forms, dense families that share a half, words of wide characters, one very long word."""
    r = random.Random(11)
    out = [(1, None), (2, ""), (3, " 12 \n"), (None, "spelling " * 3), (4, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + " " + "x" * 4999)]
    for i in range(40):
        out.append((100 + i, "Spelling éÀÿöüñß×÷ " * 30 + "colouring colourinh " * 2 + "éÀÿöüñß×÷ü " * 2))
    out += [(200 + i, ("spelling " * 2 + "spellingg " + "speling " + "sxpelling ")) for i in range(4)]
    out += [(400 + i, "colouring " * 500) for i in range(4)] + [(410, "colourinhh colourinhh colourinhh")]
    family = ["common" + "".join(r.choice("ab") for _ in range(6)) for _ in range(90)] + ["".join(r.choice("ab") for _ in range(5)) + "ending" for _ in range(40)]
    out += [(300 + i, " ".join(r.choice(family) for _ in range(60))) for i in range(60)]
    return out + out[:6]


@pytest.mark.parametrize("pairs", [4, variants.PAIRS])
def test_variants_equal_brute_force(spark, monkeypatch, pairs):
    rows = word_texts()
    plain = variants.near_pairs
    monkeypatch.setattr(variants, "near_pairs", lambda words: plain(words, pairs))
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n long, word string").repartition(3)
    got = variants.group(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(g) for g in got} == variants_of(rows)
    assert len(got) == len({g.word for g in got})
    assert any(g.form != g.root for g in got if g.form)


def test_near_pairs_come_once(spark):
    r = random.Random(3)
    words = {"".join(r.choice("abé") for _ in range(r.randint(1, 9))) for _ in range(300)}
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    want = {frozenset((a, b)) for a in words for b in words if a != b and near(a, b)}
    for pairs in (1, 16, 1 << 20):
        got = [frozenset((p.a, p.b)) for p in variants.near_pairs(frame, pairs).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_variants_of_nothing(spark, no_docs):
    assert variants.group(no_docs).count() == 0


# --- periodic runs -----------------------------------------------------------------------------------------------


def runs_of(w):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i) + 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def collapsed_of(i, text, repeat=True):
    w = WORD.findall(text or "")
    n = len(w)
    if repeat and n and i is not None and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    found = runs_of(w)
    gone = {k for s, length, p in found for k in range(s + p, s + length)}
    return found, " ".join(x for k, x in enumerate(w) if k not in gone)


def run_texts(texts):
    r = random.Random(12)
    out = list(texts)
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    out += [(1000, " ".join(fib[-1])), (1001, "a " * 11), (1002, "a " * 12), (1003, "a b " * 400 + "a"), (1004, "x y z w " * 3), (1005, "é 日 " * 9 + "\n\t q")]
    for i in range(150):
        d = [r.choice("abcdefgh"[: r.choice((2, 3, 8))]) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            a = r.randint(0, len(d))
            d[a:a] = d[a : a + r.randint(1, 20)] * r.randint(1, 5)
        out.append((2000 + i, " ".join(d)))
    return out


def test_runs_equal_brute_force(spark, texts):
    rows = run_texts(texts)
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_words long").repartition(3)
    for repeat in (True, False):
        want = Counter((i, len(WORD.findall(t or "")), *(lambda f, c: (tuple(f), c))(*collapsed_of(i, t, repeat))) for i, t in rows)
        got = Counter((g.doc_id, g.n_words, tuple(map(tuple, g.runs)), g.collapsed) for g in runs.collapse(docs, repeat).collect())
        assert got == want
    assert sum(len(f) for *_, f, _ in want) > 300


def test_runs_query_digests(spark, texts, tmp_path):
    rows = run_texts(texts)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, t in rows:
        found, text = collapsed_of(i, t)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2])) if found else (None, None, None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, text)]
        want[(i, len(found), *best, 1000 * best[1] // best[2] if found else None, *sha)] += 1
    got = queries.op12_runs(spark, str(tmp_path)).drop("n_words")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def test_long_texts_have_their_runs():
    r = random.Random(5)
    for words in ([0] * 50_000, [i % 777 for i in range(50_000)], [r.randrange(3000) for _ in range(20_000)] * 2):
        w = np.array([-1, *words, -2])
        start, end, period = runs.find(w, np.cumsum(w < 0) - 1)
        assert [*zip(start.tolist(), end.tolist(), period.tolist())] == [(1, len(words) + 1, {0: 1, 1: 777}.get(words[1], 20_000) if words[:2] in ([0, 0], [0, 1]) else 20_000)]


def test_grammar_derives_its_words():
    r = random.Random(6)
    w = np.array([-1, *(r.randrange(3) for _ in range(400)), -2, *([7, 8] * 20), -3])
    rules, tops = runs.grammar(w, np.cumsum(w < 0) - 1)
    seen = 0
    for number, begin, middle, end in rules:
        for k in range(int(number.max()) + 1):
            spelled = {(tuple(w[a:b]), tuple(w[b:c])) for n, a, b, c in zip(number, begin, middle, end) if n == k}
            assert len(spelled) == 1 and (number == k).sum() > 1
            seen += 1
    assert seen > 20 and 0 < len(tops) < 300


def test_runs_of_nothing(spark, no_docs):
    assert runs.collapse(no_docs).count() == 0


# --- byte-level BPE ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.MODEL)


def bpe_texts(texts):
    r = random.Random(13)
    signs = ["a", "s", "t", "r", "e", "l", "v", "d", "m", "'", " ", "  ", "\n", "1", "²", ".", "é", "日", " ", "\t", "\u0085", "<|endoftext|>", "<|end", "Ᲊ", "́", "😀"]
    out = list(texts) + [(i, t) for i, t in enumerate(["don't", "'tis 'twas", "x'll", "a   b", "a \n b  ", "<|endoftext|>", "a" * 5000, "ab" * 3000 + "c", "\x00\x01"])]
    out += [(500 + i, "".join(r.choice(signs) for _ in range(r.randint(0, 40)))) for i in range(800)]
    out += [(2000 + i, "".join(chr(r.choice([r.randint(32, 0x24F), r.randint(0x250, 0xD7FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(30))) for i in range(300)]
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_bpe_equals_the_library(spark, texts, library, packed):
    rows = bpe_texts(texts)
    docs = spark.createDataFrame([(i, t, "k", i) for i, t in rows], "doc_id long, text string, key string, decoded_ids long").repartition(3)
    ids = bpe.encode(spark, docs, carry=("key",), packed=packed)
    assert ids.columns == ["doc_id", "key", "ids"]
    back = bpe.decode(spark, ids, carry=("key", "ids"), packed=packed)
    unpack = (lambda x: np.frombuffer(x, "<u4").tolist()) if packed else list
    got = Counter((g.doc_id, tuple(unpack(g.ids)), g.decoded) for g in back.collect())
    want = Counter()
    for (i, _), e in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        want[i, tuple(e.ids), library.decode(e.ids, skip_special_tokens=False)] += 1
    assert got == want


def test_bpe_decodes_any_ids(spark, library):
    r = random.Random(1)
    lists = [[r.randrange(50257) for _ in range(r.randint(0, 12))] for _ in range(400)] + [[50256, 50256], []]
    rows = spark.createDataFrame([*enumerate(lists), (-1, None)], "doc_id long, ids array<int>").repartition(3)
    got = {g.doc_id: g.decoded for g in bpe.decode(spark, rows).collect()}
    assert got == {-1: "", **{i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}}


def test_bpe_memory_does_not_change_ids(texts, library):
    model = bpe.Model()
    encoder = bpe.Encoder(model)
    for _, text in bpe_texts(texts)[::7]:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        ids, to = encoder.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids and to.tolist() == [0, len(ids)]


def test_bpe_query(spark, texts, library, tmp_path):
    rows = bpe_texts(texts)[:200]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, queries.op13_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want


def test_bpe_refuses_clashing_columns_and_takes_nothing(spark, no_docs):
    with pytest.raises(ValueError, match="clash"):
        bpe.encode(spark, no_docs.withColumn("ids", F.lit(1)), carry=("ids",))
    assert bpe.decode(spark, bpe.encode(spark, no_docs)).count() == 0
