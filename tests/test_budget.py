"""Token cuts against every boundary, with each of the tokenizers at hand."""

import random

import pytest
from tokenizers import Tokenizer

from rankloom.operators import budget

PATHS = ["/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/word_bpe_49k.json"]
FRAME = budget.Template("<doc>\n", "\n</doc>", escape=True)


def texts():
    r = random.Random(7)
    words = ["unfortunately", "&", "<b>", "日本語", "😀", "é", "antidisestablishment", "a", "  ", "\n", "1234567", "x" * 40]
    out = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(120)]
    return out + [(1000, None), (1001, ""), (1002, "<&>" * 400), (1003, "word " * 20_000), (1004, "😀" * 300), (1004, "😀" * 300)]


@pytest.mark.parametrize("path", PATHS)
def test_cut_is_the_longest_boundary_that_fits(spark, path):
    t, most = Tokenizer.from_file(path), 30
    count = lambda x: len(t.encode(FRAME.render(x), add_special_tokens=False).ids)
    frame = spark.createDataFrame([(*x, 1) for x in texts()], "doc_id long, text string, tokens long").repartition(4)
    rows = budget.fit(frame, path, most, template=FRAME).collect()
    assert len(rows) == len(texts())
    source = dict(texts())
    for r in rows:
        text = source[r.doc_id] or ""
        assert r.part == 0 and text.startswith(r.text) and r.request_tokens == count(r.text) and r.tokens == len(t.encode(text, add_special_tokens=False).ids)
        if count(text) <= most:
            assert r.text == text
            continue
        assert r.request_tokens <= most
        offsets = t.encode(text, add_special_tokens=False).offsets
        edges = [0] + [min(e, b) for (_, e), (b, _) in zip(offsets, offsets[1:])] + [len(text)]
        taken = max(k for k, e in enumerate(edges) if e == len(r.text))
        assert taken == most or taken == len(offsets) or count(text[: edges[taken + 1]]) > most


def test_chunks_cover_the_text(spark):
    path = PATHS[0]
    frame = spark.createDataFrame(texts(), "doc_id long, text string")
    rows = budget.fit(frame.dropDuplicates(["doc_id"]), path, 64, "chunk", size=40, overlap=8).collect()
    parts = {}
    for r in rows:
        assert r.request_tokens <= 64
        parts.setdefault(r.doc_id, []).append((r.part, r.text))
    for i, text in dict(texts()).items():
        pieces = [x for _, x in sorted(parts[i])]
        at = 0
        for p in pieces:
            found = (text or "").rfind(p, 0, at + len(p))  # overlaps what came before, or follows at once
            assert found >= 0
            at = max(at, found + len(p))
        assert at == len(text or "")


def test_budgets_and_census(spark):
    frame = spark.createDataFrame(texts(), "doc_id long, text string").dropDuplicates(["doc_id"])
    kept = budget.fit(frame, PATHS[0], 30, "keep", FRAME)
    cut = budget.fit(frame, PATHS[0], 30, template=FRAME)
    total = sum(r.tokens for r in kept.collect())
    row = budget.census(cut).first()
    lost = sum(r.tokens - r.kept_tokens for r in cut.collect())
    assert row.documents == row.parts == len(dict(texts())) and row.lost_tokens == lost and row.kept_share == pytest.approx(1 - lost / total)
    assert row.cut == sum(r.tokens > r.kept_tokens for r in cut.collect()) and budget.census(kept).first().cut == 0
    with pytest.raises(Exception, match="tokens of 30"):
        budget.fit(frame, PATHS[0], 30, "fail").collect()
    with pytest.raises(ValueError, match="template alone"):
        budget.fit(frame, PATHS[0], 5, template=FRAME)
    with pytest.raises(ValueError, match="no such budget"):
        budget.fit(frame, PATHS[0], 5, "chunk", size=4, overlap=4)
    assert budget.fit(frame.limit(0), PATHS[0], 30).count() == 0 and budget.census(cut.limit(0)).first().documents == 0


def test_search_counts_few_candidates():
    asked = []

    def count(k):
        asked.append(k)
        return 3 * k

    assert budget.longest(10_000, 9_000, count) == 3_000 and len(asked) < 40
    assert budget.longest(0, 5, count) == 0 and budget.longest(5, 5, lambda k: 99) == 0


ODD = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\u2009", "\x1c", "\x1f", "\x85", "\u200b", "\u180e", "'", "'s", "'ll", "a", "word", "Unfortunately", "12", "!", "...", "é", "日本", "😀", "e\u0301", "<|endoftext|>", "<|endo", "text|>", "&", "x" * 70]


def test_words_alone_count_as_in_their_text(monkeypatch):
    """Counts and places of tokens from words encoded one by one equal the library's over the whole text."""
    t, r = Tokenizer.from_file(PATHS[0]), random.Random(5)
    words = budget.Words(t)
    monkeypatch.setattr(budget, "REMEMBERED", 300)
    for _ in range(5000):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 25)))
        whole = t.encode(text, add_special_tokens=False)
        n, place = words.tokens(text)
        assert n == words.count(text) == len(whole.ids) and [place(i) for i in range(n)] == whole.offsets, text


def test_only_byte_level_models_are_read_word_by_word():
    assert [budget.separable(open(path, encoding="utf-8").read()) for path in PATHS] == [True, False]


class Counted:
    """A tokenizer that counts the characters that it is given."""

    def __init__(self, path):
        self.tokenizer, self.read = Tokenizer.from_file(path), 0

    def encode(self, text, **kw):
        self.read += len(text)
        return self.tokenizer.encode(text, **kw)

    def encode_batch_fast(self, texts, **kw):
        self.read += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **kw)


@pytest.mark.parametrize("how, size, overlap", [("truncate", 0, 0), ("chunk", 400, 50)])
def test_a_budget_encodes_each_word_once(how, size, overlap):
    """A text is not encoded again whole, in its frame and for each candidate: less is read than the texts hold."""
    r, t = random.Random(3), Counted(PATHS[0])
    vocabulary = [f"{r.choice('abc')}{r.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(3000)) for _ in range(20)]
    words = budget.Words(t)
    parts = [x for text in texts for x in budget.parts(words, text, 512, how, FRAME, False, size, overlap)]
    assert len(parts) >= 20 and all(x[-1] <= 512 for x in parts)
    assert t.read < sum(map(len, texts)) / 3


def test_census_of_words_and_of_whole_texts_agree(spark, monkeypatch):
    frame = spark.createDataFrame(texts(), "doc_id long, text string").dropDuplicates(["doc_id"])
    assert budget.separable(open(PATHS[0], encoding="utf-8").read())
    words = budget.census(budget.fit(frame, PATHS[0], 30, template=FRAME)).first()
    monkeypatch.setattr(budget, "separable", lambda source: False)
    assert words == budget.census(budget.fit(frame, PATHS[0], 30, template=FRAME)).first() and words.cut > 0
