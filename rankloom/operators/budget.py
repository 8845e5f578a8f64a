"""Texts cut to token budgets: verbatim prefixes at token boundaries, counted as the request will be read."""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.lineage import spread

#: Texts that a worker encodes at a time.
BATCH = 256
#: A task remembers the tokens of words up to so many characters, and of so many words.
SHORT, REMEMBERED = 64, 1 << 20
#: Where a byte-level model begins a new word whatever stands before: one space, and then none.
_SPACE = re.compile(r" (?=\S)")


def longest(size: int, most: int, count: Callable[[int], int]) -> int:
    """The number of leading tokens, ``size`` and ``most`` at most, that counts ``most`` or less when taken alone.

    A cut word can take more tokens than it had in its place, so every candidate is counted again: back from the budget
    in growing steps until one fits, then between that and the last that did not. Nothing always fits.
    """
    top = min(size, most)
    if top <= 0 or count(top) <= most:
        return max(top, 0)
    fits, step = top - 1, 1
    while fits > 0 and count(fits) > most:
        top, fits, step = fits, max(fits - step, 0), 2 * step
    while top - fits > 1:
        middle = (top + fits) // 2
        if count(middle) <= most:
            fits = middle
        else:
            top = middle
    return fits


class Whole:
    """Token counts and places from the library alone, for any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def count(self, text: str, special: bool = False) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=special))

    def tokens(self, text: str) -> tuple[int, Callable[[int], tuple[int, int]]]:
        """How many tokens the text has, and a function giving where one of them begins and ends."""
        encoded = self.tokenizer.encode(text, add_special_tokens=False)
        offsets = encoded.offsets
        return len(offsets), offsets.__getitem__


class Words(Whole):
    """The same for a tokenizer that reads word by word (``separable``): each word is encoded once and remembered.

    A word here is all from one space, if no white space follows, to the next such space. The model's own words never
    cross those edges, and what a word becomes does not depend on what stands around it, so that counts add up.
    """

    def __init__(self, tokenizer):
        super().__init__(tokenizer)
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def _sizes(self, text: str) -> tuple[list[str], list[int]]:
        words = _SPACE.split(text)
        for known in (self.first, self.later):
            if len(known) > REMEMBERED:
                known.clear()
        if words[0] not in self.first:
            size = super().count(words[0])
            if len(words[0]) > SHORT:
                return words, [size, *self._later(words[1:])]
            self.first[words[0]] = size
        return words, [self.first[words[0]], *self._later(words[1:])]

    def _later(self, words: list[str]) -> list[int]:
        sizes = list(map(self.later.get, words))
        if None not in sizes:
            return sizes
        new = list({w for w, n in zip(words, sizes) if n is None})
        found = dict(zip(new, map(len, self.tokenizer.encode_batch_fast([f" {w}" for w in new], add_special_tokens=False))))
        self.later.update((w, n) for w, n in found.items() if len(w) <= SHORT)
        return [found[w] if n is None else n for w, n in zip(words, sizes)]

    def count(self, text: str, special: bool = False) -> int:
        return sum(self._sizes(text)[1])

    def tokens(self, text: str) -> tuple[int, Callable[[int], tuple[int, int]]]:
        words, sizes = self._sizes(text)
        before: list[int] = []  # tokens before each word, and all
        places: list[int] = []  # where each word begins, its space included
        seen: dict[int, list[tuple[int, int]]] = {}

        def place(i: int) -> tuple[int, int]:
            if not before:
                before.extend(accumulate(sizes, initial=0))
                places.extend((0, *accumulate((len(w) + 1 for w in words[1:]), initial=len(words[0]))))
            w = bisect_right(before, i) - 1
            if w not in seen:
                seen[w] = self.tokenizer.encode(f" {words[w]}" if w else words[w], add_special_tokens=False).offsets
            begin, end = seen[w][i - before[w]]
            return places[w] + begin, places[w] + end

        return sum(sizes), place


def separable(source: str) -> bool:
    """Whether the tokenizer of this file reads its words one by one: byte-level BPE over a text taken as it is."""
    file = json.loads(source)
    split, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    added = all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) and not re.search(r"\s", x["content"]) for x in file.get("added_tokens") or ())
    return bool(plain and added and model["type"] == "BPE" and not model.get("dropout") and not file.get("normalizer") and not file.get("post_processor"))


@dataclass(frozen=True)
class Template:
    """What stands before and after a request's text, and whether the text is escaped as in markup."""

    before: str = ""
    after: str = ""
    escape: bool = False

    def render(self, text: str) -> str:
        if self.escape:
            text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return f"{self.before}{text}{self.after}"


def parts(read: Whole, text: str, most: int, how: str, template: Template, special: bool, size: int, overlap: int) -> Iterator[tuple[int, str, int, int, int]]:
    """(part, text, tokens, kept_tokens, request_tokens) of one text, see ``fit``; uncut where that is to ``fail``."""
    n, place = read.tokens(text)
    request = read.count(template.render(text), special)
    if request <= most or how in ("keep", "fail"):
        yield 0, text, n, n, request
        return
    starts = [0] if how == "truncate" else range(0, max(n - overlap, 1), size - overlap)
    for no, start in enumerate(starts):
        room = n - start if how == "truncate" else min(size, n - start)
        at = place(start)[0] if start else 0
        # tokens of one character share its end: a cut inside it takes none of it
        cut = lambda k: text[at : min(place(start + k - 1)[1], place(start + k)[0]) if start + k < n else len(text)] if k else ""
        counts: dict[int, int] = {}  # each candidate is counted once, the one kept too

        def count(k: int) -> int:
            if k not in counts:
                counts[k] = read.count(template.render(cut(k)), special)
            return counts[k]

        k = longest(room, most, count)
        kept = cut(k)
        yield no, kept, n, read.count(kept), count(k)


def fit(docs: DataFrame, tokenizer: str, most: int, how: str = "truncate", template: Template = Template(), special: bool = False, size: int = 0, overlap: int = 0) -> DataFrame:
    """(doc_id, part, text, tokens, kept_tokens, request_tokens): each text of ``docs(doc_id, text)`` within a budget.

    ``most`` tokens hold the whole request, the template's included (``special``: and those that the model adds); a
    template that leaves no room is refused. A request that fits keeps its text as it is. Of others ``truncate`` keeps
    the longest prefix that ``longest`` finds, ``chunk`` gives parts of ``size`` tokens that share ``overlap``, each cut
    likewise, numbered from 0, ``keep`` changes nothing and ``fail`` is an error. Cuts stand at token boundaries of the
    text itself: a part is always the text's own characters. ``tokens`` and ``kept_tokens`` count text and part alone,
    ``request_tokens`` the rendered request. ``tokenizer`` is a tokenizers library file, read once and sent to the
    tasks; of a byte-level one each word is encoded once a task, see ``Words``. A null text is empty and keeps one empty
    part. Row by row, repeated rows kept, no rows give none.
    """
    if how not in ("keep", "truncate", "chunk", "fail") or most < 1 or how == "chunk" and not 0 <= overlap < size:
        raise ValueError(f"no such budget: {how!r} of {most}, parts of {size} that share {overlap}")
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    overhead = len(Tokenizer.from_str(source).encode(template.render(""), add_special_tokens=special).ids)
    if overhead >= most:
        raise ValueError(f"the template alone takes {overhead} of {most} tokens")
    model, reader = docs.sparkSession.sparkContext.broadcast(source), Words if separable(source) else Whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; more threads would only wait for it
        t = Tokenizer.from_str(model.value)
        t.no_truncation()
        t.no_padding()
        read = reader(t)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                out = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    kept = list(parts(read, text or "", most, how, template, special, size, overlap))
                    if how == "fail" and kept[0][-1] > most:
                        raise ValueError(f"document {key} takes {kept[0][-1]} tokens of {most}")
                    out += [(key, *x) for x in kept]
                names = ["doc_id", "part", "text", "tokens", "kept_tokens", "request_tokens"]
                kinds = [part.schema.field(0).type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, f"doc_id {kind}, part int, text string, tokens long, kept_tokens long, request_tokens long")


def census(fitted: DataFrame) -> DataFrame:
    """(documents, cut, parts, lost_tokens, kept_share, most_lost): what a budget took from a corpus."""
    # parts of one document say its tokens alike; overlaps count in each part
    per = fitted.groupBy("doc_id").agg(F.max("tokens").alias("tokens"), F.sum("kept_tokens").alias("kept"), F.count("*").alias("parts"))
    lost = F.greatest(F.col("tokens") - F.col("kept"), F.lit(0).cast("long"))
    return per.agg(
        F.count("*").alias("documents"), F.count_if((F.col("parts") > 1) | (lost > 0)).alias("cut"), F.coalesce(F.sum("parts"), F.lit(0)).alias("parts"), F.coalesce(F.sum(lost), F.lit(0)).alias("lost_tokens"),
        (1 - F.try_divide(F.sum(lost), F.sum("tokens"))).alias("kept_share"), F.max(lost).alias("most_lost"),
    )
