"""Byte-level BPE: merges by an index from each pair to all its places, over all new words of a slice at once."""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import common

#: The vocabulary file's usual place on all machines of the cluster.
MODEL = "/opt/tokenizers/byte_bpe_50k.json"

#: Letters and numbers that Unicode 16 added, which the model's library knows and older Pythons don't.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D65), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: What follows an apostrophe as a word of its own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

SPACE, LETTER, NUMBER, OTHER = range(4)
#: A task remembers the pieces of words up to so many bytes, and of so many words.
SHORT, REMEMBERED = 64, 1 << 18
#: Texts are encoded about so many bytes at a time.
BYTES = 1 << 22


def _kinds() -> np.ndarray:
    """The kind of every code point, by its general category; white space as Unicode has it."""
    of = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    kinds = np.array([of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    kinds[[9, 10, 11, 12, 13, 0x85]] = SPACE
    for value, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for a, b in ranges:
            kinds[a : b + 1] = value
    return kinds


def _spelling() -> dict[str, int]:
    """The byte that each character of the file's tokens stands for: printing characters for themselves, others shifted up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """The vocabulary file's merges and tokens as arrays, small enough to be broadcast."""

    def __init__(self, path: str = MODEL):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], file["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or file["normalizer"] or odd or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        spelling, vocab = _spelling(), model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.first = np.array([vocab[a] for a, _ in merges], np.int64)
        self.second = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        at = {t: i for i, t in reversed([*enumerate(self.made.tolist())])}
        if any(at.get(x, -1) >= i for i, (a, b) in enumerate(zip(self.first.tolist(), self.second.tolist())) for x in (a, b)):
            raise ValueError(f"{path} has a merge that comes before its parts")
        keys = self.first << 32 | self.second
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.of_byte = np.empty(256, np.int64)
        for c, b in spelling.items():
            self.of_byte[b] = vocab[c]
        self.added = {}
        for x in file["added_tokens"]:
            if x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]:
                raise ValueError(f"{path}: added token {x['content']!r} is no plain one")
            self.added[x["content"]] = x["id"]
        spelled = {i: bytes(spelling[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        sizes = np.zeros(max(spelled) + 2, np.int64)
        for i, b in spelled.items():
            sizes[i + 1] = len(b)
        self.begins = np.cumsum(sizes)
        self.spelled = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(len(sizes) - 1)), np.uint8)
        self.kinds = _kinds()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, -1 where there is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the words, one after another, and how many each has (no word is empty).

        Each pair with a merge is mapped to all its places in all words. The active ranks are taken in ascending order
        from a heap: the places of one rank are merged together, from the left where they overlap, and the pairs that
        come about go to the lists of their own ranks, which are always higher. Work follows the number of merges, not
        that of words times merges, however long a word is.
        """
        flat = np.frombuffer(b"".join(words), np.uint8)
        n = len(flat)
        starts = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        token = np.append(self.of_byte[flat], -2)  # with an end that all words share
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[starts[1:] - 1] = after[n] = n
        before[starts[:-1]] = n
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self.ranks(token[at], token[after[at]])
            some = np.flatnonzero(rank >= 0)
            if not len(some):
                return
            some = some[np.argsort(rank[some], kind="stable")]
            rank, at = rank[some], at[some]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else [at]):
                if r in places:
                    places[r].append(part)
                else:
                    places[r] = [part]
                    heapq.heappush(heap, r)

        enter(np.flatnonzero(after[:n] < n))
        while heap:
            r = heapq.heappop(heap)
            lists = places.pop(r)
            a, b = self.first[r], self.second[r]
            at = np.concatenate(lists) if len(lists) > 1 else lists[0]
            at = at[token[at] == a]
            at = at[token[after[at]] == b]  # of a word's last piece this is ``end``'s, which equals none
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]  # a place between two merges is entered by both
            if a == b and len(at) > 1:  # of places that overlap every other one
                runs = np.flatnonzero(np.concatenate(([True], after[at[:-1]] != at[1:])))
                at = at[(np.arange(len(at)) - np.repeat(runs, np.diff(np.append(runs, len(at))))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            behind = after[gone]
            token[at], token[gone], after[at], after[gone] = self.made[r], -1, behind, -1
            before[behind] = at
            enter(np.concatenate((before[at], at)))
        alive = token[:n] >= 0
        total = np.concatenate(([0], np.cumsum(alive)))
        return token[:n][alive].astype(np.int32), np.diff(total[starts])

    def split(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the words of the texts begin in the bytes: an ending after an apostrophe, or letters, numbers or other signs with one space before."""
        n = len(raw)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        point = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.kinds[point]
        m = len(point)
        fresh = np.zeros(m + 1, bool)
        fresh[np.searchsorted(heads, offsets)] = True  # a text begins, or all end
        turn = fresh.copy()
        turn[1:m] |= kind[1:] != kind[:-1]
        turn[m] = True
        at = np.flatnonzero(turn[:m])
        ends = np.append(at[1:], m)
        blank = kind[at] == SPACE
        starts = np.zeros(m + 1, bool)
        starts[at[blank]] = True
        last = ends[blank] - 1
        last = last[~fresh[last + 1]]
        starts[last] = True  # one white space is left for what follows
        signs = at[~blank]
        joined = np.zeros(len(signs), bool)
        if m:
            joined = (signs > 0) & ~fresh[signs] & (point[signs - 1] == 32)
        starts[signs[~joined]] = True
        alone = signs[~joined]
        alone = alone[(point[alone] == 39) & turn[alone + 1] & ~fresh[alone + 1]]
        if len(alone):
            padded = np.concatenate((point, [0, 0]))
            one, two = padded[alone + 1], padded[alone + 2]
            two[fresh[np.minimum(alone + 2, m)]] = 0  # the next text's
            size = np.zeros(len(alone), np.int64)
            for x in ENDINGS:
                size[(size == 0) & (one == ord(x[0])) & ((len(x) == 1) | (two == ord(x[-1])))] = len(x)
            alone, size = alone[size > 0], size[size > 0]
            starts[alone + 1] = False
            beyond = alone + 1 + size
            starts[beyond] |= kind[np.minimum(beyond, m - 1)] == LETTER
        return heads[np.flatnonzero(starts[:m])] if n else heads


class Encoder:
    """Encodes slice after slice of one task and remembers the pieces of short words meanwhile."""

    def __init__(self, model: Model):
        self.model = model
        self.added = re.compile("|".join(map(re.escape, sorted(model.added, key=len, reverse=True)))) if model.added else None
        self.forget()

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def _pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of remembered and new words, where those of each of ``words`` begin, and how many they are."""
        if len(self.slots) > REMEMBERED:
            self.forget()
        slots = self.slots
        new = [w for w in words if w not in slots]
        keep = [w for w in new if len(w) <= SHORT]
        brief, long = {}, [w for w in new if len(w) > SHORT]
        for group in (keep, long):
            if group:
                ids, counts = self.model.merged(group)
                if group is keep:
                    slots.update(zip(group, range(len(slots), len(slots) + len(group))))
                    self.ids.append(ids)
                    self.counts.append(counts)
                else:
                    brief = {w: i for i, w in enumerate(group)}
                    extra = ids, counts
        if len(self.ids) > 1:
            self.ids, self.counts = [np.concatenate(self.ids)], [np.concatenate(self.counts)]
        all_ids = [*self.ids, *([extra[0]] if brief else [])]
        all_counts = np.concatenate([*self.counts, *([extra[1]] if brief else [])])
        begins = np.cumsum(all_counts) - all_counts
        at = np.array([slots[w] if w in slots else len(slots) + brief[w] for w in words], np.int64)
        return np.concatenate(all_ids), begins[at], all_counts[at]

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (with the total at the end)."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts = self.model.split(raw, offsets)
        bounds = np.append(starts, len(raw)).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        ids, begins, counts = self._pieces(coded.dictionary.to_pylist())
        word = coded.indices.to_numpy()
        sizes = counts[word]
        to = np.concatenate(([0], np.cumsum(sizes)))
        out = ids[np.repeat(begins[word] - to[:-1], sizes) + np.arange(to[-1])]
        return out, to[np.searchsorted(starts, offsets)]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_plain``, with added tokens' own spelling in a text read as the token."""
        data = raw.tobytes()
        if self.added is None or not any(t.encode() in data for t in self.model.added):
            return self._plain(raw, offsets)
        parts, tokens, of, kept = [], [], [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            text, at = data[a:b].decode(), 0
            for m in self.added.finditer(text):
                parts += [text[at : m.start()].encode()]
                tokens += [self.model.added[m[0]]]
                of += [i]
                at = m.end()
            parts += [text[at:].encode()]
            tokens += [-1]
            of += [i]
        ids, to = self._plain(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))))
        tokens = np.array(tokens)
        ids = np.insert(ids, to[1:][tokens >= 0], tokens[tokens >= 0])
        sizes = np.diff(to) + (tokens >= 0)
        kept = np.bincount(of, sizes, len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(kept)))


def _clash(carry: tuple[str, ...]) -> None:
    if clash := {"doc_id", "text", "ids", "decoded"} & {*carry}:
        raise ValueError(f"carried columns clash with the result's: {sorted(clash)}")


def encode(spark: SparkSession, docs: DataFrame, path: str = MODEL, carry: tuple[str, ...] = (), packed: bool = False) -> DataFrame:
    """(doc_id, *carry, ids): each whole text's ids, as the model's own library gives them without special tokens added.

    Words are split as the model asks. A slice's distinct words that the task doesn't remember are merged together, see
    ``Model.merged``; the ids don't depend on what is remembered. The spelling of an added token in a text is that
    token, as in the library. ``ids`` is an array, or with ``packed`` one binary of little-endian unsigned 32-bit
    integers. Null and empty texts have no ids; a text of any length stays whole in its task, one word of any length
    too; repeated rows are kept, with equal ids. An empty table gives an empty result. ``carry`` names columns to pass
    through (none of the result's names); all others are left out. Row by row: no shuffle.
    """
    _clash(carry)
    model = spark.sparkContext.broadcast(Model(path))
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            for first, rows, raw, offsets in common.slices(batch, limit=BYTES):
                ids, to = encoder.encode(raw, offsets)
                flat, part = pa.py_buffer(ids.astype("<u4")), batch.slice(first, rows)
                if packed:
                    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(to * 4), flat]).cast(pa.binary())
                else:
                    column = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.Array.from_buffers(pa.int32(), len(ids), [None, flat]))
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], column], names=["doc_id", *carry, "ids"])

    return docs.select("doc_id", "text", *carry).mapInArrow(common.tidy(run), f"doc_id long{kinds}, ids {'binary' if packed else 'array<int>'}")


def decode(spark: SparkSession, encoded: DataFrame, path: str = MODEL, carry: tuple[str, ...] = (), packed: bool = False) -> DataFrame:
    """(doc_id, *carry, decoded) for rows of ``encoded(doc_id, ids)``: the text that the ids spell, added tokens too.

    Ids are as ``encode`` gives them, array or ``packed``. Null or no ids give an empty text, ids that the model lacks
    spell nothing, and bytes that are no UTF-8 become U+FFFD, as in the library. Repeated rows are kept; an empty table
    gives an empty result; ``carry`` as in ``encode``.
    """
    if clash := {"doc_id", "decoded"} & {*carry}:
        raise ValueError(f"carried columns clash with the result's: {sorted(clash)}")
    model = spark.sparkContext.broadcast(Model(path))
    kinds = "".join(f", `{c}` {encoded.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = model.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                if packed:
                    own = [x.as_buffer() if x.is_valid else b"" for x in part.column(1)]
                    ids = np.concatenate([np.frombuffer(x, "<u4") for x in own]).astype(np.int64)
                    counts = np.array([len(x) // 4 for x in own])
                else:
                    counts = np.array([0 if n is None else n for n in part.column(1).value_lengths().to_pylist()])
                    ids = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                known = (ids >= 0) & (ids < len(v.begins) - 1)
                ids = np.where(known, ids, 0)
                sizes = np.where(known, v.begins[ids + 1] - v.begins[ids], 0)
                to = np.concatenate(([0], np.cumsum(sizes)))
                data = v.spelled[np.repeat(v.begins[ids] - to[:-1], sizes) + np.arange(to[-1])].tobytes()
                at = to[np.concatenate(([0], np.cumsum(counts)))].tolist()
                out = [data[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(out, pa.string())], names=["doc_id", *carry, "decoded"])

    return encoded.select("doc_id", "ids", *carry).mapInArrow(common.tidy(run), f"doc_id long{kinds}, decoded string")
