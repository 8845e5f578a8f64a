"""Repeated word passages by backward search in a compressed FM-index per shard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from rankloom.llm import repeats

#: Stretches that are streamed against the index at a time.
STREAM = 1 << 14


class Bits:
    """A bit vector in 64-bit words, with the ones before each word counted."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.pad(bits, (0, 64 - len(bits) % 64)), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.uint32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that k ones stand before."""
        word = np.searchsorted(self.before, k, "right") - 1
        rest, left = self.words[word], k - self.before[word]
        at = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(rest & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= low
            left = np.where(up, left - low, left)
            rest = np.where(up, rest >> np.uint64(width), rest)
            at += np.where(up, width, 0)
        return (word << 6) + at


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code for symbols of these counts (all above zero), by merging two sorted queues."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    order = np.argsort(counts, kind="stable")
    weight, parent = counts[order].tolist(), [0] * (2 * n - 1)
    leaf, inner, top = 0, n, n
    while top < 2 * n - 1:
        pair = 0
        for _ in range(2):
            if leaf < n and (inner >= top or weight[leaf] <= weight[inner]):
                at, leaf = leaf, leaf + 1
            else:
                at, inner = inner, inner + 1
            parent[at] = top
            pair += weight[at]
        weight.append(pair)
        top += 1
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    out = np.empty(n, np.int64)
    out[order] = depth[:n]
    return out


class Wavelet:
    """A wavelet tree of Huffman shape over symbols 0 to n - 1: as many bits as the sequence's entropy, and counts.

    A level holds the bits of the symbols whose code reaches it, node by node. ``ranks`` walks a symbol's path: at each
    node it counts the symbols that go the same way.
    """

    def __init__(self, sequence: np.ndarray):
        self.counts = np.bincount(sequence)
        self.length = code_lengths(self.counts)
        order = np.lexsort((np.arange(len(self.length)), self.length))
        codes, code, last = np.zeros(len(order), np.uint64), 0, 0
        sorted_lengths = self.length[order].tolist()
        made = []
        for size in sorted_lengths:  # canonical: shorter codes first, then by symbol
            code <<= size - last
            made.append(code << (64 - size))
            code, last = code + 1, size
        codes[order] = np.array(made, np.uint64)
        self.codes = codes
        self.levels = []
        node = np.zeros(len(sequence), np.int64)
        nodes = 1
        for k in range(int(self.length.max())):
            bit = (codes[sequence] >> np.uint64(63 - k) & np.uint64(1)).astype(bool)
            size = np.bincount(node, minlength=nodes)
            begin = np.concatenate(([0], np.cumsum(size)))[:-1]
            bits = Bits(bit)
            onward = self.length[sequence] > k + 1
            branch = 2 * node + bit
            sequence, branch = sequence[onward], branch[onward]
            turn = np.argsort(branch, kind="stable")
            sequence, branch = sequence[turn], branch[turn]
            kept, node = np.unique(branch, return_inverse=True)
            child = np.zeros(2 * nodes, np.int64)
            child[kept] = np.arange(len(kept))
            self.levels.append((bits, begin, bits.ones(begin), child))
            nodes = len(kept)

    def ranks(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        out, node = place.copy(), np.zeros(len(place), np.int64)
        live = np.arange(len(place))
        code, size = self.codes[symbol], self.length[symbol]
        for k, (bits, begin, before, child) in enumerate(self.levels):
            if k:
                live = live[size[live] > k]
                if not len(live):
                    break
            n, at = node[live], out[live]
            up = bits.ones(begin[n] + at) - before[n]
            one = (code[live] >> np.uint64(63 - k) & np.uint64(1)).astype(np.int64)
            out[live] = np.where(one, up, at - up)
            node[live] = child[2 * n + one]
        return out


class Index:
    """A shard's FM-index: nothing of its suffix order is kept.

    It has the Burrows-Wheeler transform of the stretches in a wavelet tree, one bit a row for whether its first
    ``length`` symbols differ from the row's before, and for each class of rows so marked off the smallest document.
    Stretches end in separators that differ from each other, so that no match crosses them.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, stretches: int, longest: int, length: int):
        order, new = _suffixes(text, stretches, longest, length)
        self.tree = Wavelet(text[order - 1])
        self.first = np.concatenate(([0], np.cumsum(self.tree.counts)))  # rows that begin with a smaller symbol
        self.classes = Bits(new)
        self.least = np.minimum.reduceat(owner[order], np.flatnonzero(new))

    def extend(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The bound ``row`` of an interval after one step of backward search by ``symbol``."""
        return self.first[symbol] + self.tree.ranks(symbol, row)

    def whole(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that begin with each symbol."""
        return self.first[symbol], self.first[symbol + 1]

    def widened(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first row that shares ``length`` symbols with each row, and the smallest document of all that do."""
        of = self.classes.ones(row + 1) - 1
        return self.classes.select(of), self.least[of]

    def statistics(self, text: np.ndarray, last: np.ndarray, size: np.ndarray, length: int):
        """Matching statistics of stretches ``text[last - size + 1 : last + 1]``, streamed right to left.

        Yields (stretches, place of a window's first symbol, smallest document) for each window of ``length`` symbols
        that occurs in the shard. A window that occurs is extended by one symbol to the left and cut to ``length``
        again; after one that does not, the search starts anew from the windows' last symbols.
        """
        k = np.zeros(len(last), np.int64)  # windows done
        live = np.flatnonzero(size >= length)
        low = np.zeros(len(last), np.int64)
        fresh = live
        while len(live):
            if len(fresh):
                at = last[fresh] - k[fresh]
                a, b = self.whole(text[at])
                for _ in range(length - 1):
                    at = at - 1
                    a, b = self.extend(text[at], a), self.extend(text[at], b)
                low[fresh] = np.where(a < b, a, -1)
            hit = live[low[live] >= 0]
            begin, least = self.widened(low[hit])
            low[hit] = begin
            yield hit, last[hit] - k[hit] - length + 1, least
            k[live] += 1
            live = live[size[live] - k[live] >= length]
            on = live[low[live] >= 0]
            symbol = text[last[on] - k[on] - length + 1]
            row, stop = self.extend(symbol, low[on]), self.extend(symbol, self._end(low[on]))
            low[on] = np.where(row < stop, row, -1)
            # one symbol more without a match says nothing of the window without its last
            fresh = live[low[live] < 0]

    def _end(self, row: np.ndarray) -> np.ndarray:
        """The row after the last that shares ``length`` symbols with each row."""
        of = self.classes.ones(row + 1)
        inside = of < len(self.least)
        out = np.full(len(row), self.first[-1])
        out[inside] = self.classes.select(of[inside])
        return out


def _suffixes(text: np.ndarray, stretches: int, longest: int, length: int):
    """Suffix order by doubling, and for each row whether its first ``length`` symbols differ from the row before's."""
    n = len(text)
    rank = text.astype(np.int64) + stretches - 1
    ends = np.flatnonzero(text == 0)
    rank[ends] = np.arange(len(ends))
    have, deep = 1, 1
    kept = rank
    while True:
        if have * 2 > length and deep == 1:
            kept, deep = rank, have  # ranks by the largest power of two within the length
        key = rank * (n + stretches + 1)
        key[: n - have] += rank[have:] + 1 if have < n else 0
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.concatenate(([False], sorted_[1:] != sorted_[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        have *= 2
        if (new[1:].all() or have > longest) and deep > 1 or length == 1:
            break
    shift = np.minimum(order + length - deep, n - 1)
    new = np.ones(n, bool)
    new[1:] = (kept[order[1:]] != kept[order[:-1]]) | (kept[shift[1:]] != kept[shift[:-1]])
    return order, new


def earlier_document(symbols, offsets, anchor, doc, windows, length):
    """Whether each window of the stretches starts in a smaller document too: the index names the smallest that has it."""
    stretches, sizes = len(doc), np.diff(offsets)
    known, ids = np.unique(symbols, return_inverse=True)
    text = np.zeros(len(symbols) + stretches, np.int32)
    text[np.arange(len(symbols)) + np.repeat(np.arange(stretches), sizes)] = ids + 1
    del known, ids
    index = Index(text, np.repeat(doc, sizes + 1), stretches, int(sizes.max()), length)
    edge = np.concatenate(([0], np.cumsum(windows)))
    begins = offsets[:-1] + np.arange(stretches)  # where each stretch starts in text
    out = np.zeros(edge[-1], bool)
    for a in range(0, stretches, STREAM):
        s = np.arange(a, min(a + STREAM, stretches))
        for hit, place, least in index.statistics(text, begins[s] + sizes[s] - 1, sizes[s], length):
            of = s[hit]
            out[edge[of] + place - begins[of]] = least < doc[of]
    return out


def dedup(docs: DataFrame, length: int = 13, carry: tuple[str, ...] = (), hot: int = repeats.HOT, want: tuple[str, ...] = tuple(repeats.RESULTS)) -> DataFrame:
    """Every text's words without those covered by a ``length``-word window that starts in a smaller doc_id.

    See ``repeats.without_repeats`` for the columns and for nulls, empty and very long texts, ties and repeated rows.
    """
    return repeats.without_repeats(docs, repeats.Unit(True, length, max(1, length // 2 - 1)), earlier_document, carry, hot, want)
