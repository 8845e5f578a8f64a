"""Periodic runs of words: found once for each rule of a Re-Pair grammar, carried to all places that derive it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm import common

#: A run has so many words at least, and two periods.
LEAST = 12
#: Pairs of places compared at a time.
STEP = 1 << 19
#: Texts are looked at about so many bytes at a time.
BYTES = 1 << 21


def _equal_groups(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs (a, b) that their document has more than once, by pair and place, and the number of the pair of each.

    Pairs alone in a bucket of a hash are left out before the sort; what is sorted is compared by its values.
    """
    bits = max(10, min(24, int(len(a)).bit_length() + 3))
    with np.errstate(over="ignore"):
        h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + doc.astype(np.uint64)
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    h = h.astype(np.int64)
    some = np.flatnonzero(np.bincount(h, minlength=1 << bits)[h] > 1)
    some = some[np.lexsort((some, b[some], a[some], doc[some]))]
    if not len(some):
        return some, some
    new = np.concatenate(([True], (a[some[1:]] != a[some[:-1]]) | (b[some[1:]] != b[some[:-1]]) | (doc[some[1:]] != doc[some[:-1]])))
    return some, np.cumsum(new) - 1


def grammar(words: np.ndarray, doc: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """Re-Pair of each document's words; ``words`` holds them one document after another, each parted by a mark of its own.

    Returns the rules, by round: the number of its rule, begin, middle and end of every place where a rule is derived;
    and the places where two symbols of what is left in the end meet. In a round every pair that its document has twice
    or more and that is more frequent than the pairs it overlaps (ties: by a hash, so that long stretches of ties end in few rounds) is replaced; no
    pair that overlaps itself is counted twice. So the most frequent pair of each document is always among them, and
    rounds end when no document has a pair twice. All places of a rule are known when it is made, as symbols only grow.
    """
    symbol, begin, of = words.astype(np.int64), np.arange(len(words)), doc
    end = begin + 1
    fresh = int(words.max(initial=0)) + 1
    rules, tops = [], []
    while len(symbol) > 1:
        inner = np.flatnonzero((symbol[:-1] >= 0) & (symbol[1:] >= 0))
        at, group = _equal_groups(symbol[inner], symbol[inner + 1], of[inner])
        at = inner[at]
        if len(at):  # of a symbol's own repetitions every other pair
            twin = np.flatnonzero(symbol[at] == symbol[at + 1])
            if len(twin):
                first = np.concatenate(([True], (at[twin[1:]] != at[twin[:-1]] + 1) | (group[twin[1:]] != group[twin[:-1]])))
                runs = np.flatnonzero(first)
                odd = (np.arange(len(twin)) - np.repeat(runs, np.diff(np.append(runs, len(twin))))) % 2 == 1
                stays = np.ones(len(at), bool)
                stays[twin[odd]] = False
                at, group = at[stays], group[stays]
            n = np.bincount(group)
            often = n[group] > 1
            at, group = at[often], group[often]
        if len(at):
            leading = np.full(len(n), len(symbol))
            np.minimum.at(leading, group, at)
            rank = np.empty(len(n), np.int64)
            rank[np.lexsort((common.mix(leading.astype(np.uint64)), n))] = np.arange(1, len(n) + 1)
            weight = np.zeros(len(symbol) + 1, np.int64)
            weight[at] = rank[group]
            wins = (weight[at] > weight[at - 1]) & (weight[at] > weight[at + 1])  # weight[-1] is 0
            at, group = at[wins], group[wins]
            often = np.bincount(group)[group] > 1
            at, group = at[often], group[often]
        busy = np.zeros(int(of.max(initial=-1)) + 2, bool)
        if len(at):
            names, number = np.unique(group, return_inverse=True)
            rules.append((number, begin[at], begin[at + 1], end[at + 1]))
            symbol[at], end[at] = fresh + number, end[at + 1]
            fresh += len(names)
            busy[of[at]] = True
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            symbol, begin, end, of = symbol[stays], begin[stays], end[stays], of[stays]
        going = busy[of]
        still = np.flatnonzero(~going)
        tops.append(begin[still[(symbol[still] >= 0) & (still > 0) & (symbol[still - 1] >= 0)]])
        symbol, begin, end, of = symbol[going], begin[going], end[going], of[going]
    return rules, np.concatenate(tops) if tops else np.zeros(0, np.int64)


class _Words:
    """The words of a slice's documents with hashes of all stretches, to extend repeats by."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, seed: int):
        self.words, self.doc = words, doc
        with np.errstate(over="ignore"):
            self.prefix = common.prefix_hash(common.mix(words.astype(np.uint64) + np.uint64(seed)))
        n = len(words)
        self.down = common.powers(n)[1]
        third = np.arange(max(0, n - 2))
        inner = third[(words[third] >= 0) & (words[third + 1] >= 0) & (words[third + 2] >= 0)]
        at, _ = _equal_groups(self.stretch(inner, 3).view(np.int64), doc[inner], doc[inner])
        #: Places whose three words occur again in their document: any others have no part in a run's repeats.
        self.live = np.sort(inner[at])
        self.repeats = np.zeros(n + 1, bool)
        self.repeats[self.live] = True

    def stretch(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of ``size`` words from each place on, to be compared among equal sizes."""
        return (self.prefix[at + size] - self.prefix[at]) * self.down[at]

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from a and b on (or ``back`` before them) are alike, ``most`` at most."""
        out = np.zeros(len(a), np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            can = np.flatnonzero(out + step <= most)
            x, y = (a[can] - out[can] - step, b[can] - out[can] - step) if back else (a[can] + out[can], b[can] + out[can])
            out[can[self.stretch(x, step) == self.stretch(y, step)]] += step
            step >>= 1
        return out

    def crossing(self, middle: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """(owner, start, end, period) of the runs inside [low, high) that cross ``middle``, of each triple.

        A run of period p that crosses repeats max(p, LEAST - p) words at distance p around the middle, half of them on
        one side of it: so a stretch of half that many, begun or ended at the middle, stands p words on or before. Such
        stretches are looked up by doubling classes of p, and extended both ways. Of equal runs the least period stays.
        """
        found = []
        spot, live = np.full(len(self.words) + 1, -1), self.live
        near = self.repeats[middle] | ((middle >= 3) & self.repeats[np.maximum(middle - 3, 0)])
        who = np.flatnonzero(near & (high - low >= LEAST))
        least = 1
        while len(who) and 2 * least <= int((high[who] - low[who]).max()):
            m = -(-min(max(p, LEAST - p) for p in range(least, min(2 * least, LEAST + 1))) // 2) if least < LEAST else least // 2
            inside = live[live + m < len(self.words)]
            _, group, count = np.unique(self.stretch(inside, m), return_inverse=True, return_counts=True)
            again = count[group] > 1
            if least >= LEAST // 2:  # longer stretches follow, and begin in these
                live = inside[again]
            inside, group = inside[again], group[again]
            spot[inside] = np.arange(len(inside))
            key = np.sort(group * len(self.words) + inside)  # by stretch and place
            for lead in (0, m):
                q = middle[who] - lead
                at = np.where(q >= 0, spot[np.maximum(q, 0)], -1)
                ok = at >= 0
                mine, q, base = who[ok], q[ok], group[at[ok]] * len(self.words)
                for sign in (1, -1):
                    edge = (q + least, q + 2 * least) if sign > 0 else (q - 2 * least + 1, q - least + 1)
                    a = np.searchsorted(key, base + np.maximum(edge[0], low[mine]))
                    b = np.searchsorted(key, base + np.maximum(np.minimum(edge[1], high[mine]), 0))
                    size = np.maximum(b - a, 0)
                    total = np.cumsum(size)
                    cuts = np.searchsorted(total, np.arange(STEP, int(total[-1]) if len(total) else 0, STEP))
                    for some in np.split(np.arange(len(mine)), np.unique(cuts)):
                        n = size[some]
                        if not n.sum():
                            continue
                        owner, start = np.repeat(mine[some], n), np.repeat(a[some] - np.cumsum(n) + n, n)
                        other = key[start + np.arange(len(owner))] % len(self.words)
                        period = np.abs(other - np.repeat(q[some], n))
                        left = middle[owner] - (period if sign < 0 else 0)
                        lo, hi = low[owner], high[owner]
                        fits = (left >= lo) & (left + period <= hi)
                        owner, period, left, lo, hi = owner[fits], period[fits], left[fits], lo[fits], hi[fits]
                        on = self.reach(left, left + period, hi - left - period, False)
                        off = self.reach(left, left + period, left - lo, True)
                        long = on + off >= np.maximum(period, LEAST - period)
                        found.append(np.stack((owner, left - off, left + period + on, period))[:, long])
            spot[inside] = -1
            least *= 2
        if not found:
            return tuple(np.zeros((4, 0), np.int64))
        all_ = np.concatenate(found, axis=1)
        all_ = all_[:, np.lexsort(all_[::-1])]
        new = np.ones(all_.shape[1], bool)
        new[1:] = (all_[:3, 1:] != all_[:3, :-1]).any(axis=0)
        return tuple(all_[:, new])

    def right(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
        """Whether the runs' words themselves, not just their hashes, repeat."""
        size = end - start - period
        for some in np.split(np.arange(len(size)), np.unique(np.searchsorted(np.cumsum(size), np.arange(STEP, int(size.sum()), STEP)))):
            n = size[some]
            at = np.repeat(start[some] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            if (self.words[at] != self.words[at + np.repeat(period[some], n)]).any():
                return False
        return True


def find(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of ``words``, by start and period; documents are parted by marks, one first and one last.

    Runs that cross the middle of a rule's expansion are computed at the rule's first place and carried to all others;
    runs that cross a meeting place of the last symbols follow in the whole document. A stretch of the words lies whole
    in one rule or crosses such a place, so no run is missed. What goes on beyond a rule's edge is part of a longer run
    of its period, found at a larger rule or meeting place, and merged into it.
    """
    rules, tops = grammar(words, doc)
    marks = np.flatnonzero(words < 0)
    after = np.searchsorted(marks, tops)
    low, middle, high = marks[np.maximum(after - 1, 0)] + 1, tops, marks[after]
    places, first, count = low, np.arange(len(tops)), np.ones(len(tops), np.int64)
    if rules:  # by rule: its first place, and all places
        shift = np.cumsum([0, *(int(number[0].max()) + 1 for number in rules)])
        number, begin, mid, end = (np.concatenate(x) for x in zip(*((r[0] + k, *r[1:]) for r, k in zip(rules, shift.tolist()))))
        order = np.argsort(number, kind="stable")
        heads = np.flatnonzero(np.diff(number[order], prepend=-1))
        rep = order[heads]
        low, middle, high = (np.concatenate(x) for x in ((low, begin[rep]), (middle, mid[rep]), (high, end[rep])))
        first, count = np.concatenate((first, heads + len(places))), np.concatenate((count, np.diff(np.append(heads, len(order)))))
        places = np.concatenate((places, begin[order]))
    seed = 0
    while True:
        w = _Words(words, doc, seed)
        owner, start, end, period = w.crossing(middle, low, high)
        n = count[owner]
        at = np.repeat(first[owner] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        move = places[at] - np.repeat(low[owner], n)
        start, end, period = np.repeat(start, n) + move, np.repeat(end, n) + move, np.repeat(period, n)
        whole = (words[start - 1] != words[start - 1 + period]) & (words[end] != words[end - period])
        start, end, period = start[whole], end[whole], period[whole]
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[new], end[new], period[new]
        if w.right(start, end, period):
            order = np.lexsort((period, start))
            return start[order], end[order], period[order]
        seed += 1  # two stretches had one hash


def _repeated(ids: list, first: np.ndarray) -> np.ndarray:
    """Which word stands at each place once the tails of the chosen documents repeat, see ``collapse``."""
    at = np.arange(int(first[-1]))
    for i, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if i is None or not n or (h := zlib.crc32(str(i).encode())) % 10:
            continue
        g = h // 10
        tail = g % n
        at[a + tail : b] = a + tail + np.arange(n - tail) % (1 + (n - tail) // (3 + g % 8))
    return at


def collapse(docs: DataFrame, repeat: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the periodic runs of each whole text's words, and the text with one period of each.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of smallest period q of max(LEAST, 2 q) words
    or more that no neighbouring word extends; ``runs`` has (start, length, period) by start, then period. A word goes
    if a run holds it after the run's first q words; the others are joined by one space in ``collapsed``. Words are told
    apart by themselves, never by a hash. With ``repeat``, one in ten documents (crc32 of doc_id in decimal) has its
    tail's words replaced by repetitions of the tail's beginning first; a null doc_id is left as it is. Null, empty and
    blank texts have no words, no runs and an empty text. Row by row, without a shuffle: repeated rows give equal rows,
    an empty table gives none, other columns than doc_id and text are left out; a text of any length is one task's.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for f, rows, raw, offsets in common.slices(batch, limit=BYTES):
                starts, ends, row = common.words_of(raw, offsets)
                first = np.searchsorted(row, np.arange(rows + 1))
                spelled, at = common.spaced(raw, starts, ends)
                codes = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(spelled)]).dictionary_encode().indices.to_numpy().astype(np.int64)
                place = _repeated(ids[f : f + rows], first) if repeat else np.arange(len(codes))
                where = np.arange(len(codes)) + row + 1
                words = np.full(len(codes) + rows + 1, -1)
                words[where] = codes[place]
                marks = words < 0
                words[marks] = -1 - np.arange(rows + 1)
                doc = np.cumsum(marks) - 1
                start, end, period = find(words, doc)
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, start + period, 1)
                np.subtract.at(step, end, 1)
                kept = np.cumsum(step)[where] == 0
                text, at = common.spaced(raw, starts[place[kept]], ends[place[kept]])
                text, upto = text.tobytes(), np.concatenate(([0], np.cumsum(kept)))[first]
                of = doc[start]
                own = start - of - 1 - first[of]
                bounds = np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (own, end - start, period)], fields=list(run_type.value_type))
                out = [text[at[a] : at[b] - 1].decode() if b > a else "" for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(f, rows), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), runs), pa.array(out, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(common.tidy(run), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
