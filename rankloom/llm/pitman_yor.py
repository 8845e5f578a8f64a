"""Language-model scoring by a hierarchical Pitman-Yor model of words and their spelling.

A restaurant for each training word seats the tokens that follow it (texts begin after the end token). Their common parent
is the word restaurant, whose customers are their tables. Its parent spells words byte by byte, each byte in the restaurant of the
three bytes before it, whose parents are the restaurants of two, one and no bytes before it; the root's parent is
uniform. Restaurants of one shorter context share their parent. A table of a restaurant is a customer of its parent.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common

#: Discount and strength of the restaurants of a word before, of the word restaurant and of the spelling restaurants.
NEXT, WORD, SPELL = (0.8, 2.0), (0.6, 10.0), (0.5, 2.0)
#: Gibbs sweeps, and how many of the last count for the averages.
SWEEPS, KEPT, SEED = 4, 2, 3
#: Bytes of context, bits of a byte's class in a context, and symbols (bytes and the end of a word).
ORDER, CLASS_BITS, SYMBOLS, END = 3, 5, 257, 256
#: Customers up to which a seating is drawn from its exact distribution.
EXACT = 64
#: Sums of probabilities travel as whole numbers of this fraction.
UNIT = 1e12
#: Bytes of text of a block, whose words and pairs of words are sent once each.
FLUSH = 16 << 20
#: Bytes of text for each bucket of words.
BUCKET = 12 << 20

# a context knows letters apart, and kinds of other bytes: its number of restaurants is bounded
_KIND = np.full(256, 28, np.int64)
_KIND[97:123] = np.arange(1, 27)
_KIND[48:58] = 27
_KIND[128:] = 29 + np.arange(128) % 3


def _stirling(discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers S(c, t), c and t up to EXACT."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = s[c, t] + np.log(np.maximum(c - discount * t, 1e-300))
        s[c + 1, t] = np.logaddexp(s[c, t - 1], stay)
    return s


_TABLES = {d: _stirling(d) for d in (NEXT[0], WORD[0], SPELL[0])}


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Draws that depend on key and salt alone, so that a recomputed task seats as before."""
    h = common.mix(keys ^ np.uint64((salt * 0x9E3779B97F4A7C15 + SEED) % (1 << 64)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def seat(count: np.ndarray, new: np.ndarray, discount: float, keys: np.ndarray, salt: int) -> np.ndarray:
    """Tables of each dish: all its customers resampled given every other dish (a blocked Gibbs step).

    ``count`` customers of a dish; ``new``: its weight of a new table, (strength + discount x tables) x the parent's
    probability. The number of tables t has weight new**t S(count, t). Up to EXACT customers it is drawn from just
    that; those above join one after another, a run of joiners at a time, each table's arrival drawn from the chance
    that nobody opened one before (n >> new, where its gamma quotient is a power).
    """
    stirling = _TABLES[discount]
    tables = np.ones(len(count), np.int64)
    logs = np.log(np.maximum(new, 1e-300))
    first = np.minimum(count, EXACT)
    for c in np.unique(first[first > 1]).tolist():
        mine = np.flatnonzero(first == c)
        for a in range(0, len(mine), 1 << 14):
            some = mine[a : a + (1 << 14)]
            t = np.arange(1, c + 1)
            weight = logs[some][:, None] * t + stirling[c, t]
            weight = np.exp(weight - weight.max(1, keepdims=True))
            total = np.cumsum(weight, axis=1)
            tables[some] = (total < (_uniform(keys[some], salt) * total[:, -1])[:, None]).sum(1) + 1
    live = np.flatnonzero(count > EXACT)
    seated = np.full(len(live), float(EXACT))
    step = 1
    while len(live):
        t, a = tables[live], np.maximum(new[live], 1e-12)
        with np.errstate(over="ignore"):
            seated = discount * t + (seated - discount * t) * _uniform(keys[live], salt + 1000 * step) ** (-1 / a)
        opened = seated + 1 <= count[live]
        live, seated = live[opened], np.floor(seated[opened]) + 1
        tables[live] += 1
        step += 1
    return np.minimum(tables, np.maximum(count, 1))


class Deepest:
    """Predictions of the deepest restaurants, as what each adds to its share of its parent's; opened up where used."""

    def __init__(self, at: np.ndarray, extra: np.ndarray, share: np.ndarray, parent: np.ndarray):
        self.at, self.extra, self.share, self.parent, self.all = at, extra, share, parent, None

    def __getstate__(self):
        return self.__dict__ | {"all": None}

    def dense(self) -> np.ndarray:
        if self.all is None:
            self.all = np.tile(self.parent, (len(self.share) // len(self.parent), 1)) * self.share[:, None]
            self.all.reshape(-1)[self.at] += self.extra
        return self.all


class Spelling:
    """Averages and seating of the spelling restaurants; level k has the contexts of k bytes."""

    def __init__(self):
        self.predict = [np.full((1 << (CLASS_BITS * k), SYMBOLS), 1 / SYMBOLS, np.float32) for k in range(ORDER + 1)]
        none = np.zeros(0, np.int64)
        self.deepest = Deepest(none, none.astype(np.float32), np.ones(1 << (CLASS_BITS * ORDER), np.float32), self.predict[ORDER - 1])

    def sweep(self, slot: np.ndarray, symbol: np.ndarray, count: np.ndarray, salt: int) -> None:
        """Seats the customers of every level, deepest first, then renews the predictions from the root down."""
        discount, strength = SPELL
        seats = []
        for k in range(ORDER, -1, -1):
            parent = self.predict[k - 1][slot & ((1 << (CLASS_BITS * (k - 1))) - 1), symbol] if k else np.float32(1 / SYMBOLS)
            entries = np.bincount(slot, minlength=1)
            new = (strength + discount * entries[slot]) * parent
            keys = (slot.astype(np.uint64) << np.uint64(9)) | symbol.astype(np.uint64)
            tables = seat(count, np.broadcast_to(new, count.shape).astype(float), discount, keys, salt * 10 + k)
            seats.append((k, slot, symbol, count, tables))
            if k:
                up = (slot & ((1 << (CLASS_BITS * (k - 1))) - 1)) * SYMBOLS + symbol
                at, inverse = np.unique(up, return_inverse=True)
                slot, symbol = at // SYMBOLS, at % SYMBOLS
                count = np.bincount(inverse, tables, len(at)).astype(np.int64)
        for k, slot, symbol, count, tables in reversed(seats):
            size = 1 << (CLASS_BITS * k)
            all_, opened = np.bincount(slot, count, size), np.bincount(slot, tables, size)
            share = ((strength + discount * opened) / (strength + all_)).astype(np.float32)
            parent = self.predict[k - 1] if k else np.full((1, SYMBOLS), 1 / SYMBOLS, np.float32)
            extra = ((count - discount * tables) / (strength + all_[slot])).astype(np.float32)
            level = Deepest(slot * SYMBOLS + symbol, extra, share, parent)
            self.predict[k] = level.dense()
        self.deepest = level


def _spelt(raw: np.ndarray, offsets: np.ndarray):
    """Context, symbol and word number of every byte of the words and of their ends."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    at = offsets[:-1] + np.arange(n)  # with one end a word
    symbol = np.full(len(raw) + n, END, np.int64)
    word = np.repeat(np.arange(n), size + 1)
    body = np.arange(len(raw)) + np.repeat(np.arange(n), size)
    symbol[body] = raw
    kind = np.zeros(len(symbol), np.int64)
    kind[body] = _KIND[raw]
    place = np.arange(len(symbol)) - at[word]
    slot = np.zeros(len(symbol), np.int64)
    for k in range(1, ORDER + 1):
        back = np.zeros(len(symbol), np.int64)
        back[k:] = kind[:-k] if k < len(kind) else 0
        slot |= np.where(place >= k, back, 0) << (CLASS_BITS * (k - 1))
    return slot, symbol, word


def _chance(table: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each word's spelling."""
    slot, symbol, word = _spelt(raw, offsets)
    return np.exp(np.bincount(word, np.log(table[slot, symbol].astype(float)), len(offsets) - 1))


def _opens(opened: float, chance: np.ndarray) -> np.ndarray:
    return (WORD[1] + WORD[0] * opened) * chance


#: Hash of the end token: an empty word.
_EMPTY = int(common.mix(np.zeros(1, np.uint64))[0])


def _tokens(raw: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, words' starts, ends and rows, and their hashes."""
    low = common.fold(raw)
    starts, ends, row = common.words_of(low, offsets)
    h = common.spans(common.prefix_hash(low), starts, ends) if len(low) else np.zeros(0, np.uint64)
    return low, starts, ends, row, h


def _gram(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One key of a word and the word before it."""
    return common.mix(before * np.uint64(0x9E3779B97F4A7C15) + h)


def _in_order(h: np.ndarray, row: np.ndarray, size: int):
    """All tokens of ``size`` texts with the end tokens in their places: (row, hash, hash of the token before)."""
    rows = np.concatenate((row, np.arange(size)))
    order = np.argsort(rows, kind="stable")  # the end comes last in its text
    rows, all_ = rows[order], np.concatenate((h, np.full(size, _EMPTY, np.uint64)))[order]
    before = np.roll(all_, 1)
    before[np.flatnonzero(np.diff(rows, prepend=-1))] = _EMPTY
    return rows, all_, before


# What steps send each other: rows of packed arrays, sent from ``src`` to ``to``, of one of these kinds.
SENT = "kind int, src long, to long, data array<binary>"
DOCS, WORDS, VOCABULARY, IDS, PAIRS, SEATS, ONCE, MET, OPENED, HOME, DRAWN, EATEN, ANSWER, KNOWN = range(14)
#: Sums of the spelling's customers are made in so many parts; totals of a sweep are another.
PARTS, TOTALS = 8, -1


def _pack(a: np.ndarray) -> bytes:
    """An array of whole numbers or doubles, its bytes by their place, compressed."""
    a = np.ascontiguousarray(a)
    a = a if a.dtype.itemsize == 8 else a.astype(np.int64)
    data = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), 8).T).tobytes()
    return len(a).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(data, asbytes=True) if data else b"")


def _open(data: bytes, kind: type = np.int64) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], n * 8), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _rise(a: np.ndarray) -> bytes:
    """A rising array, by its steps."""
    return _pack(np.diff(a.astype(np.int64), prepend=0))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(_open(data))


def _pack_bytes(raw: np.ndarray) -> bytes:
    data = raw.tobytes()
    return len(data).to_bytes(8, "little") + (pa.Codec("zstd", 3).compress(data, asbytes=True) if data else b"")


def _open_bytes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(data[8:], n), np.uint8) if n else np.zeros(0, np.uint8)


def _offsets(size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return out


def _take(raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some words, end to end."""
    at = _offsets(size)
    return raw[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, src, to, data = zip(*rows) if rows else ((), (), (), ())
    arrays = [pa.array(kind, pa.int32()), pa.array(src, pa.int64()), pa.array(to, pa.int64()), pa.array(list(data), pa.list_(pa.binary()))]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "src", "to", "data"])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _rows(table: pa.Table) -> dict[int, list[tuple[int, list[bytes]]]]:
    """(src, data) of each kind, in an order of their own."""
    out: dict[int, list] = {}
    for kind, src, data in zip(table["kind"].to_pylist(), table["src"].to_pylist(), table["data"]):
        out.setdefault(kind, []).append((src, data))
    return {k: [(s, d.as_py()) for s, d in sorted(v, key=lambda x: x[0])] for k, v in out.items()}


def _reader(buckets: int) -> Callable:
    """Blocks of texts as numbers of their words, and each block's distinct words for the buckets of their hashes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0

        def block(found: list[tuple]) -> pa.RecordBatch:
            src = (task << 32) | made
            ids, held, size = (np.concatenate([f[k] for f in found]) for k in range(3))
            raw, sizes, h = (np.concatenate([f[k] for f in found]) for k in (3, 4, 5))
            starts = _offsets(sizes)[:-1]
            known, at, number = np.unique(np.concatenate((np.array([_EMPTY], np.uint64), h)), return_index=True, return_inverse=True)
            base = 1 + _offsets(np.array([len(f[5]) for f in found]))
            code = np.concatenate([number[base[k] + f[6]] for k, f in enumerate(found)])
            train = np.repeat(held == 0, size)
            times, n = np.bincount(code, minlength=len(known)), np.bincount(code[train], minlength=len(known))
            end = number[0]
            n[end], times[end] = (held == 0).sum(), len(code) + 1
            order = np.argsort(-times, kind="stable")  # the end comes first, then what comes often
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            starts, sizes = np.concatenate(([0], starts))[at][order], np.concatenate(([0], sizes))[at][order]
            home, n = (known[order] % np.uint64(buckets)).astype(np.int64), n[order]
            null = np.array([i is None for i in ids.tolist()])
            data = [_pack(np.array([i or 0 for i in ids.tolist()], np.int64)), *(_pack(x) for x in (null, held, size, rank[code], home))]
            rows = [(DOCS, src, src, data)]
            for b in np.unique(home).tolist():
                mine = np.flatnonzero(home == b)
                rows.append((WORDS, src, b, [_pack_bytes(_take(raw, starts[mine], sizes[mine])), _pack(sizes[mine]), _pack(n[mine])]))
            return _batch(rows)

        found, gathered = [], 0
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), object)
            held = np.array(batch.column(1).to_pylist(), np.int64)
            for first, rows, raw, offsets in common.slices(batch, "text"):
                low, starts, ends, row, h = _tokens(raw, offsets)
                known, at, number = np.unique(h, return_index=True, return_inverse=True)
                size = (ends - starts)[at]
                found.append((ids[first : first + rows], held[first : first + rows], np.bincount(row, minlength=rows), _take(low, starts[at], size), size, known, number))
                gathered += len(raw)
                if gathered >= FLUSH:
                    yield block(found)
                    found, gathered, made = [], 0, made + 1
        if found:
            yield block(found)

    return read


def _hashes(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = _offsets(size)
    return common.spans(common.prefix_hash(raw), at[:-1], at[1:])


def _numberer(buckets: int) -> Callable:
    """Counts the words of a bucket and numbers those of training texts from 1, often met ones first; each block hears of its own."""

    def number(table: pa.Table) -> pa.Table:
        b, sent = table["to"][0].as_py(), _rows(table)[WORDS]
        raws, sizes, ns = [_open_bytes(d[0]) for _, d in sent], [_open(d[1]) for _, d in sent], [_open(d[2]) for _, d in sent]
        raw, size = np.concatenate(raws), np.concatenate(sizes)
        known, at, inverse = np.unique(np.concatenate([_hashes(r, s) for r, s in zip(raws, sizes)]), return_index=True, return_inverse=True)
        c = np.bincount(inverse, np.concatenate(ns), len(known)).astype(np.int64)
        order = np.lexsort((known, -c))
        order = order[: (c > 0).sum()]
        ids = np.zeros(len(known), np.int64)
        ids[order] = np.arange(len(order)) * buckets + b + 1
        starts = _offsets(size)[:-1][at]
        size = size[at]
        rows = [(VOCABULARY, b, b, [_pack_bytes(_take(raw, starts[order], size[order])), _pack(size[order]), _pack(c[order])])]
        cuts = _offsets(np.array([len(s) for s in sizes]))
        for k, (src, _) in enumerate(sent):
            mine = inverse[cuts[k] : cuts[k + 1]]
            rows.append((IDS, b, src, [_pack(ids[mine]), _pack(c[mine])]))
        return _table(rows)

    return number


class Hot:
    """Words too frequent for one bucket: their pairs are dealt by the word before, their dishes seated on the driver."""

    def __init__(self, ids: np.ndarray, words: list[bytes], c: np.ndarray, buckets: int):
        order = np.argsort(ids)
        self.ids, self.c, self.buckets = ids[order], c[order], buckets
        words = [words[k] for k in order.tolist()]
        self.raw, self.size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        self.offsets = _offsets(self.size)
        self.h = _hashes(self.raw, self.size)

    def spot(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.ids):
            return np.zeros(len(w), np.int64), np.zeros(len(w), bool)
        spot = np.minimum(np.searchsorted(self.ids, w), len(self.ids) - 1)
        return spot, self.ids[spot] == w

    def bucket(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (w - 1 + np.where(self.spot(w)[1], u, 0)) % self.buckets


class Block:
    """A block's texts in numbers: of each token and the one before it, with the ends in their places."""

    def __init__(self, docs: dict, replies: dict[int, list[bytes]]):
        ((self.src, data),) = docs[DOCS]
        self.doc_id, self.null, self.held, size, code, home = map(_open, data)
        self.home = home
        self.members = {b: np.flatnonzero(home == b) for b in replies}
        self.ids, self.c = (self.gathered({b: _open(d[k]) for b, d in replies.items()}) for k in (0, 1))
        row = np.repeat(np.arange(len(size)), size)
        rows = np.concatenate((row, np.arange(len(size))))
        order = np.argsort(rows, kind="stable")
        self.row, self.token = rows[order], np.concatenate((code, np.zeros(len(size), np.int64)))[order]
        self.before = np.roll(self.token, 1)
        self.before[np.flatnonzero(np.diff(self.row, prepend=-1))] = 0

    def gathered(self, parts: dict[int, np.ndarray], kind: type = np.int64) -> np.ndarray:
        out = np.zeros(len(self.home), kind)
        for b, part in parts.items():
            out[self.members[b]] = part
        return out

    def pairs(self, hot: Hot):
        """(u, w, n) of the distinct pairs of known words, by w and u, their bucket, and each token's pair (-1: none)."""
        u, w = self.ids[self.before], self.ids[self.token]
        known = np.flatnonzero((u > 0) & (w > 0))
        key, inverse = np.unique((w[known] << 32) | u[known], return_inverse=True)
        n = np.bincount(inverse, self.held[self.row[known]] == 0, len(key)).astype(np.int64)
        of = np.full(len(u), -1)
        of[known] = inverse
        u, w = key & 0xFFFFFFFF, key >> 32
        return u, w, n, hot.bucket(u, w), of


def _pairer(hot: Hot) -> Callable:
    def pair(docs: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(_rows(docs), dict(_rows(replies)[IDS]))
        u, w, n, bucket, _ = block.pairs(hot)
        rows = []
        for b in np.unique(bucket).tolist():
            mine = np.flatnonzero(bucket == b)
            step = np.diff(u[mine], prepend=0)
            fresh = np.diff(w[mine], prepend=0)
            rows.append((PAIRS, block.src, b, [_pack(fresh), _pack(np.where(fresh == 0, step, u[mine])), _pack(n[mine])]))
        return _table(rows)

    return pair


def _unpaired(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (w, u) and numbers of a PAIRS row."""
    fresh, step, n = map(_open, data)
    total = np.cumsum(step)
    first = np.flatnonzero(fresh)
    start = np.repeat(total[first] - step[first], np.diff(np.append(first, len(step))))
    return (np.cumsum(fresh) << 32) | (total - start), n


class State:
    """What every bucket is told of a sweep: the spelling, and the word restaurant's tables before and after it."""

    def __init__(self, s: int, table: Deepest, before: float, now: float, seated: int):
        self.s, self.table, self.before, self.now, self.seated, self.hot_p = s, table, before, now, seated, np.zeros(0)

    def known(self, m: np.ndarray, chance: np.ndarray, h: np.ndarray) -> np.ndarray:
        discount, strength = WORD
        tables = seat(m, _opens(self.before, chance), discount, h, self.s)
        return (m - discount * tables + (strength + discount * self.now) * chance) / (strength + self.seated)


class Seats:
    """A bucket: its words, its pairs met more than once, and for each word the pairs met once."""

    def __init__(self, data: list[bytes], hot: Hot):
        self.raw, self.size, self.at = _open_bytes(data[0]), _open(data[1]), _risen(data[2])
        self.u, self.c, self.once = map(_open, data[3:])
        self.hot, self.types = hot, len(self.size)
        self.offsets = _offsets(self.size)
        self.h = _hashes(self.raw, self.size)
        self.before, self.of = np.unique(self.u, return_inverse=True)

    def dishes(self, t: np.ndarray) -> np.ndarray:
        return (np.bincount(self.at, t, len(self.once)) + self.once).astype(np.int64)

    def chance(self, table: Deepest) -> np.ndarray:
        return _chance(table.dense(), self.raw, self.offsets)

    def known(self, b: int, t: np.ndarray, state: State) -> np.ndarray:
        """Predictive probability of each word in the word restaurant."""
        m = self.dishes(t)[: self.types]
        p = np.zeros(self.types)
        own = np.flatnonzero(m)
        p[own] = state.known(m[own], self.chance(state.table)[own], self.h[own])
        here = (self.hot.ids - 1) % self.hot.buckets == b
        p[(self.hot.ids[here] - 1) // self.hot.buckets] = state.hot_p[here]
        return np.concatenate((p, state.hot_p))

    def eaten(self, b: int, t: np.ndarray, table: Deepest, opened: float, s: int) -> list[tuple]:
        """What this bucket adds to the spelling's customers and to the totals."""
        m = self.dishes(t)
        own = np.flatnonzero(m[: self.types])
        chance = self.chance(table)
        tables = np.zeros(self.types, np.int64)
        tables[own] = seat(m[own], _opens(opened, chance[own]), WORD[0], self.h[own], s)
        at, count = _customers(self.raw, self.offsets, tables)
        rows = [(EATEN, b, k, [_rise(at[at % PARTS == k]), _pack(count[at % PARTS == k])]) for k in range(PARTS)]
        totals = np.concatenate(([round(chance[own].sum() * UNIT), m[own].sum()], m[self.types :])).astype(np.int64)
        return [*rows, (EATEN, b, TOTALS, [_rise(np.arange(len(totals))), _pack(totals)])]

    def opened(self, b: int, t: np.ndarray) -> list[tuple]:
        """Tables of each word before, sent to its bucket."""
        total = np.bincount(self.of, t, len(self.before)).astype(np.int64)
        home = (self.before - 1) % self.hot.buckets
        return [(OPENED, b, k, [_rise(self.before[home == k]), _pack(total[home == k])]) for k in np.unique(home).tolist()]


def _customers(raw: np.ndarray, offsets: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot, symbol, word = _spelt(raw, offsets)
    at, inverse = np.unique(slot * SYMBOLS + symbol, return_inverse=True)
    n = np.bincount(inverse, tables[word], len(at)).astype(np.int64)
    return at[n > 0], n[n > 0]


def _merger(hot: Hot, table, opened: float) -> Callable:
    """Counts the pairs of a bucket; asks of blocks are kept with the answer's place, pairs met once are told by their sum."""

    def merge(vocabulary: pa.Table, pairs: pa.Table) -> pa.Table:
        ((b, words),) = _rows(vocabulary)[VOCABULARY] if vocabulary.num_rows else ((pairs["to"][0].as_py(), [_pack_bytes(np.zeros(0, np.uint8)), *[_pack(np.zeros(0))] * 2]),)
        sent = _rows(pairs).get(PAIRS, []) if pairs.num_rows else []
        none = np.zeros(0, np.int64)
        keys, ns = zip(*(_unpaired(d) for _, d in sent)) if sent else ((none,), (none,))
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate(ns)
        c = np.bincount(inverse, n, len(key)).astype(np.int64)
        u, w = key & 0xFFFFFFFF, key >> 32
        types = len(_open(words[1]))
        spot, is_hot = hot.spot(w)
        at = np.where(is_hot, types + spot, (w - 1) // hot.buckets)
        many = c > 1
        place = np.cumsum(many) - 1
        seats = [words[0], words[1], _rise(at[many]), _pack(u[many]), _pack(c[many]), _pack(np.bincount(at[c == 1], minlength=types + len(hot.ids)))]
        rows = [(SEATS, b, b, seats)]
        before, alone = np.unique(u[c == 1], return_counts=True)
        home = (before - 1) % hot.buckets
        rows += [(ONCE, b, k, [_rise(before[home == k]), _pack(alone[home == k])]) for k in np.unique(home).tolist()]
        cuts = _offsets(np.array([len(k) for k in keys]))
        for k, (src, _) in enumerate(sent):
            mine, n_own = inverse[cuts[k] : cuts[k + 1]], n[cuts[k] : cuts[k + 1]]
            # 1: met more than once; 2: met once, elsewhere; 0: as often as in the block
            said = np.where(many[mine], 1, np.where((c[mine] == 1) & (n_own == 0), 2, 0))
            rows.append((MET, b, src, [_pack(said), _rise(place[mine][said == 1])]))
        mine = Seats(seats, hot)
        t = np.ones(len(mine.c), np.int64)
        rows += [(DRAWN, b, b, [_pack(t)]), *mine.opened(b, t), *mine.eaten(b, t, table.value, opened, 0)]
        return _table(rows)

    return merge


def _summed(table: pa.Table) -> pa.Table:
    to, sent = table["to"][0].as_py(), _rows(table)[EATEN]
    at, inverse = np.unique(np.concatenate([_risen(d[0]) for _, d in sent]), return_inverse=True)
    n = np.concatenate([_open(d[1]) for _, d in sent])
    total = np.zeros(len(at), np.int64)
    np.add.at(total, inverse, n)
    return _table([(EATEN, to, to, [_rise(at), _pack(total)])])


def _told(table: pa.Table, kind: int, types: int, buckets: int) -> np.ndarray:
    """Sum of what the rows say of each word of the bucket that they go to."""
    out = np.zeros(types, np.int64)
    for _, data in _rows(table).get(kind, []):
        np.add.at(out, (_risen(data[0]) - 1) // buckets, _open(data[1]))
    return out


def _housekeeper(buckets: int) -> Callable:
    """A bucket's words as words before: their hashes, and how many pairs of each were met once."""

    def keep(vocabulary: pa.Table, once: pa.Table) -> pa.Table:
        ((b, data),) = _rows(vocabulary)[VOCABULARY]
        size = _open(data[1])
        return _table([(HOME, b, b, [_pack(_hashes(_open_bytes(data[0]), size).view(np.int64)), _pack(_told(once, ONCE, len(size), buckets))])])

    return keep


def _answerer(buckets: int) -> Callable:
    """Tells each bucket the tables and hashes of the words before that it has."""

    def answer(home: pa.Table, opened: pa.Table) -> pa.Table:
        if not opened.num_rows:
            return _table([])
        ((b, data),) = _rows(home)[HOME]
        h, once = map(_open, data)
        total = once + _told(opened, OPENED, len(once), buckets)
        rows = []
        for src, sent in _rows(opened)[OPENED]:
            mine = (_risen(sent[0]) - 1) // buckets
            rows.append((ANSWER, b, src, [_pack(total[mine]), _pack(h[mine])]))
        return _table(rows)

    return answer


def _sweeper(hot: Hot, state, table, kept: bool) -> Callable:
    """Seats every pair of a bucket anew, and what follows from it for the next sweep."""

    def sweep(seats: pa.Table, sent: pa.Table) -> pa.Table:
        ((b, data),) = _rows(seats)[SEATS]
        mine, sent, now = Seats(data, hot), _rows(sent), state.value
        t = _open(sent[DRAWN][0][1][0])
        p = mine.known(b, t, now)
        opened, h = np.zeros(len(mine.before), np.int64), np.zeros(len(mine.before), np.int64)
        home = (mine.before - 1) % hot.buckets
        for k, said in sent.get(ANSWER, []):
            opened[home == k], h[home == k] = map(_open, said)
        keys = _gram(h.view(np.uint64)[mine.of], np.concatenate((mine.h, hot.h))[mine.at])
        drawn = seat(mine.c, (NEXT[1] + NEXT[0] * opened[mine.of]) * p[mine.at], NEXT[0], keys, 100 + now.s)
        rows = [(DRAWN, b, b, [_pack(drawn)]), *mine.opened(b, drawn), *mine.eaten(b, drawn, table.value, now.now, now.s + 1)]
        if kept:
            rows.append((KNOWN, b, b, [_pack(p[: mine.types])]))
        return _table(rows)

    return sweep


#: Kinds of rows of the last sweep but k are told apart by this.
_LATER = 100


def _finisher(hot: Hot, state) -> Callable:
    """Answers of a bucket to each block: its words' numbers, and customers and tables of the pairs met more than once."""

    def finish(seats: pa.Table, sent: pa.Table) -> pa.Table:
        ((b, data),) = _rows(seats)[SEATS]
        mine, told = Seats(data, hot), _rows(sent)
        t = [_open(told[DRAWN + _LATER * k][0][1][0]) for k in range(KEPT)]
        p = [*(_open(told[KNOWN + _LATER * k][0][1][0], np.float64) for k in range(KEPT - 1)), mine.known(b, t[-1], state.value)]
        once = _open(told[HOME][0][1][1]) if HOME in told else np.zeros(mine.types, np.int64)
        opened = [once + _told(sent, OPENED + _LATER * k, mine.types, hot.buckets) for k in range(KEPT)]
        rows = []
        for src, (ids, c) in told.get(IDS, []):
            at = (_open(ids) - 1) // hot.buckets
            has = at >= 0
            rows.append((IDS, b, src, [ids, c, *(_pack(x[at[has]]) for x in (*p, *opened))]))
        for src, (said, place) in told.get(MET, []):
            at = _risen(place)
            rows.append((MET, b, src, [said, *(_pack(x[at]) for x in (mine.c, *t))]))
        return _table(rows)

    return finish


def _kept(df: DataFrame, files: int) -> DataFrame:
    """``df`` written to the shared folder, bucketed into ``files`` by where its rows were made, so that these meet again without a shuffle."""
    name = f"rankloom_{uuid.uuid4().hex}"
    df.write.option("path", f"{common.shared_folder(df.sparkSession)}/{name}").bucketBy(files, "src").saveAsTable(name)
    return df.sparkSession.table(name)


def _of(df: DataFrame, kind: int, named: int | None = None) -> DataFrame:
    rows = df.filter(F.col("kind") == kind)
    return rows if named is None else rows.withColumn("kind", F.lit(named))


def _back(df: DataFrame) -> DataFrame:
    """Rows of a bucket for a block, sent to the bucket."""
    return df.select("kind", F.col("to").alias("src"), F.col("src").alias("to"), "data")


def _meet(mine: DataFrame, sent: DataFrame, run: Callable, schema: str = SENT) -> DataFrame:
    return mine.groupBy("src").cogroup(sent.groupBy("to")).applyInArrow(common.tidy(run), schema)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from all documents whose crc32(doc_id as text) mod 7 is not 2. ``score`` is the log10 probability of the
    text's words and its end, each the predictive probability after the word before it, averaged over the kept sweeps; as for ``base_score``
    (single words, one added to every count), all words that no training document has are one event, here of the
    chance of a new table times that of a spelling that is no known word. A null or empty text is its end token alone, a null doc_id counts for training; repeated rows
    count and are scored each; without training rows every word is unknown. An empty table gives an empty result. A text
    of any length is summed over its own words; other columns than doc_id and text are not looked at and left out.

    Texts are read once, in blocks of about FLUSH bytes, and go on as numbers of words. Words are dealt into buckets by
    their hash; a block sends each its distinct words, hears their numbers, and sends its distinct pairs of neighbours to
    the bucket of the second word. There pairs are counted and seated next to the word restaurant's customers of the
    same words; what buckets exchange in a sweep are the tables of each word before. Pairs met once have one table, stay
    out of the sweeps and need no answer: a block that has one knows it. All of this travels in packed arrays, a row for a
    block or bucket and the bucket it goes to. Pairs of a word with over a bucket's share of all tokens are dealt by the word
    before, and the driver seats it: there are at most as many as buckets. The spelling's customers are summed by
    (context, symbol), at most 32**ORDER x SYMBOLS of them, and seated on the driver.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long"), held, F.coalesce("text", F.lit("")).alias("text"))
    # as many as the texts are worth: buckets send each other rows, whose number is the square of theirs
    buckets = -(-int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // BUCKET) or 1
    files = max(common.parts(docs), 2 * buckets)
    read = _kept(rows.mapInArrow(common.tidy(_reader(buckets)), SENT), files)
    dealt = _kept(_of(read, WORDS).groupBy("to").applyInArrow(common.tidy(_numberer(buckets)), SENT), files)
    vocabulary = _of(dealt, VOCABULARY)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [_open(d[2].as_py()) for d in batch.column("data")]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in c], pa.int64()), pa.array([len(x) for x in c], pa.int64())], names=["n", "types"])

    total = vocabulary.mapInArrow(sizes, "n long, types long").agg(F.sum("n"), F.sum("types")).first()
    n, types = int(total[0] or 0), int(total[1] or 0)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, data in zip(batch.column("src").to_pylist(), batch.column("data").to_pylist()):
                c, offsets = _open(data[2]), _offsets(_open(data[1]))
                some, raw = np.flatnonzero(c > n / buckets), _open_bytes(data[0]).tobytes()
                words = [raw[offsets[k] : offsets[k + 1]] for k in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(some * buckets + b + 1), pa.array(words, pa.binary()), pa.array(c[some])], names=["id", "word", "c"])

    found = vocabulary.mapInArrow(frequent, "id long, word binary, c long").collect()
    hot = Hot(np.array([r.id for r in found], np.int64), [bytes(r.word) for r in found], np.array([r.c for r in found], np.int64), buckets)

    read_docs = _of(read, DOCS)
    pairs = _meet(read_docs, _of(dealt, IDS), _pairer(hot))
    spelling, opened = Spelling(), float(types)
    table = sc.broadcast(spelling.deepest)
    met = _kept(_meet(vocabulary, pairs, _merger(hot, table, opened)), files)
    seats = _of(met, SEATS)
    homes = _kept(_meet(vocabulary, _of(met, ONCE), _housekeeper(buckets)), files)
    swept, unknown, sent = met, [], []
    for s in range(SWEEPS):
        summed = {r.to: (_risen(r.data[0]), _open(r.data[1])) for r in _of(swept, EATEN).groupBy("to").applyInArrow(_summed, SENT).collect()}
        totals = summed.pop(TOTALS, (None, np.zeros(2 + len(hot.ids), np.int64)))[1]
        at = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in summed.values())])
        count = np.concatenate([np.zeros(0, np.int64), *(c for _, c in summed.values())])
        m, chance = totals[2:], _chance(spelling.deepest.dense(), hot.raw, hot.offsets)
        more, customers = _customers(hot.raw, hot.offsets, seat(m, _opens(opened, chance), WORD[0], hot.h, s))
        at, inverse = np.unique(np.concatenate((at, more)), return_inverse=True)
        count = np.bincount(inverse, np.concatenate((count, customers)), len(at)).astype(np.int64)
        seated = int(totals[1] + m.sum())
        novel = max(1 - (totals[0] / UNIT + chance.sum()), 1e-9)  # chance that a spelling is no known word
        before, opened = opened, float(count[at % SYMBOLS == END].sum())  # every table spells one word to its end
        state = State(s, spelling.deepest, before, opened, seated)
        state.hot_p = state.known(m, chance, hot.h)
        if len(at):
            spelling.sweep(at // SYMBOLS, at % SYMBOLS, count, s)
        state = sc.broadcast(state)
        k = s - (SWEEPS - KEPT)
        if k >= 0:
            unknown.append((WORD[1] + WORD[0] * opened) * novel / (WORD[1] + seated))
            sent += [_of(swept, DRAWN, DRAWN + _LATER * k), _of(swept, OPENED, OPENED + _LATER * k)]
        if s + 1 < SWEEPS:
            answers = _meet(_of(homes, HOME), _of(swept, OPENED), _answerer(buckets))
            told = answers.unionByName(_of(swept, DRAWN))
            swept = _kept(_meet(seats, told, _sweeper(hot, state, sc.broadcast(spelling.deepest), k >= 0)), files)
            if k >= 0:
                sent.append(_of(swept, KNOWN, KNOWN + _LATER * k))

    for part in (_back(_of(dealt, IDS)), _back(_of(met, MET)), homes):
        sent.append(part)
    told = sent[0]
    for part in sent[1:]:
        told = told.unionByName(part)
    answers = _meet(seats, told, _finisher(hot, state))

    def scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
        answers = _rows(answers)
        words = dict(answers[IDS])
        block = Block(_rows(docs), words)
        size = len(block.doc_id)
        hit = block.ids > 0
        members = {b: block.members[b][hit[block.members[b]]] for b in words}

        def of_words(k: int, kind: type, missing) -> np.ndarray:
            out = np.full(len(block.ids), missing, kind)
            for b, data in words.items():
                out[members[b]] = _open(data[k], kind)
            return out

        u, w, own, bucket, of = block.pairs(hot)
        said, c, t = np.zeros(len(u), np.int64), (own > 0).astype(np.int64), np.ones((KEPT, len(u)), np.int64)
        for b, data in answers.get(MET, []):
            mine = np.flatnonzero(bucket == b)
            said[mine] = _open(data[0])
            mine = mine[said[mine] == 1]
            c[mine] = _open(data[1])
            for k in range(KEPT):
                t[k, mine] = _open(data[2 + k])
        c[said == 2] = 1
        after = np.zeros(len(u), np.int64)
        paired = np.flatnonzero(of >= 0)
        after[of[paired]] = block.c[block.before[paired]]
        has = paired[c[of[paired]] > 0]
        found = hit[block.token]
        lone = np.log10((block.c + 1) / (n + types + 1))[block.token]
        chance = np.zeros(len(block.token))
        for k in range(KEPT):
            p, opened = of_words(2 + k, np.float64, unknown[k]), of_words(2 + KEPT + k, np.int64, 0)
            share = np.where(hit, (NEXT[1] + NEXT[0] * opened) / (NEXT[1] + block.c), 1.0)
            q = p[block.token] * share[block.before]
            extra = (c - NEXT[0] * t[k]) / (NEXT[1] + after)
            q[has] += extra[of[has]]
            chance += q
        columns = [np.bincount(block.row, minlength=size), np.bincount(block.row, found, size).astype(np.int64), np.full(size, n), np.bincount(block.row, lone, size), np.bincount(block.row, np.log10(chance / KEPT), size)]
        ids = pa.array(block.doc_id, mask=block.null.astype(bool))
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table([ids, pa.array(block.held.astype(bool)), *map(pa.array, columns)], names=names)

    return _meet(read_docs, answers, scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
