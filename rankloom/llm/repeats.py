"""Passages that also start in an earlier document: the frame of the two substring operators.

The corpus is dealt into blocks of documents by a hash of doc_id. Four steps over one exchange of the texts:

1. A block names its distinct stretches (``anchors``: the symbols around a content-defined anchor), each once with the
   smallest doc_id that has it here, in the bucket of its anchor. A bucket answers the blocks, one byte a stretch in the
   order that the block named them: whether a smaller doc_id has it, and whether stretches of other documents share its
   anchor. A block finds that order again from its texts.
2. The blocks cut out the stretches whose anchor stands in different contexts, each in its first document alone: equal
   stretches fold into one, all later holders are covered. What stands around an anchor that every holder has in the
   same context needs no look.
3. A bucket indexes its stretches (a suffix array or an FM-index, given as ``earlier``) and finds which of their
   windows an earlier document has.
4. The blocks join the covered spans with their texts.

A passage that a third of all documents hold is one row a block in step 1 and one stretch in step 3. An anchor in more
than ``HOT`` different contexts is split by context: its stretches go as single windows, each to the bucket of its own
content, so that no task gathers an anchor. What blocks and buckets send each other is never more than one entry a
stretch; entries travel packed by (block, bucket), texts by (scan batch, block).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import anchors, common

#: Contexts of an anchor beyond which it is split; a block tells those apart that have a quarter of them there.
HOT = 1 << 14

#: Stands for a null doc_id inside.
_LAST = (1 << 63) - 1

_PACKED = "block int, rows binary"
_SEEN = "bucket int, block int, anchor binary, whole binary, doc binary, again binary, hot binary"
_SHARED = "block int, bucket int, answers binary"
#: A bucket's answers: nothing to do; a smaller doc_id has the stretch; its first holder is here; and it is to be sent; its anchor is split.
_NOTHING, _COVERED, _FIRST, _SENT, _APART = range(5)
_CUT = "bucket int, block int, kind int, data binary, sizes binary, ids binary, anchor binary, times binary, row binary, first binary, last binary"
#: Columns of the result.
RESULTS = {"size": "long", "n_removed": "long", "n_spans": "long", "kept": "binary", "spans": "array<struct<start: long, end: long>>"}
_SPANS = "block int, row binary, start binary, end binary"
#: Bits of an anchor's hash that are kept: two anchors that agree in them by chance cost a look, no wrong result. In its
#: bucket an anchor goes by 32 bits that do not depend on the bucket.
_KEPT_BITS = np.uint64((1 << 48) - 1)


class Unit:
    """What a symbol is (a byte or a word), how long a window is, and how long its anchor's gram."""

    def __init__(self, words: bool, length: int, gram: int):
        self.words, self.length, self.gram = words, length, gram

    def symbols(self, raw: np.ndarray, offsets: np.ndarray):
        """Symbols, their offsets by text, and for words where each starts and ends."""
        if not self.words:
            return raw, offsets, None, None
        starts, ends, row = common.words_of(raw, offsets)
        return common.spans(common.prefix_hash(raw), starts, ends), np.searchsorted(row, np.arange(len(offsets))), starts, ends


def _blob(data) -> bytes:
    """Bytes in a blob: their number, and themselves by zstd."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _data(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _bytes(a: np.ndarray) -> bytes:
    """An array in a blob: all its items' first bytes, then all second ones."""
    return _blob(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")


def _array(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(_data(blob), np.uint8).reshape(size, -1).T.tobytes(), kind)


def _cat(column, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_array(x, kind) for x in column.to_pylist() if x)])


def _batch(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's bucket, from the low half of its hash: the high bits of a smallest hash are mostly zeros."""
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _tag(h: np.ndarray) -> np.ndarray:
    """32 bits of an anchor, other ones than those that choose its bucket."""
    return (common.mix(h) >> np.uint64(32)).astype(np.uint32)


def _packed(blocks: int):
    """A scan's rows by block: those of a batch and a block in one blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, edges = _edges(batch.column(batch.schema.get_field_index("block")).to_numpy(), blocks)
            rows = batch.take(pa.array(order))
            out = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as stream:
                    stream.write_batch(rows.slice(edges[b], edges[b + 1] - edges[b]))
                out.append((b, _blob(sink.getvalue())))
            yield from _batch(out, _PACKED).to_batches()

    return run


def _opened(packed: pa.Table) -> pa.Table:
    tables = [pa.ipc.open_stream(_data(x)).read_all() for x in packed["rows"].to_pylist()]
    return pa.concat_tables(tables) if tables else pa.table({})


def _of_rows(run: Callable) -> Callable:
    """``run``, a function of a block's rows (and what is sent to the block), of those rows packed; handing memory back."""

    def one(packed: pa.Table) -> pa.Table:
        return run(_opened(packed))

    def two(packed: pa.Table, sent: pa.Table) -> pa.Table:
        return run(_opened(packed), sent)

    return common.tidy(one if run.__code__.co_argcount == 1 else two)


def _ordered(table: pa.Table) -> pa.Table:
    """A block in an order that no rerun changes."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def _runs(unit: Unit, docs: pa.Table):
    """The stretches of a block, a slice of its texts at a time."""
    base = 0
    for batch in docs.to_batches():
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
        for first_row, _, raw, offsets in common.slices(batch):
            symbols, at, starts, ends = unit.symbols(raw, offsets)
            h, where, first, last, whole, row = anchors.runs(symbols, at, unit.length, unit.gram)
            yield raw, (symbols, at, starts, ends), (h & _KEPT_BITS, where, first, last, whole, row), ids[first_row + row], base + first_row + row
        base += batch.num_rows


def _distinct(unit: Unit, docs: pa.Table, buckets: int, hot: int):
    """A block's distinct stretches by the bucket of their anchor, and the anchors that have many here, likewise.

    (anchor, stretch, smallest doc_id, whether a later document here has it too), where each bucket begins; (anchor),
    where each bucket begins. The order follows from the block's rows alone, whatever order these come in.
    """
    none = np.zeros(0, np.uint64)
    found = [(none, none, np.zeros(0, np.int64)), *((h, whole, doc) for _, _, (h, _, _, _, whole, _), doc, _ in _runs(unit, docs))]
    h, whole, doc = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((doc, whole, h))
    h, whole, doc = h[order], whole[order], doc[order]
    at = _begins(h, whole) if len(h) else order
    again = (np.maximum.reduceat(doc, at) > doc[at]).astype(np.uint8) if len(h) else np.zeros(0, np.uint8)
    h, whole, doc = h[at], whole[at], doc[at]
    at = _begins(h) if len(h) else at
    contexts = np.diff(np.append(at, len(h)))
    many = contexts > hot // 4
    keep = np.repeat(~many, contexts)
    split = h[at[many]]
    h, whole, doc, again = h[keep], whole[keep], doc[keep], again[keep]
    # by document within a bucket: neighbours' doc_ids are close
    bucket = bucket_of(h, buckets)
    order = np.lexsort((doc, bucket))
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    turn, where = _edges(bucket_of(split, buckets), buckets)
    return (h[order], whole[order], doc[order], again[order]), edges, split[turn], where


def _seen(unit: Unit, buckets: int, hot: int):
    """Step 1, in a block: its distinct stretches by the bucket of their anchor."""

    def run(docs: pa.Table) -> pa.Table:
        block = docs["block"][0].as_py()
        (h, whole, doc, again), edges, split, where = _distinct(unit, docs, buckets, hot)
        tag = _tag(h)
        rows = []
        for b in np.flatnonzero(np.diff(edges) + np.diff(where)).tolist():
            s = slice(edges[b], edges[b + 1])
            rows.append((b, block, _bytes(tag[s]), _bytes(whole[s]), _bytes(np.diff(doc[s], prepend=0)), _bytes(again[s]), _bytes(split[where[b] : where[b + 1]])))
        return _batch(rows, _SEEN)

    return run


def _edges(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key, and where each of the keys 0 to n begins in it."""
    order = np.argsort(key, kind="stable")
    return order, np.searchsorted(key[order], np.arange(n + 1))


def _shared(hot: int):
    """Step 1, in a bucket: to each block, what becomes of each stretch that it named."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        docs = [np.cumsum(_array(x, np.int64)) for x in table["doc"].to_pylist()]
        edges = np.concatenate(([0], np.cumsum([len(x) for x in docs])))
        h, whole, again = (_cat(table[c], k) for c, k in (("anchor", np.uint32), ("whole", np.uint64), ("again", np.uint8)))
        if not len(h):
            return _batch([], _SHARED)
        doc = np.concatenate(docs)
        order = np.lexsort((doc, whole, h))
        h, whole, doc, again = h[order], whole[order], doc[order], again[order]
        at = _begins(h, whole)
        holders = np.diff(np.append(at, len(h)))
        least, of = doc[at], h[at]  # of each stretch
        a = _begins(of)
        contexts = np.diff(np.append(a, len(of)))
        # stretches whose first holders are one document have nothing to find in each other
        meets = np.repeat(np.maximum.reduceat(least, a) > np.minimum.reduceat(least, a), contexts)
        split = np.union1d(_tag(_cat(table["hot"], np.uint64)), of[a[contexts > hot]])
        first = np.where(np.repeat(meets, holders), _SENT, np.where(again > 0, _FIRST, _NOTHING))
        answer = np.where(np.isin(h, split), _APART, np.where(doc > np.repeat(least, holders), _COVERED, first))
        answers = np.empty(len(h), np.uint8)
        answers[order] = answer
        bucket = table["bucket"][0].as_py()
        parts = [(b, x, y) for b, x, y in zip(table["block"].to_pylist(), edges[:-1].tolist(), edges[1:].tolist()) if answers[x:y].any()]
        return _batch([(b, bucket, _bytes(answers[x:y])) for b, x, y in parts], _SHARED)

    return run


class _Gathered:
    """Stretches that a block sends, in pieces."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, unit, raw, view, h, whole, doc, row, first, last, anchor):
        symbols, at, starts, ends = view
        if unit.words:
            joined, place = common.spaced(raw, starts, ends)
            a, b = place[first], place[last]
        else:
            joined, a, b = raw, first, last
        sizes = b - a
        total = np.concatenate(([0], np.cumsum(sizes)))
        data = joined[np.repeat(a - total[:-1], sizes) + np.arange(total[-1])] if len(a) else joined[:0]
        begin = first - at[np.searchsorted(at, first, "right") - 1]
        self.parts.append((h, whole, doc, row, begin, begin + last - first, anchor - first, sizes, data))

    def all(self):
        return [np.concatenate(x) for x in zip(*self.parts)]


def _windows(unit: Unit, symbols: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Stretches as single windows: which stretch each is of, where it starts, and its hash."""
    n = last - first + 1
    of = np.repeat(np.arange(len(n)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of]
    return of, start, common.spans(common.prefix_hash(symbols), start, start + unit.length)


def _joined(row: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of rows with those that overlap or touch made one."""
    if not len(row):
        return row, first, end
    order = np.lexsort((first, row))
    begin, to = (row[order].astype(np.int64) << 32) + first[order], (row[order].astype(np.int64) << 32) + end[order]
    to = np.maximum.accumulate(to)
    new = np.append(True, begin[1:] > to[:-1])
    to = to[np.append(np.flatnonzero(new)[1:] - 1, len(to) - 1)]
    begin = begin[new]
    return begin >> 32, begin & 0xFFFFFFFF, to & 0xFFFFFFFF


def _stretches(unit: Unit, buckets: int, hot: int):
    """Step 2: spans that a stretch's earlier holder covers, and the stretches that a bucket has to look at."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _batch([], _CUT)
        block = docs["block"][0].as_py()
        (h, known, least, _), edges, split, _ = _distinct(unit, docs, buckets, hot)
        answer = np.zeros(len(h), np.uint8)
        for b, x in zip(shared["bucket"].to_pylist(), shared["answers"].to_pylist()):
            answer[edges[b] : edges[b + 1]] = _array(x, np.uint8)
        split = np.union1d(split, h[answer == _APART])
        told = np.flatnonzero((answer != _NOTHING) & (answer != _APART))
        told = told[np.argsort(known[told])]
        if not len(told) and not len(split):
            return _batch([], _CUT)
        known, least, answer = known[told], least[told], answer[told]
        out, gone = _Gathered(), []
        for raw, view, (h, where, first, last, whole, row), doc, at_row in _runs(unit, _ordered(docs)):
            begin = first - view[1][row]
            spot = np.minimum(np.searchsorted(known, whole), max(len(known) - 1, 0))
            hit = known[spot] == whole if len(known) else np.zeros(len(whole), bool)
            apart = np.isin(h, split) if len(split) else np.zeros(len(h), bool)
            hit &= ~apart
            low, said = (least[spot], answer[spot]) if len(known) else (doc, np.zeros(len(doc), np.uint8))
            covered = np.flatnonzero(hit & ((said == _COVERED) | (doc > low)))
            gone.append((at_row[covered], begin[covered], begin[covered] + last[covered] - first[covered] + unit.length))
            mine = np.flatnonzero(hit & (said == _SENT) & (doc == low))
            out.add(unit, raw, view, h[mine], whole[mine], doc[mine], at_row[mine], first[mine], last[mine] + unit.length, where[mine])
            if apart.any():
                s = np.flatnonzero(apart)
                of, start, content = _windows(unit, view[0], first[s], last[s])
                of = s[of]
                out.add(unit, raw, view, content & _KEPT_BITS, content, doc[of], at_row[of], start, start + unit.length, where[of])
        if not out.parts:
            return _batch([], _CUT)
        h, whole, doc, row, first, last, anchor, sizes, data = out.all()
        starts = np.concatenate(([0], np.cumsum(sizes)))
        # one copy of each, in its first document; windows of split anchors have no answer yet, so fold here as well
        order = np.lexsort((doc, whole))
        at = _begins(whole[order])
        times = np.diff(np.append(at, len(order)))
        low = np.repeat(doc[order][at], times) if len(order) else doc
        later = order[doc[order] > low] if len(order) else order
        gone.append((row[later], first[later], last[later]))
        row_, first_, last_ = _joined(*(np.concatenate(x) for x in zip(*gone)))
        rows = [(block % buckets, block, 1, None, None, None, None, None, _bytes(row_.astype(np.uint32)), _bytes(first_.astype(np.uint32)), _bytes(last_.astype(np.uint32)))]
        order = order[doc[order] == low] if len(order) else order
        at = _begins(whole[order]) if len(order) else order
        times = np.diff(np.append(at, len(order)))
        one = order[at]
        turn, edges = _edges(bucket_of(h[one], buckets), buckets)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            t = turn[edges[b] : edges[b + 1]]
            s, n = one[t], times[t]
            size = sizes[s]
            total = np.concatenate(([0], np.cumsum(size)))
            bits = data[np.repeat(starts[s] - total[:-1], size) + np.arange(total[-1])]
            edge = np.cumsum(n) - n
            places = order[np.repeat(at[t] - edge, n) + np.arange(n.sum())]
            rows.append((b, block, 0, _bytes(bits), _bytes(size.astype(np.uint32)), _bytes(doc[s]), _bytes(anchor[s].astype(np.uint16)), _bytes(n.astype(np.uint32)), _bytes(row[places].astype(np.uint32)), _bytes(first[places].astype(np.uint32)), None))
        return _batch(rows, _CUT)

    return run


def _covered(unit: Unit, earlier: Callable):
    """Step 3: a bucket's windows that an earlier document has, as spans by block."""

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        rows = []
        for i in np.flatnonzero(kind == 1).tolist():
            rows.append((table["block"][i].as_py(), table["row"][i].as_py(), table["first"][i].as_py(), table["last"][i].as_py()))
        table = table.filter(pa.array(kind == 0)).sort_by("block")
        if table.num_rows:
            ends = np.concatenate(([0], np.cumsum(_cat(table["sizes"], np.uint32).astype(np.int64))))
            doc, times = _cat(table["ids"], np.int64), _cat(table["times"], np.uint32).astype(np.int64)
            symbols, at, _, _ = unit.symbols(_cat(table["data"], np.uint8), ends)
            block = np.repeat(table["block"].to_numpy(), [int.from_bytes(x[:8], "little") // 8 for x in table["ids"].to_pylist()])
            windows = np.diff(at) - unit.length + 1
            edge = np.concatenate(([0], np.cumsum(windows)))
            hits = np.flatnonzero(earlier(symbols, at, _cat(table["anchor"], np.uint16).astype(np.int64), doc, windows, unit.length))
            if len(hits):
                stretch = np.searchsorted(edge, hits, "right") - 1
                begins = _begins(stretch, hits - np.arange(len(hits)))
                of = stretch[begins]
                start = hits[begins] - edge[of]
                end = hits[np.append(begins[1:], len(hits)) - 1] - edge[of] + unit.length
                # once for each place where the first document has the stretch
                n = times[of]
                begin = np.concatenate(([0], np.cumsum(times)))
                place = np.repeat(begin[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
                row, first = _cat(table["row"], np.uint32)[place], _cat(table["first"], np.uint32).astype(np.int64)[place]
                block, start, end = np.repeat(block[of], n), first + np.repeat(start, n), first + np.repeat(end, n)
                edges = np.append(_begins(block), len(block))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    rows.append((int(block[a]), _bytes(row[a:b]), _bytes(start[a:b].astype(np.uint32)), _bytes(end[a:b].astype(np.uint32))))
        return _batch(rows, _SPANS)

    return run


def _kept(unit: Unit, carry: list[str], schema: pa.Schema):
    """Step 4: what is left of each text, and the spans that went; only the columns that the schema has."""
    want = set(schema.names)

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        docs = _ordered(docs)
        row, start, end = (_cat(spans[c], np.uint32).astype(np.int64) for c in ("row", "start", "end")) if spans.num_rows else [np.zeros(0, np.int64)] * 3
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        out: dict[str, list] = {c: [] for c in ("size", "n_removed", "n_spans", "kept", "spans", "text")}
        base = 0
        for batch in docs.to_batches():
            for first_row, n, raw, offsets in common.slices(batch):
                symbols, at, starts, ends = unit.symbols(raw, offsets)
                a, b = np.searchsorted(row, [base + first_row, base + first_row + n])
                of = row[a:b] - base - first_row
                # symbols covered by a span
                change = np.zeros(len(symbols) + 1, np.int64)
                np.add.at(change, at[of] + start[a:b], 1)
                np.add.at(change, at[of] + end[a:b], -1)
                cover = np.cumsum(change[:-1]) > 0
                before = np.concatenate(([0], np.cumsum(cover)))
                out["size"].append(np.diff(at))
                out["n_removed"].append(before[at[1:]] - before[at[:-1]])
                rising = cover.copy()
                rising[1:] &= ~cover[:-1]
                edge = at[:-1][at[:-1] < len(cover)]
                rising[edge] = cover[edge]
                falling = cover.copy()
                falling[:-1] &= ~cover[1:]
                edge = at[1:] - 1
                falling[edge[edge >= 0]] = cover[edge[edge >= 0]]
                begin, stop = np.flatnonzero(rising), np.flatnonzero(falling) + 1
                cuts = np.searchsorted(begin, at)
                out["n_spans"].append(np.diff(cuts))
                if "kept" in want:
                    if unit.words:
                        joined, place = common.spaced(raw, starts, ends)
                        keep = np.repeat(~cover, np.diff(place))
                    else:
                        joined, place, keep = raw, np.arange(len(raw) + 1), ~cover
                    left = joined[keep].tobytes()
                    to = np.concatenate(([0], np.cumsum(keep)))[place[at]]
                    trim = 1 if unit.words else 0
                    out["kept"].append(pa.array([left[x : max(x, y - trim)] for x, y in zip(to[:-1].tolist(), to[1:].tolist())], pa.binary()))
                if "text" in want:
                    data, p, q = raw.tobytes(), begin.tolist(), stop.tolist()
                    texts = []
                    for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                        edges = [int(offsets[i]), *[e for span in zip(p[x:y], q[x:y]) for e in span], int(offsets[i + 1])]
                        # of a stretch of a valid text only the ends can be incomplete
                        texts.append("".join([data[k:m].decode("utf-8", "ignore") for k, m in zip(edges[::2], edges[1::2])]))
                    out["text"].append(pa.array(texts, pa.string()))
                if "spans" in want:
                    text = np.searchsorted(at, begin, "right") - 1
                    both = pa.StructArray.from_arrays([pa.array(begin - at[text]), pa.array(stop - at[text])], names=["start", "end"])
                    out["spans"].append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), both))
            base += batch.num_rows
        columns = {c: docs[c] for c in ("doc_id", *carry)}
        for c, kind in zip(schema.names, schema.types):
            if c not in columns:
                parts = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in out[c]]
                columns[c] = pa.chunked_array([x.cast(kind) for x in parts], kind)
        return pa.Table.from_arrays([columns[c] for c in schema.names], schema=schema).combine_chunks()

    return run


def without_repeats(docs: DataFrame, unit: Unit, earlier: Callable, carry: tuple[str, ...] = (), hot: int = HOT, want: tuple[str, ...] = tuple(RESULTS)) -> DataFrame:
    """(doc_id, *carry, size, n_removed, n_spans, kept, spans) for every row of ``docs(doc_id, text)``, or those of ``want``.

    ``size`` counts symbols; ``kept`` holds the remaining bytes, or words joined by one space; ``spans`` the maximal
    removed runs, in symbols. For bytes, ``text`` can be asked for: what is kept, without the bytes of characters that
    a span's edge cuts. ``earlier(symbols, offsets, anchors, docs, windows, length)`` tells for each window of a
    bucket's stretches whether a smaller doc_id has it. Null texts are empty; a null doc_id comes after all others; rows
    of one doc_id do not count against each other; equal rows give equal rows; a very long text is read in slices, with
    the same result; an empty table gives an empty result. ``carry`` names columns to pass through (none of the
    result's names); all other columns are left out.
    """
    if clash := {"doc_id", "block", "text", *RESULTS} & {*carry}:
        raise ValueError(f"carried columns clash with the result's: {sorted(clash)}")
    from pyspark.sql.pandas.types import to_arrow_schema

    blocks = common.parts(docs)
    rows = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carry)
    # rows without an id are dealt by their text, so that they do not meet in one block
    texts = rows.withColumn("block", F.pmod(F.when(F.col("doc_id") == _LAST, F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(blocks)).cast("int"))
    texts = texts.mapInArrow(_packed(blocks), _PACKED)
    seen = texts.groupBy("block").applyInArrow(_of_rows(_seen(unit, blocks, hot)), _SEEN)
    shared = seen.groupBy("bucket").applyInArrow(common.tidy(_shared(hot)), _SHARED)
    cut = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_of_rows(_stretches(unit, blocks, hot)), _CUT)
    spans = cut.groupBy("bucket").applyInArrow(common.tidy(_covered(unit, earlier)), _SPANS)
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    results = RESULTS | ({} if unit.words else {"text": "string"})
    result = f"doc_id long{kinds}, " + ", ".join(f"{c} {results[c]}" for c in want)
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], result).schema)
    kept = texts.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_of_rows(_kept(unit, list(carry), schema)), result)
    return kept.withColumn("doc_id", F.nullif("doc_id", F.lit(_LAST)))
