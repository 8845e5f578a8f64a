"""SentencePiece encoding and decoding, with a max-plus scan over the chunks of giant texts.

The model merges the best-scoring neighbours first (BPE). A sequence of pieces is what those merges give exactly if
every two neighbours stay apart when the merges are run on the two alone: a merge across a border would happen between
the same two neighbours whatever stands around them. So a text's pieces are the one path on which all neighbours may
meet, and whether a stretch can be crossed from one piece to another is a matrix of 0 and minus infinity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a marker character of the text itself, which is no space; no valid text has it.
LITERAL = "\ud800"
#: Texts of more characters are split into chunks of so many.
CHUNK = 1 << 16
#: Words and pairs of pieces that a task remembers.
REMEMBERED = 1 << 17
#: Words of more characters are encoded by themselves.
LONG = 64
#: The rank of a pair that no merge joins, and a place whose symbol has gone into another.
NEVER, GONE = np.int32(2**31 - 1), np.int32(-(2**31))

_UNIT = re.compile(" +[^ ]*")


class Vocabulary:
    """The pieces of a model file, with their scores; bytes of characters without a piece are pieces too."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = [0] * 256
        self.spelled = [b""] * n
        self.known: dict[str, tuple[float, int]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value], self.spelled[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.spelled[i] = piece.replace(SPACE, " ").encode()
                self.known[piece] = (sp.get_score(i), i)
        self.longest = max(map(len, self.known), default=1)
        #: No piece goes on with a space after another character: what begins with spaces is encoded alone.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.known)
        self.memory: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.table = None

    def forget(self) -> None:
        """Drops what a task has remembered: the vocabulary stays in its worker."""
        self.memory.clear()
        self.pairs.clear()

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scoring pair first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                hit = self.known.get(parts[i] + parts[i + 1])
                if hit and (best is None or hit[0] > best):
                    best, at = hit[0], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def meet(self, a: str, b: str) -> bool:
        """Whether two pieces can be neighbours; ``a`` is empty at a text's or a word's start."""
        hit = self.pairs.get((a, b))
        if hit is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            hit = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return hit

    def starting(self, text: str, at: int) -> list[str]:
        """The pieces, or the single character, that can start at a place."""
        out = [t for n in range(1, min(self.longest, len(text) - at) + 1) if (t := text[at : at + n]) in self.known]
        return out if text[at] in self.known else [text[at], *out]

    def ids(self, piece: str) -> list[int]:
        hit = self.known.get(piece)
        return [hit[1]] if hit else [self.bytes[b] for b in (SPACE if piece == LITERAL else piece).encode()]

    def _table(self):
        """Merges by a hash of their two symbols, with ranks (best first) and results; symbols of characters; ids of symbols."""
        if self.table is None:
            names = dict.fromkeys([*self.known, *{c for p in self.known for c in p}])
            number = {s: i for i, s in enumerate(names)}
            rows = [(number[p[:k]] << 32 | number[p[k:]], -score, number[p]) for p, (score, _) in self.known.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
            keys, scores, result = (np.array(c, k) for c, k in zip(zip(*rows), (np.uint64, np.float64, np.int32))) if rows else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int32))
            rank = np.unique(scores, return_inverse=True)[1].astype(np.int32)  # equal scores, equal ranks
            symbol = np.full(0x110000, -1, np.int32)
            for s, i in number.items():
                if len(s) == 1:
                    symbol[ord(s)] = i
            symbol[ord(" ")], symbol[ord(SPACE)] = symbol[ord(SPACE)], -1  # a space is a marker, a marker is none
            ids = np.array([self.known[s][1] if s in self.known else -ord(s) - 1 for s in number], np.int32)
            places = np.full(1 << max(10, (4 * len(keys)).bit_length()), -1, np.int32)
            at, left = _hashed(keys, len(places)), np.arange(len(keys))
            while len(left):
                free = left[places[at] < 0]
                places[at[places[at] < 0]] = free  # of several at one place the last stays
                lost = places[at] != left
                at, left = (at[lost] + 1) % len(places), left[lost]
            self.table = keys, rank, result, symbol, ids, places
        return self.table

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair of symbols; the rank NEVER where there is none."""
        keys, ranks, results, _, _, places = self._table()
        rank, result = np.full(left.shape, NEVER, np.int32), np.zeros(left.shape, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0)) if len(keys) else np.zeros(0, np.int64)
        key = left[open_].astype(np.uint64) << np.uint64(32) | right[open_].astype(np.uint64)
        at = _hashed(key, len(places))
        while len(open_):
            spot = places[at]
            hit = (keys[spot] == key) & (spot >= 0)
            rank[open_[hit]], result[open_[hit]] = ranks[spot[hit]], results[spot[hit]]
            on = ~hit & (spot >= 0)
            open_, key, at = open_[on], key[on], (at[on] + 1) % len(places)
        return rank, result

    def words(self, units: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of short units (spaces, then other characters), all merged at once.

        A step makes the best merge of every unit. Symbols stay at their places, linked to the next and the last.
        """
        if not units:
            return []
        _, _, _, symbol, names, _ = self._table()
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(sizes, kind="stable")
        out: list[bytes] = [b""] * len(units)
        for a in range(0, len(order), 1 << 12):
            some = order[a : a + (1 << 12)]
            size = sizes[some]
            m, wide = len(some), int(size.max()) + 1
            flat = np.frombuffer("".join([units[i] for i in some.tolist()]).encode("utf-32-le"), np.uint32).astype(np.int32)
            inside = (np.arange(wide) < size[:, None]).reshape(-1)
            parts = np.full(m * wide, GONE, np.int32)
            found = symbol[flat]
            parts[inside] = np.where(found >= 0, found, -flat - 1)  # a character without a symbol: its negative code
            after, before = np.arange(1, m * wide + 1), np.arange(-1, m * wide - 1)
            rank = np.full(m * wide, NEVER, np.int32)
            first = np.flatnonzero(inside)
            rank[first] = self._lookup(parts[first], parts[first + 1])[0]
            grid, live = rank.reshape(m, wide), np.arange(m)
            while len(live):
                at = grid[live].argmin(1)  # of equal ranks the leftmost
                at += live * wide
                good = rank[at] < NEVER
                live, at = live[good], at[good]
                right = after[at]
                parts[at] = self._lookup(parts[at], parts[right])[1]
                parts[right], rank[right] = GONE, NEVER
                then = after[right]
                after[at], before[then] = then, at
                rank[at] = self._lookup(parts[at], parts[then])[0]
                left = before[at]
                has = left >= live * wide
                at, left = at[has], left[has]
                rank[left] = self._lookup(parts[left], parts[at])[0]
            kept = np.flatnonzero(parts > GONE)
            of, flat = kept // wide, parts[kept]
            known = flat >= 0
            flat[known] = names[flat[known]]
            low = (flat < 0) & (flat >= -128)
            flat[low] = np.array(self.bytes, np.int32)[-flat[low] - 1]
            edges = np.searchsorted(of, np.arange(m + 1)).tolist()
            data, odd = flat.astype("<i4").tobytes(), set(of[flat < 0].tolist())
            for i, (k, x, y) in enumerate(zip(some.tolist(), edges[:-1], edges[1:])):
                # characters of several bytes without a piece are spelled one by one
                if i in odd:
                    out[k] = np.array([z for p in flat[x:y].tolist() for z in ([p] if p >= 0 else [self.bytes[b] for b in chr(-p - 1).encode()])], "<i4").tobytes()
                else:
                    out[k] = data[4 * x : 4 * y]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of each whole text with a space before it."""
        if not self.splits:
            return [self.path(_marked(" " + t)) for t in texts]
        split = [_UNIT.findall(" " + t) for t in texts]
        memory = self.memory
        if len(memory) >= REMEMBERED:
            memory.clear()
        new = [u for u in set().union(*split) if u not in memory]
        short = [u for u in new if len(u) < LONG]
        memory.update(zip(short, self.words(short)))
        memory.update((u, self.path(_marked(u))) for u in new if len(u) >= LONG)
        return [b"".join([memory[u] for u in us]) for us in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    # ---- chunks

    def across(self, text: str, border: int, last: bool) -> list[tuple[int, str]]:
        """States of a border: (start, piece) of the pieces that can hold the character before it; at a text's end, end there."""
        out = []
        for s in range(max(0, border - self.longest), border):
            out += [(s, t) for t in self.starting(text, s) if s + len(t) >= border and (not last or s + len(t) == border)]
        return out

    def cuts(self, text: str, lead: int, size: int) -> tuple[int, int]:
        """The first and the last place inside a chunk where a space follows another character; -1 if there are none."""
        places = [m.start() + 1 for m in re.finditer(f"[^{SPACE}]{SPACE}", text[lead : lead + size])] if self.splits else []
        return (lead + places[0], lead + places[-1]) if places else (-1, -1)

    def walk(self, text: str, entry: list[tuple[int, str]], stop: int, back: dict | None = None) -> dict[int, dict[str, int]]:
        """Which pieces that end at ``stop`` or later, having started before, can be reached from which entry states.

        The result has the pieces by their end, each with a bit for every entry state; ``back`` gets every piece's
        predecessor, for a single entry state.
        """
        reach: dict[int, dict[str, int]] = {}
        for i, (s, t) in enumerate(entry):
            reach.setdefault(s + len(t), {})[t] = reach.get(s + len(t), {}).get(t, 0) | 1 << i
        for at in range(min(reach, default=stop), stop):
            before = reach.pop(at, None)
            if not before:
                continue
            for t in self.starting(text, at):
                mask = 0
                for p, m in before.items():
                    if m | mask != mask and self.meet(p, t):
                        mask |= m
                        if back is not None:
                            back[at, t] = p
                if mask:
                    here = reach.setdefault(at + len(t), {})
                    here[t] = here.get(t, 0) | mask
        return reach

    def chunk_matrix(self, part: str, lead: int, size: int, last: bool) -> np.ndarray:
        """Max-plus matrix of a chunk: 0 where its exit state can be reached from its entry state.

        ``part`` holds the chunk's ``size`` characters, ``lead`` before them (none at a text's start) and some after. A
        state is the piece that holds the character before a border. Paths meet where a word ends: only what is before
        the first and after the last such place depends on the states.
        """
        text, stop = _marked(part), lead + size
        entry = self.across(text, lead, False) if lead else [(0, "")]
        leave = self.across(text, stop, last)
        first, final = self.cuts(text, lead, size)
        out = np.full((len(entry), len(leave)), -np.inf)
        if first < 0:
            reach = self.walk(text, entry, stop)
            for j, (s, t) in enumerate(leave):
                mask = reach.get(s + len(t), {}).get(t, 0)
                out[[i for i in range(len(entry)) if mask >> i & 1], j] = 0.0
            return out
        # a piece of a word ends where the word does
        came = 0
        for mask in self.walk(text[:first], entry, first).get(first, {}).values():
            came |= mask
        tail = self.walk(text, [(final, "")], stop)
        goes = [j for j, (s, t) in enumerate(leave) if s >= final and tail.get(s + len(t), {}).get(t)]
        out[np.ix_([i for i in range(len(entry)) if came >> i & 1], goes)] = 0.0
        return out

    def chunk_ids(self, part: str, lead: int, size: int, last: bool, start: int, stop: int) -> list[int]:
        """Ids of the pieces that start in the chunk, from one entry state to one exit state."""
        text, end = _marked(part), lead + size
        entry = self.across(text, lead, False)[start] if lead else (0, "")
        leave = self.across(text, end, last)[stop]
        first, final = self.cuts(text, lead, size)
        if first < 0:
            return self.trace(text, entry, end, leave)
        head = self.trace(text[:first], entry, first, None)
        middle = np.frombuffer(self.encode(part[first + 1 : final]) if final > first else b"", "<i4").tolist()
        return head + middle + self.trace(text, (final, ""), end, leave)

    def trace(self, text: str, entry: tuple[int, str], stop: int, leave: tuple[int, str] | None) -> list[int]:
        """Ids of the pieces after the entry state, up to the exit state or to the one piece that ends at ``stop``."""
        back: dict[tuple[int, str], str] = {}
        reach = self.walk(text, [entry], stop, back)
        at, piece = (leave[0] + len(leave[1]), leave[1]) if leave else (stop, next(iter(reach[stop])))
        begin, out = entry[0] + len(entry[1]), []
        while at > begin:
            out.append(piece)
            at, piece = at - len(piece), back[at - len(piece), piece]
        return [x for p in reversed(out) for x in self.ids(p)]

    def path(self, text: str) -> bytes:
        """Ids (int32 bytes) of one marked text, every place looked at."""
        ends = [(s, t) for s, t in self.across(text, len(text), True)]
        reach = self.walk(text, [(0, "")], len(text))
        leave = next((x for x in ends if x[1] in reach.get(len(text), {})), None)
        return np.array(self.trace(text, (0, ""), len(text), leave), "<i4").tobytes()


def _hashed(keys: np.ndarray, size: int) -> np.ndarray:
    return (common.mix(keys) & np.uint64(size - 1)).astype(np.int64)


def _marked(text: str) -> str:
    """Spaces as markers; a marker character of the text itself is no space."""
    return text.replace(SPACE, LITERAL).replace(" ", SPACE)


def states(matrices: list[np.ndarray]) -> list[int]:
    """Border states of the path through all chunks: one for each border, the text's start and end included.

    Matrices combine by (max, +), which is associative: runs of chunks are multiplied pairwise up a tree, and the
    state at each middle border is then chosen from the root down. One path is finite, so there are no ties.
    """
    tree = [matrices]
    while len(tree[-1]) > 1:
        level = tree[-1]
        tree.append([
            (level[i][:, :, None] + level[i + 1][None, :, :]).max(1) if i + 1 < len(level) else level[i]
            for i in range(0, len(level), 2)
        ])
    ends = [(0, int(tree[-1][0][0].argmax()))]
    for level in reversed(tree[:-1]):
        below: list[tuple[int, int]] = []
        for i, (a, b) in zip(range(0, len(level), 2), ends):
            if i + 1 < len(level):
                m = int((level[i][a] + level[i + 1][:, b]).argmax())
                below += [(a, m), (m, b)]
            else:
                below.append((a, b))
        ends = below
    return [ends[0][0], *[b for _, b in ends]]


def _listed(ids: list[bytes]) -> pa.ListArray:
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _texts(spelled: list[bytes], ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts that runs of ids spell, each without its first space; bytes that are no UTF-8 are replaced."""
    sizes = np.array([len(x) for x in spelled])
    begins = np.concatenate(([0], np.cumsum(sizes)))
    n = sizes[ids]
    to = np.concatenate(([0], np.cumsum(n)))
    data = np.frombuffer(b"".join(spelled), np.uint8)
    text = data[np.repeat(begins[ids] - to[:-1], n) + np.arange(to[-1])].tobytes()
    at = to[np.concatenate(([0], np.cumsum(counts)))].tolist()
    return [text[x + 1 : y].decode("utf-8", "replace") if y > x else "" for x, y in zip(at[:-1], at[1:])]


def encode(spark: SparkSession, docs: DataFrame, path: str = MODEL, chunk: int = CHUNK, carry: tuple[str, ...] = (), verify: bool = False) -> DataFrame:
    """(doc_id, text, *carry, ids): the pieces of each whole text, the ids that the model's own library gives.

    Spaces become markers and one stands before the text, as the model asks; characters without a piece become the
    pieces of their bytes. So do marker characters of the text itself (the library reads them as spaces), so that
    decoding gives back any text. Null and empty texts have no pieces. Texts up to ``chunk`` characters are encoded
    where they are. Longer ones are split into chunks: each gives the matrix of what can be reached from its entry to
    its exit states, the matrices of a text are combined, and with its border states known each chunk is traced back
    on its own; the ids do not depend on ``chunk`` (twice the longest piece at least). Ties of equal scores go to the
    left, as in the library. Repeated rows are kept; those of a giant text are computed once. An empty table gives an
    empty result. ``carry`` names columns to pass through (none of the result's names); all others are left out. With
    ``verify`` the pieces are decoded again where they were made, and ``round_trip`` tells whether that gave the text.
    """
    if clash := {"doc_id", "text", "ids", "key", "round_trip", "decoded"} & {*carry}:
        raise ValueError(f"carried columns clash with the result's: {sorted(clash)}")
    vocabulary = Vocabulary(path)
    if chunk < 2 * vocabulary.longest:
        raise ValueError(f"chunks of {chunk} characters are shorter than two pieces of {vocabulary.longest}")
    model = spark.sparkContext.broadcast(vocabulary)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    rows = docs.select("doc_id", "text", *carry)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = model.value
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                texts = part.column(1).to_pylist()
                ids = [x if t else b"" for t, x in zip(texts, v.encode_all([t or "" for t in texts]))]
                columns, names = [*part.columns, _listed(ids)], [*batch.schema.names, "ids"]
                if verify:
                    flat = np.frombuffer(b"".join(ids), "<i4")
                    back = _texts(v.spelled, flat, np.array([len(x) // 4 for x in ids], np.int64))
                    columns, names = [*columns, pa.array([t == (x or "") for t, x in zip(back, texts)])], [*names, "round_trip"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        v.forget()

    more = ", round_trip boolean" if verify else ""
    giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    small = rows.filter(~giant).mapInArrow(common.tidy(short), f"doc_id long, text string{kinds}, ids array<int>{more}")

    large = rows.filter(giant).withColumn("key", F.sha2("text", 256))
    # each chunk with the characters around it that the pieces across its borders may take
    reach = vocabulary.longest
    chunks = (
        large.select("key", F.concat(F.lit(" "), "text").alias("text")).dropDuplicates(["key"])
        .select("key", F.length("text").alias("total"), F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int")),
            lambda c: F.substring("text", F.greatest(c * chunk - reach, F.lit(0)) + 1, F.least(c * chunk, F.lit(reach)) + chunk + reach),
        )).alias("no", "part"))
        .withColumn("lead", F.least(F.col("no") * chunk, F.lit(reach)))
        .withColumn("size", F.least(F.col("total") - F.col("no") * chunk, F.lit(chunk)))
        .withColumn("last", (F.col("no") + 1) * chunk >= F.col("total"))
        .drop("total")
    )

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = model.value
        for f in frames:
            out = [v.chunk_matrix(*c) for c in zip(f["part"], f["lead"], f["size"], f["last"])]
            yield pd.DataFrame({"key": f["key"], "no": f["no"], "width": [m.shape[1] for m in out], "matrix": [(m == 0).tobytes() for m in out]})

    def paths(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("no")
        at = states([np.where(np.frombuffer(m, bool).reshape(-1, w), 0.0, -np.inf) for m, w in zip(f["matrix"], f["width"])])
        return pd.DataFrame({"key": f["key"], "no": f["no"], "start": at[:-1], "stop": at[1:]})

    def traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = model.value
        for f in frames:
            out = [v.chunk_ids(*c) for c in zip(f["part"], f["lead"], f["size"], f["last"], f["start"], f["stop"])]
            yield pd.DataFrame({"key": f["key"], "no": f["no"], "ids": out})

    spread = chunks.repartition(common.parts(docs), "key", "no")
    bounds = spread.mapInPandas(common.tidy(matrices), "key string, no int, width int, matrix binary").groupBy("key").applyInPandas(paths, "key string, no int, start int, stop int")
    pieces = spread.join(bounds, ["key", "no"]).mapInPandas(common.tidy(traced), "key string, no int, ids array<int>")
    whole = pieces.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
    done = large.join(whole, "key").select("doc_id", "text", *carry, "ids")
    if verify:
        back = decode(spark, done, path, ("text", *carry, "ids"))
        done = back.withColumn("round_trip", F.col("decoded") == F.col("text")).drop("decoded")
    return small.unionByName(done)


def decode(spark: SparkSession, encoded: DataFrame, path: str = MODEL, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, decoded) for rows of ``encoded(doc_id, ids)``: the text that the pieces spell.

    Null or no ids give an empty text; bytes that are no UTF-8 are replaced.
    """
    table = spark.sparkContext.broadcast(Vocabulary(path).spelled)
    kinds = "".join(f", `{c}` {encoded.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                lists = part.column(1)
                counts = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()])
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                out = _texts(table.value, ids, counts)
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(out, pa.string())], names=["doc_id", *carry, "decoded"])

    return encoded.select("doc_id", "ids", *carry).mapInArrow(run, f"doc_id long{kinds}, decoded string")
