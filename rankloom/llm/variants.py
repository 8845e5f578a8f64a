"""Spelling variants: words one edit apart, found by chunks on one side and positional grams on the other."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common

#: Words shorter than this (code points) are left out, and those that occur less often than this.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One run in so many (by its crc32 with the document's id) loses a code point.
EVERY = 31
#: A near word so many times as frequent is a word's form.
TIMES = 10
#: A bucket of more pairs than this is split by a further chunk.
PAIRS = 1 << 10
#: A task hands its counts on when it holds so many distinct words.
HELD = 1 << 18
#: Runs of more bytes have their crc32 taken one by one.
LONG = 64

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, _TABLE >> 1 ^ np.uint32(0xEDB88320), _TABLE >> 1)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True  # byte C3 leads all of U+00C0 to U+00FF, and nothing else


def _crc32(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span, carried on from ``before``: a byte of all spans at a time, the longest first."""
    order = np.argsort(-sizes, kind="stable")
    at, size, state = starts[order], sizes[order], before[order] ^ np.uint32(0xFFFFFFFF)
    whole = int(np.searchsorted(-size, -LONG, "left"))
    for i in range(whole):
        state[i] = zlib.crc32(raw[at[i] : at[i] + size[i]], int(before[order[i]])) ^ 0xFFFFFFFF
    live = np.searchsorted(-size, -np.arange(1, LONG), "right")
    for k, n in enumerate(live.tolist()):
        if n <= whole:
            break
        s = state[whole:n]
        state[whole:n] = _TABLE[(s ^ raw[at[whole:n] + k]) & np.uint32(255)] ^ s >> np.uint32(8)
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _words(raw: np.ndarray, offsets: np.ndarray, before: np.ndarray) -> pa.Array | None:
    """The long enough words of one slice, after the deletions; ``before`` is the crc32 of each row's id and colon."""
    n = len(raw)
    if not n:
        return None
    tail = np.zeros(n, bool)
    tail[1:] = raw[:-1] == 0xC3
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _LETTER[raw] | tail
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:n]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    tails = np.concatenate(([0], np.cumsum(tail, dtype=np.int64)))
    points = ends - starts - (tails[ends] - tails[starts])
    long = points >= LEAST_LENGTH
    starts, ends, points = starts[long], ends[long], points[long]
    if not len(starts):
        return None
    low = common.fold(raw)
    h = _crc32(low, starts, ends - starts, before[np.searchsorted(offsets, starts, "right") - 1]).astype(np.int64)
    hit = h % EVERY == 0
    stays = ~hit | (points > LEAST_LENGTH)
    starts, ends, points, h, hit = starts[stays], ends[stays], points[stays], h[stays], hit[stays]
    heads = np.flatnonzero(~tail)
    gone = heads[np.searchsorted(heads, starts[hit]) + h[hit] % points[hit]]
    wide = raw[gone] == 0xC3
    step = np.zeros(n + 1, np.int8)
    step[starts] += 1
    np.subtract.at(step, ends, 1)
    kept = np.cumsum(step[:n], dtype=np.int8) > 0
    kept[gone] = kept[gone[wide] + 1] = False
    sizes = ends - starts
    sizes[hit] -= 1 + wide
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(at), pa.py_buffer(low[kept]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0

    def summed() -> pa.Table:
        t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        return t.rename_columns(["word", "n"])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, some, raw, offsets in common.slices(batch):
            before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[first : first + some]], np.uint32)
            words = _words(raw, offsets, before)
            if words is None:
                continue
            counted = pc.value_counts(words)
            held.append(pa.table({"word": counted.field(0), "n": counted.field(1)}))
            rows += len(counted)
            if rows > 2 * HELD:
                held = [summed()]
                rows = held[0].num_rows
                if rows > HELD:
                    yield from held.pop().to_batches(1 << 16)
                    rows = 0
    if held:
        yield from summed().to_batches(1 << 16)


def words(docs: DataFrame) -> DataFrame:
    """(word, n): distinct words of ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences or more, over whole texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; where EVERY divides the crc32 h of
    ``<doc_id>:<run>``, the run's code point number h modulo its length is deleted first. A null doc_id is written as
    nothing, a null text holds no words, repeated rows count each. Tasks count their own words before the shuffle, and
    a frequent word is one row a task there. A text of any length is cut into runs in one pass, in its own memory.
    """
    rows = docs.select("doc_id", "text").mapInArrow(common.tidy(_count), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _halved(entries: DataFrame) -> DataFrame:
    """Both halves of each entry's open stretch [lo, hi): the first closed (the edit is behind it), the second closed."""
    half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    sides = F.array(F.struct(half.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), half.alias("hi")))
    out = entries.select("word", "n", "size", "own", F.inline(sides))
    key = F.concat_ws(" ", F.substring("word", F.lit(1), F.col("lo")), F.expr("right(word, size - hi)"), F.col("size").cast("string"))
    return out.withColumn("key", key)


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, a_n, b, b_n): each unordered pair of distinct ``words(word, n)`` that one edit parts, once; b is the longer or later.

    One edit leaves one of two disjoint chunks of a whole. So ``a`` gives its two halves, and ``b`` all grams that can
    equal them: those of the halves' lengths within one place of where they stand, which are its own first and last
    code points for words of its length and of one less. Words that share a chunk in a bucket of more than ``pairs``
    pairs share it for sure, so the rest of the word is halved again within the bucket, and so on: a frequent ending
    costs its words a longer key each and no pairs. A rest of one code point is not halved: there nearly all pairs are
    results, and a bucket is bounded by the alphabet. A pair with both chunks in common counts in the first. The
    candidates are verified by their edit distance. No words give no rows; no pair is dropped and none is sampled.
    """
    size = F.char_length("word")
    lengths = F.array(F.struct(size.alias("size"), F.lit(True).alias("own")), F.struct((size - 1).alias("size"), F.lit(False).alias("own")))
    entries = _halved(words.select("word", "n", F.inline(lengths)).withColumns({"lo": F.lit(0), "hi": F.col("size")}))
    found = None
    while True:
        counts = entries.groupBy("key").agg(F.count_if("own").alias("own_n"), F.count("*").alias("all_n")).filter("own_n > 0 AND all_n > 1")
        sized = entries.join(counts, "key").withColumn("wide", (F.col("own_n") * F.col("all_n") > pairs) & (F.col("hi") - F.col("lo") > 1))
        sized = common.cut(sized.drop("own_n", "all_n"))
        shared = sized.filter("NOT wide")
        a = shared.filter("own").select("key", "size", "hi", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = shared.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("own").alias("same"))
        first = (F.col("hi") == F.col("size")) | (F.substring("a", F.lit(1), F.col("hi")) != F.substring("b", F.lit(1), F.col("hi")))
        once = (~F.col("same") | (F.col("a") < F.col("b"))) & first
        here = a.join(b, "key").filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")
        found = here if found is None else found.unionByName(here)
        wide = sized.filter("wide")
        if wide.isEmpty():
            return found
        entries = _halved(wide.drop("key", "wide"))


def group(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root): the near words of each of ``words``, its form, and the last form from it on.

    A form is the near word of largest n, of several the first in code-point order, where its n is ``times`` the word's
    or more; forms grow by that factor, so that chains are short and have no circles. They are followed by pointer
    doubling; a form that many words share is one row of the joins' other side. Null and empty texts, repeated rows and
    null ids count as in ``words``; other columns than doc_id and text are not looked at; no words give no rows.
    """
    own = common.cut(words(docs))
    pairs = near_pairs(own)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")),
    )
    rows = pairs.select(F.inline(sides)).withColumn("n", F.lit(None).cast("long"))
    rows = rows.unionByName(own.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n")))
    best = F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), F.min(best).alias("best"))
    enough = -F.col("best.less") >= F.col("n") * times
    near = common.cut(near.select("word", "n", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    steps = near.filter("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("open"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = common.cut(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")))
        if steps.filter("open").isEmpty():
            break
    return near.join(steps.drop("open"), "word", "left").withColumn("root", F.coalesce("root", "word"))
