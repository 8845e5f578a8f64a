"""Content-defined anchors: where a sequence of symbols can hold a window that another document holds too.

A window of ``length`` symbols is assigned to one of its ``length - gram + 1`` grams, the one of the smallest hash and
of those the leftmost. The choice depends on the window's content alone, so equal windows have equal anchors at equal
offsets: a window can only repeat where its anchor repeats.
"""

from __future__ import annotations

import numpy as np

from rankloom.llm import common

#: Low bits of a sort key that hold the place; pieces are shorter than this.
_PLACE = 26
#: Symbols that one pass takes; longer texts go in overlapping pieces.
PIECE = 1 << 19


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _piece(symbols: np.ndarray, ends: np.ndarray, length: int, gram: int):
    n = len(symbols)
    prefix = common.prefix_hash(symbols)
    _, down = common.powers(n)
    grams = common.mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    mask = np.uint64((1 << _PLACE) - 1)
    keys = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_min(keys, length - gram + 1) & mask).astype(np.int64)  # the anchor of the window at each place
    # windows that would cross a text's end
    crossing = np.zeros(len(at) + 1, np.int64)
    np.add.at(crossing, np.clip(ends[:-1] - length + 1, 0, len(at)), 1)
    np.add.at(crossing, np.clip(ends[:-1], 0, len(at)), -1)
    valid = np.cumsum(crossing[:-1]) == 0
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.ones(len(at), bool)
    stop[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    where = at[first]
    # hash of the whole stretch of symbols that the anchor's windows cover
    whole = common.spans(prefix, first, last + length)
    return grams[where], where, first, last, whole


def runs(symbols: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Anchors of the texts ``symbols[offsets[i]:offsets[i + 1]]``.

    For each: its gram's hash, its place, the first and last window that it has (places in ``symbols``), the hash of
    the symbols those windows cover, and the text's number. A run that a piece of a very long text cuts is given in two.
    """
    out = []
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        for c in range(a, b, PIECE) if b - a > PIECE else (a,):
            d = min(b, c + PIECE + length - 1) if b - a > PIECE else b
            if d - c >= length:
                ends = offsets[i + 1 : j + 1] - c if b - a <= PIECE else np.array([d - c])
                h, where, first, last, whole = _piece(symbols[c:d], ends, length, gram)
                out.append((h, where + c, first + c, last + c, whole))
        i = j
    if not out:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none, none.view(np.uint64), none
    h, where, first, last, whole = (np.concatenate(x) for x in zip(*out))
    return h, where, first, last, whole, np.searchsorted(offsets, first, "right") - 1
